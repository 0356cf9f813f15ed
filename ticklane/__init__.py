"""Market-microstructure analytics as Spark DataFrame jobs."""
