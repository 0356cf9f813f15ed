"""A store of a study's observations, made to be looked up by a few securities, and an audit of when its inputs were last changed.

Rows lie in ranges of (code, i, horizon), sorted, so that a look-up by code reads the files and row groups whose statistics hold it and no
others. The number of rows and a digest of their content are written last; a store without them, or whose rows are other ones, raises."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklane.plans.requests import DETAILS
from ticklane.sources import files, snapshots

KEY = ["code", "i", "horizon"]


def save(observations: DataFrame, path: str, about: dict[str, str] | None = None, partitions: int | None = None) -> str:
    """Write observations (code, i, horizon and others) to a new folder; returns the digest. Every row is kept, repeated ones too."""
    held = files.stored(observations)
    ranged = held.repartitionByRange(partitions, *KEY) if partitions else held.repartitionByRange(*KEY)
    return snapshots.save(ranged.sortWithinPartitions(*KEY), path, (about or {}) | {"rows": str(held.count())})


def verify(spark: SparkSession, path: str) -> DataFrame:
    """All rows, after holding every one of them against the digest: one pass, for a store that may have been changed."""
    return snapshots.load(spark, path)


def lookup(spark: SparkSession, path: str, codes: list) -> DataFrame:
    """Rows of up to DETAILS securities by code, the latest session first, then by horizon. The number of rows in the store, which Parquet
    knows without reading them, must be the one that was saved; ``verify`` holds their content too."""
    once = list(dict.fromkeys(codes))
    if not 1 <= len(once) <= DETAILS:
        raise ValueError(f"1 to {DETAILS} securities; got {len(once)}")
    expected, rows = int(snapshots.manifest(spark, path)["about"]["rows"]), spark.read.parquet(f"{path}/rows")
    found = rows.count()
    if found != expected:
        raise ValueError(f"store {path}: {found} rows, saved as {expected}")
    return rows.where(F.col("code").isin(once)).orderBy("code", F.desc("i"), "horizon")


def file_changes(spark: SparkSession, root: str, layout: str, zone: str = "Asia/Shanghai") -> DataFrame:
    """day (in the file's name), changed (the latest time of change of its files, on the market's clock), files and bytes; only the listing is
    read. An empty folder has no days."""
    held = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime", "length")
    named = held.withColumn("day", F.regexp_extract("path", files.pattern(layout), 1)).where("day <> ''")
    local = F.from_utc_timestamp(F.max("modificationTime"), zone)
    return named.groupBy("day").agg(local.alias("changed"), F.count("*").alias("files"), F.sum("length").alias("bytes"))


def timing_audit(changes: DataFrame, sessions: DataFrame) -> DataFrame:
    """Each session (day, YYYYMMDD) with when its files were last changed and a status: NO_FILE, CHANGED_AFTER_DAY (what it holds need not have
    been known then), CHANGED_BEFORE_DAY (no session's rows can be that old) or SAME_DAY. Not a proof of what stood when: a copy keeps no times."""
    on = F.date_format("changed", "yyyyMMdd")
    status = F.when(F.col("changed").isNull(), "NO_FILE").when(on > F.col("day"), "CHANGED_AFTER_DAY").when(on < F.col("day"), "CHANGED_BEFORE_DAY").otherwise("SAME_DAY")
    return sessions.select("day").distinct().join(changes, "day", "left").withColumn("status", status)


def timing_summary(audited: DataFrame) -> DataFrame:
    """One row: sessions, how many of each status, and the first and the last change."""
    n = lambda s: F.count_if(F.col("status") == s)
    return audited.agg(
        F.count("*").alias("sessions"), n("NO_FILE").alias("no_file"), n("CHANGED_AFTER_DAY").alias("changed_after"), n("CHANGED_BEFORE_DAY").alias("changed_before"), n("SAME_DAY").alias("same_day"),
        F.min("changed").alias("first_change"), F.max("changed").alias("last_change"))
