"""Results kept as they were: rows as Parquet, then a manifest with their digest, so that rows without one aren't whole.

A snapshot is never filled from live data, and reading one holds its rows against the digest."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def content_digest(df: DataFrame) -> str:
    """sha256 over the schema, the number of rows and sums of two hashes of each row: the same for any order or number of
    files, and one pass. Map columns have no hash; cast them before."""
    names = sorted(df.columns)
    row = [F.col(f"`{c}`") for c in names]
    # a null changes neither hash, so which columns are null goes in as well
    gaps = F.concat_ws("", *(F.when(c.isNull(), "1").otherwise("0") for c in row))
    sums = [F.sum(F.xxhash64(F.lit(seed), gaps, *row).cast("decimal(38,0)")) for seed in (1, 2)]
    n, a, b = df.agg(F.count("*"), *sums).first()
    kinds = [(c, df.schema[c].dataType.simpleString()) for c in names]
    return hashlib.sha256(json.dumps([kinds, n, str(a), str(b)]).encode()).hexdigest()


def save(df: DataFrame, path: str, about: dict[str, str] | None = None) -> str:
    """Write rows and then the manifest (digest and ``about``) to a new folder; raises if there is one. Returns the digest."""
    df.write.mode("errorifexists").parquet(f"{path}/rows")
    spark = df.sparkSession
    digest = content_digest(spark.read.parquet(f"{path}/rows"))
    manifest = json.dumps({"about": about or {}, "digest": digest}, sort_keys=True)
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/manifest")
    return digest


def manifest(spark: SparkSession, path: str) -> dict:
    """What save wrote beside the rows; Spark's own error if it isn't there."""
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])


def load(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a whole snapshot; ValueError if they aren't those that were saved."""
    expected = manifest(spark, path)["digest"]
    rows = spark.read.parquet(f"{path}/rows")
    found = content_digest(rows)
    if found != expected:
        raise ValueError(f"snapshot {path}: digest {found}, saved as {expected}")
    return rows
