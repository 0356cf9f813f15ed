"""Listings, small control files and shared folders, through the file systems Spark knows, so that any store will do.

A listing is metadata of some days or securities; rows of files are only ever read by Spark's readers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, fs = _at(spark, path)
    return fs.exists(place)


def put(spark: SparkSession, path: str, text: str = "") -> None:
    """Write a small control file whole, over an older one."""
    place, fs = _at(spark, path)
    out = fs.create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def pattern(layout: str) -> str:
    """A regular expression for the part of a path that ``layout`` (with ``{key}``) describes; its group is the key."""
    before, after = layout.split("{key}")
    return f"/{re.escape(before)}([^/=]+){re.escape(after)}(?:/[^/]*)?$"


def listed(spark: SparkSession, root: str, layout: str) -> dict[str, str]:
    """Paths under ``root`` by key; a root that isn't there has none."""
    place, fs = _at(spark, f"{root}/{layout.replace('{key}', '*')}")
    found = {}
    for status in fs.globStatus(place) or []:
        path = status.getPath().toString()
        if match := re.search(pattern(layout), path):
            found[match.group(1)] = path
    return found


def key_of_file(layout: str) -> Column:
    """The key in the name of the file that a row is from; to be selected from a scan itself."""
    return F.regexp_extract(F.col("_metadata.file_path"), pattern(layout), 1)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under the checkpoint folder, or a temporary one in a local session that
    has none. A cluster without one raises."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-tables-")
    return f"{base}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows written once to a shared folder and read again, so that what is built on them reads a table, not the plan."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Take a file or folder away; nothing happens where none is."""
    place, fs = _at(spark, path)
    fs.delete(place, True)


def move(spark: SparkSession, old: str, new: str) -> None:
    """Rename a file or folder, with the folders above its new place; OSError where it isn't done, so that nobody goes on as if it were."""
    place, fs = _at(spark, old)
    target, _ = _at(spark, new)
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(place, target):
        raise OSError(f"{old} was not moved to {new}")
