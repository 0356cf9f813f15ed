"""Queries of a store of observations and of the times its inputs were changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklane.queries import _OBS, study_observations
from ticklane.registry import R, query
from ticklane.source_queries import _DAY, LAYOUT, _day, _price_files
from ticklane.sources import domain as D
from ticklane.sources import files, store

#: The securities that are looked up, as many as one request may ask for.
CODES = list(range(1, 51))


@query(_OBS + f" SELECT code, i, kind, horizon, cohort, status, {R('outcome')} AS outcome, {R('benchmark')} AS benchmark, pool_n, {R('excess')} AS excess FROM o WHERE code BETWEEN 1 AND 50")
def observation_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A look-up in a store of all observations."""
    path = files.shared_folder(spark)
    store.save(study_observations(spark, sf), path)
    return store.lookup(spark, path, CODES)


@query(f"SELECT DISTINCT {_DAY} AS day, CASE WHEN i % 6 = 1 THEN 'NO_FILE' ELSE 'CHANGED_AFTER_DAY' END AS status FROM ({D.DEALS})")
def timing_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Price files written now against sessions long past: each was changed after its day, or isn't there."""
    folder, days = _price_files(spark, sf)
    sessions = D.deals(spark, sf).select(F.col("i")).distinct()
    changes = store.file_changes(spark, folder, LAYOUT).join(sessions.where("i % 6 <> 1").select(_day(F.col("i")).alias("day")), "day", "left_semi")
    return store.timing_audit(changes, sessions.select(_day(F.col("i")).alias("day"))).select("day", "status")
