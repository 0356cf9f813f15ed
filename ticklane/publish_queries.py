"""Queries of what may be read: the catalogue of days with their gates and windows, and reports that are missing, stale or ready.

Sources of the given tables' sessions are written to a shared folder, with faults by the session's number modulo 41: no trades (3), trades alone
(4), no manifest (5), a manifest that is no JSON (6) or not committed (7), no marker (8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklane.registry import query
from ticklane.source_queries import _DAY, _day
from ticklane.sources import domain as D
from ticklane.sources import files, publish

LAYOUTS = {"deal": "deal/day={key}", "snapshot": "snapshot/day={key}", "order_raw": "order_raw/day={key}"}
MINUTES = {"minute": "minute/day={key}"}

_GATES = f"""s AS (SELECT DISTINCT i, {_DAY} AS day, i % 41 AS k FROM ({D.DEALS})),
x AS (SELECT *, true AS session FROM s UNION ALL SELECT i, left(day, 6) || '02', -1, false FROM s WHERE k = 20),
g AS (SELECT *, CASE k WHEN 3 THEN ['deal'] WHEN 4 THEN ['snapshot', 'order_raw'] WHEN 5 THEN ['manifest'] WHEN 6 THEN ['manifest'] WHEN 7 THEN ['COMMITTED'] WHEN 8 THEN ['COMMITTED'] WHEN -1 THEN ['deal', 'snapshot', 'order_raw', 'manifest'] ELSE [] END AS missing FROM x),
n AS (SELECT *, sum(CASE WHEN session THEN 1 ELSE 0 END) OVER (ORDER BY day) AS place FROM g),
w AS (SELECT n.day, list(c.day ORDER BY c.day) AS days, coalesce(list(c.day ORDER BY c.day) FILTER (len(c.missing) > 0), []) AS lacking FROM n JOIN n c ON c.session AND c.place BETWEEN n.place - 6 AND n.place WHERE n.place >= 7 GROUP BY n.day),
d AS (SELECT n.day, i, k, missing, coalesce(days, []) AS days, coalesce(lacking, []) AS lacking, coalesce(len(missing) = 0 AND len(lacking) = 0 AND days[-1] = n.day, false) AS ready FROM n LEFT JOIN w USING (day))"""


def source_root(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """The folder of sources and the sessions (day, k)."""
    root = files.shared_folder(spark)
    rows = files.stored(D.deals(spark, sf).select("code", "price", "qty", _day(F.col("i")).alias("day"), (F.col("i") % 41).alias("k"), "i"))
    sessions = files.stored(rows.select("day", "k", "i").distinct())
    for kind, held in (("deal", "k <> 3"), ("snapshot", "k <> 4"), ("order_raw", "k <> 4")):
        rows.where(held).select("day", "code", "price", "qty").write.partitionBy("day").parquet(f"{root}/{kind}")
    aside = sessions.where("k = 20").withColumn("day", F.concat(F.left("day", F.lit(6)), F.lit("02")))
    sessions.where("i % 4 <> 1").unionByName(aside).select("day", "i").write.partitionBy("day").parquet(f"{root}/minute")
    for r in sessions.collect():  # a row a session
        at = f"{root}/{publish.AUDIT}/{r.day}"
        if r.k != 5:
            files.put(spark, f"{at}/manifest.json", {6: "not so", 7: '{"commit_state": "PENDING"}'}.get(r.k, '{"commit_state": "COMMITTED"}'))
        if r.k != 8:
            files.put(spark, f"{at}/COMMITTED")
    return root, sessions


@query(f"WITH {_GATES} SELECT day, len(missing) = 0 AS complete, array_to_string(missing, ',') AS missing, array_to_string(days, ',') AS \"window\", array_to_string(lacking, ',') AS window_missing, ready AS can_build, k = -1 OR i % 4 <> 1 AS minute FROM d")
def date_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    root, sessions = source_root(spark, sf)
    got = publish.catalogue(spark, root, sessions.select("day"), LAYOUTS, MINUTES)
    return got.withColumns({c: F.array_join(c, ",") for c in ("missing", "window", "window_missing")})


@query(f"""WITH {_GATES}, c AS (SELECT day, k, ready, coalesce(list_has_any(days, (SELECT list(day) FROM d WHERE k = 30)), false) AS touched FROM d WHERE k <> -1),
r AS (SELECT day, CASE WHEN NOT ready OR k = 21 THEN NULL WHEN k = 22 THEN 'NO_PROVENANCE' WHEN k = 23 THEN 'BAD_PROVENANCE' WHEN touched THEN 'SOURCES_CHANGED' WHEN k = 24 THEN 'EMPTY' WHEN k = 25 THEN 'ROWS_CHANGED' ELSE 'ready' END AS told FROM c)
SELECT day, CASE WHEN told IS NULL THEN 'missing' WHEN told = 'ready' THEN 'ready' ELSE 'stale' END AS status, CASE WHEN told <> 'ready' THEN told END AS reason FROM r""")
def report_states(spark: SparkSession, sf: str) -> DataFrame:
    """Reports of all days that can be built are published; then one is taken away, and others lose what they rest on."""
    root, sessions = source_root(spark, sf)
    reports = files.shared_folder(spark)
    rows = D.deals(spark, sf).groupBy(_day(F.col("i")).alias("day"), "code").agg(F.count("*").alias("trades"))
    days = sessions.select("day")
    publish.publish(spark, reports, rows, root, days, LAYOUTS)
    for r in sessions.where("k BETWEEN 21 AND 25 OR k = 30").collect():  # a few sessions
        at, note = f"{reports}/day={r.day}", f"{reports}/_provenance/{r.day}.json"
        if r.k in (21, 24, 25):
            files.remove(spark, at)
        if r.k == 22:
            files.remove(spark, note)
        elif r.k == 23:
            files.put(spark, note, '{"sources": 1')
        elif r.k in (24, 25):
            spark.range(r.k - 24).select(F.col("id").alias("code"), F.lit(1).cast("long").alias("trades")).write.parquet(at)
        elif r.k == 30:
            spark.range(1).select(F.col("id").alias("code")).write.mode("append").parquet(f"{root}/deal/day={r.day}")
    return publish.report_states(spark, reports, "code long, trades long", root, days, LAYOUTS).join(days, "day", "left_semi")
