"""Queries of the whole follow-up study: sessions studied or not, observations, sums.

Of the given tables' sessions one in 23 has no flow, and the source changes every 12 sessions; one price in 13 is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklane.plans import followup
from ticklane.queries import latest
from ticklane.registry import R, query, rounded
from ticklane.sources import domain as D
from ticklane.sources import files
from ticklane.study_queries import _BARS, _bars

_SPAN = f"m AS (SELECT max(i) - 70 AS a, max(i) - 1 AS z, max(i) - 40 AS split FROM ({D.DEALS}) WHERE price > 0 AND qty > 0 AND side <> 'C')"
_DAYS = f"""f AS (SELECT * FROM ({D.FACTS})), {_SPAN},
src AS (SELECT DISTINCT i, CASE WHEN i % 24 = 5 THEN 'LEGACY_DIRECTION_UNKNOWN' WHEN (i // 12) % 2 = 0 THEN 'NATIVE' ELSE 'LEGACY_CALIBRATED_ROW_GUARD' END AS source FROM f WHERE i % 23 <> 7),
days AS (SELECT c.i, CASE WHEN p.i IS NULL OR s.i IS NULL THEN 'MISSING_FLOW' WHEN s.source <> p.source OR s.source NOT IN ('NATIVE', 'LEGACY_CALIBRATED_ROW_GUARD') THEN 'CROSSING_SOURCES' ELSE 'STUDIED' END AS status,
 concat_ws(',', CASE WHEN p.i IS NULL THEN c.i - 1 END, CASE WHEN s.i IS NULL THEN c.i END) AS missing, p.source AS previous_source, s.source FROM (SELECT DISTINCT i FROM f, m WHERE i BETWEEN a AND z) c LEFT JOIN src p ON p.i = c.i - 1 LEFT JOIN src s ON s.i = c.i)"""
_ROWS = f"""{_DAYS}, price AS (SELECT code, i, close FROM f, m WHERE (code * 3 + i) % 13 <> 0 AND i <= z), b AS (SELECT * FROM ({_BARS})), u AS (SELECT code, i, ratio FROM f WHERE unknown = 0 AND amount > 0),
pool AS (SELECT x.code, x.i, y.ratio AS before, x.ratio, CASE WHEN y.ratio < 0 AND x.ratio > 0 THEN 'SELL_TO_BUY' WHEN y.ratio > 0 AND x.ratio < 0 THEN 'BUY_TO_SELL' WHEN y.ratio < 0 AND x.ratio < 0 AND x.ratio > y.ratio THEN 'SELL_EASING' WHEN y.ratio < 0 AND x.ratio < 0 AND x.ratio < y.ratio THEN 'SELL_WORSENING' END AS kind
 FROM u x JOIN u y ON y.code = x.code AND y.i = x.i - 1 JOIN days d ON d.i = x.i AND d.status = 'STUDIED'),
h AS (SELECT p.*, horizon, p.i + horizon AS target, n.close, t.close AS later, 100 * (t.close / n.close - 1) AS outcome FROM pool p CROSS JOIN (SELECT unnest([1, 3, 5]) AS horizon) LEFT JOIN price n ON n.code = p.code AND n.i = p.i LEFT JOIN price t ON t.code = p.code AND t.i = p.i + horizon),
means AS (SELECT i, horizon, avg(outcome) AS benchmark, count(outcome) AS pool_n FROM h GROUP BY ALL),
s AS (SELECT e.code, e.i, horizon, k, v.close AS v FROM h e CROSS JOIN (SELECT unnest(range(6)) AS k) LEFT JOIN price v ON v.code = e.code AND v.i = e.i + k WHERE k <= horizon AND kind IS NOT NULL),
top AS (SELECT *, max(v) OVER (PARTITION BY code, i, horizon ORDER BY k) AS top FROM s), fall AS (SELECT *, 100 * (v / top - 1) AS fall FROM top),
deep AS (SELECT code, i, horizon, CASE WHEN count(v) = count(*) THEN min(fall) END AS dd FROM fall GROUP BY ALL),
trough AS (SELECT d.code, d.i, d.horizon, d.dd, min(f.i + f.k) AS trough_i, arg_min(f.top, f.k) AS top FROM deep d LEFT JOIN fall f ON f.code = d.code AND f.i = d.i AND f.horizon = d.horizon AND f.fall = d.dd AND d.dd < 0 GROUP BY ALL),
peak AS (SELECT t.code, t.i, t.horizon, t.dd, t.trough_i, min(f.i + f.k) AS peak_i FROM trough t LEFT JOIN fall f ON f.code = t.code AND f.i = t.i AND f.horizon = t.horizon AND f.v = t.top GROUP BY ALL),
o AS (SELECT h.code, h.i, kind, h.horizon, target, CASE WHEN h.i + 5 <= split THEN 'TRAIN' WHEN h.i <= split THEN 'EMBARGO' ELSE 'OUT_OF_SAMPLE' END AS cohort, CASE WHEN target > z THEN 'PENDING' WHEN outcome IS NULL THEN 'MISSING_PRICE' ELSE 'OBSERVED' END AS status,
 before, ratio, ratio - before AS change, h.close, later, outcome, benchmark, pool_n, outcome - benchmark AS excess,
 CASE WHEN h.i + 1 > z THEN 'PENDING' WHEN b.code IS NULL THEN 'MISSING_BAR' WHEN NOT coalesce(least(o, h, l, c) > 0, false) THEN 'MISSING_PRICE' WHEN l > least(o, c) OR h < greatest(o, c) THEN 'INVALID_OHLC' WHEN volume IS NULL THEN 'UNKNOWN_VOLUME'
  WHEN volume <= 0 THEN 'NO_VOLUME' WHEN h = l THEN 'ONE_PRICE_SESSION' ELSE 'PRICE_REFERENCE_ONLY' END AS gate,
 CASE WHEN target > z THEN 'PENDING' WHEN dd IS NULL THEN 'MISSING_PRICE' ELSE 'OBSERVED' END AS path_status, dd AS drawdown, peak_i, trough_i
 FROM h JOIN means USING (i, horizon) LEFT JOIN b ON b.code = h.code AND b.i = h.i + 1 LEFT JOIN peak p ON p.code = h.code AND p.i = h.i AND p.horizon = h.horizon CROSS JOIN m WHERE kind IS NOT NULL)"""


def _days(facts: DataFrame, span: followup.Span) -> DataFrame:
    """Sessions of the span by the sources that hold them."""
    i = F.col("i")
    source = F.when(i % 24 == 5, "LEGACY_DIRECTION_UNKNOWN").when(F.floor(i / 12) % 2 == 0, "NATIVE").otherwise("LEGACY_CALIBRATED_ROW_GUARD")
    calendar = facts.select("i").distinct()
    return followup.signal_days(calendar, calendar.where("i % 23 <> 7").withColumn("source", source), span)


def _parts(spark: SparkSession, sf: str) -> tuple[DataFrame, followup.Span, DataFrame]:
    facts = files.stored(D.facts(spark, sf))
    last = latest(facts, 0)
    span = followup.Span(last - 70, last - 1, last - 1, last - 40)
    return facts, span, _days(facts, span)


def _observations(spark: SparkSession, sf: str) -> DataFrame:
    facts, span, days = _parts(spark, sf)
    return files.stored(followup.observations(facts, facts.where("(code * 3 + i) % 13 <> 0"), _bars(spark, sf), days, span))


@query(f"WITH {_DAYS} SELECT * FROM days")
def study_days(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf)[2].withColumn("missing", F.array_join(F.col("missing").cast("array<string>"), ","))


@query(f"WITH {_ROWS} SELECT * EXCLUDE (change, outcome, benchmark, excess, drawdown), {R('change')} AS change, {R('outcome')} AS outcome, {R('benchmark')} AS benchmark, {R('excess')} AS excess, {R('drawdown')} AS drawdown FROM o")
def followup_observations(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_observations(spark, sf), change=4, outcome=4, benchmark=4, excess=4, drawdown=4)


_SUMS = ("mean_outcome", "positive_share", "mean_excess", "mean_pool_n", "equal_day_mean", "least_without_one", "most_without_one", "median_outcome", "median_drawdown")


@query(f"""WITH {_ROWS}, d AS (SELECT cohort, kind, horizon, i, count(*) AS events, count(outcome) AS observed, count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'MISSING_PRICE') AS missing_price, avg(excess) AS de, max(pool_n) AS pool_n FROM o GROUP BY ALL),
y AS (SELECT cohort, kind, horizon, count(*) FILTER (observed > 0) AS signal_days, count(*) AS trigger_days, avg(de) AS em, count(de) AS n, sum(de) AS s, min(de) AS a, max(de) AS z,
 string_agg(concat_ws(':', i, events, observed, pending, missing_price, CASE WHEN events > pending THEN pool_n END, CAST(floor(de * 1000 + 0.5) AS BIGINT)), ',' ORDER BY i) AS days FROM d GROUP BY ALL),
g AS (SELECT cohort, kind, horizon, string_agg(gate || ':' || n, ',' ORDER BY gate) AS gates FROM (SELECT cohort, kind, horizon, gate, count(*) AS n FROM o GROUP BY ALL) GROUP BY ALL),
t AS (SELECT cohort, kind, horizon, count(*) AS events, count(outcome) AS observed, count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'MISSING_PRICE') AS missing_price, count(drawdown) FILTER (path_status = 'OBSERVED') AS paths, avg(outcome) AS mo, avg(CASE WHEN outcome > 0 THEN 1.0 WHEN outcome <= 0 THEN 0.0 END) AS up,
 avg(excess) AS me, avg(pool_n) FILTER (status = 'OBSERVED') AS mp, median({R("outcome")}) AS md, median({R("drawdown")}) FILTER (path_status = 'OBSERVED') AS mdd FROM o GROUP BY ALL)
SELECT cohort, kind, horizon, events, observed, pending, missing_price, signal_days, trigger_days, paths, {R("mo", 3)} AS mean_outcome, {R("up", 3)} AS positive_share, {R("me", 3)} AS mean_excess, {R("mp", 3)} AS mean_pool_n, {R("em", 3)} AS equal_day_mean,
 CASE WHEN n >= 2 THEN {R("(s - z) / (n - 1)", 3)} END AS least_without_one, CASE WHEN n >= 2 THEN {R("(s - a) / (n - 1)", 3)} END AS most_without_one, {R("md", 3)} AS median_outcome, {R("mdd", 3)} AS median_drawdown, days, gates
FROM t JOIN y USING (cohort, kind, horizon) JOIN g USING (cohort, kind, horizon)""")
def followup_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = followup.summary(_observations(spark, sf))
    whole = lambda c: F.floor(c * 1000 + 0.5).cast("long").cast("string")
    day = F.transform("days", lambda d: F.concat_ws(":", *(d[c].cast("string") for c in ("i", "events", "observed", "pending", "missing_price", "pool_n")), whole(d["mean_excess"])))
    gates = F.array_join(F.transform(F.map_entries("gates"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return rounded(rows.withColumn("days", F.array_join(day, ",")).withColumn("gates", gates), **dict.fromkeys(_SUMS, 3))
