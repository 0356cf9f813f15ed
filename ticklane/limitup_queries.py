"""Queries of the study of securities at their upper limit: its sessions, cells and cells by session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklane.functions import exprs as X
from ticklane.plans import limitup
from ticklane.registry import R, query, rounded
from ticklane.sources import domain as D
from ticklane.sources import files
from ticklane.study_queries import _BARS, _bars

SPAN = limitup.Span(start=23906, split=23945, end=23975, asof=23978, horizons=(1, 2, 5))
_HORIZONS = "(SELECT CAST(unnest([1, 2, 5]) AS INT) AS horizon)"
_STATUS = "CASE WHEN i % 23 = 7 THEN 'LEGACY_DIRECTION_UNKNOWN' WHEN i // 12 % 2 = 0 THEN 'NATIVE' ELSE 'LEGACY_CALIBRATED_ROW_GUARD' END"


def _study(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The study over the given trades: every fifth security or so is on a session's list, some lists, flows, bars, prices and
    closes are missing, and some closes are not the list's."""
    code, i = F.col("code"), F.col("i")
    flow = files.stored(D.facts(spark, sf).where(i % 19 != 4))
    made = files.stored(_bars(spark, sf))
    boards = D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("code"), F.concat(F.lit("N"), (F.col("s_nationkey") % 3).cast("string")).alias("board"))
    bars = made.where((code + 2 * i) % 31 != 0).withColumn("c", F.when((code * 3 + i) % 29 != 0, F.col("c")))
    prices = made.where((code * 5 + i) % 23 != 0).select("code", "i", X.rounded(F.col("c") * (1 + i % 5 / 10.0)).alias("close"))
    off = F.when((code + i) % 11 == 0, 0.02).when((code + i) % 11 == 1, 0.01).when(i % 29 == 11, 1.0).otherwise(0.0)
    listed = made.where(((code * 7 + i * 3) % 5 == 0) & (i % 13 != 3) & (i % 17 != 5)).select("code", "i", (F.col("c") + off).alias("close")).join(boards, "code")
    sessions = spark.range(SPAN.start - 1, SPAN.end + 1).withColumnRenamed("id", "i")
    status = F.when(i % 23 == 7, "LEGACY_DIRECTION_UNKNOWN").when(F.floor(i / 12) % 2 == 0, "NATIVE").otherwise("LEGACY_CALIBRATED_ROW_GUARD")
    return limitup.study(flow, sessions.select("i", status.alias("status")), sessions.where("i % 13 <> 3"), listed, prices, bars, SPAN)


_ROWS = f"""WITH made AS MATERIALIZED ({_BARS}), flow AS MATERIALIZED (SELECT *, coalesce(unknown = 0 AND amount > 0 AND net IS NOT NULL, false) AS u FROM ({D.FACTS}) WHERE i % 19 <> 4),
bars AS (SELECT code, i, o, h, l, CASE WHEN (code * 3 + i) % 29 <> 0 THEN c END AS c, volume FROM made WHERE (code + 2 * i) % 31 <> 0),
prices AS (SELECT code, i, {R("c * (1 + i % 5 / 10.0)")} AS close FROM made WHERE (code * 5 + i) % 23 <> 0),
listed AS (SELECT code, i, c + CASE WHEN (code + i) % 11 = 0 THEN 0.02 WHEN (code + i) % 11 = 1 THEN 0.01 WHEN i % 29 = 11 THEN 1.0 ELSE 0.0 END AS close, 'N' || (s_nationkey % 3) AS board FROM made JOIN supplier ON s_suppkey = code WHERE (code * 7 + i * 3) % 5 = 0 AND i % 13 <> 3 AND i % 17 <> 5),
sess AS (SELECT CAST(unnest(range({SPAN.start}, {SPAN.end + 1})) AS BIGINT) AS i), src AS (SELECT i, {_STATUS} AS source FROM (SELECT CAST(unnest(range({SPAN.start - 1}, {SPAN.end + 1})) AS BIGINT) AS i)),
pair AS (SELECT b.code, b.i, b.amount, b.net, b.ratio, a.amount AS pa, a.net AS pn, a.ratio AS pr FROM flow b JOIN flow a ON a.code = b.code AND a.i = b.i - 1 WHERE a.u AND b.u),
mk AS (SELECT i, count(*) AS common, 100 * sum(pn) / sum(pa) AS ratio_before, 100 * sum(net) / sum(amount) AS ratio_now FROM pair p WHERE NOT EXISTS (SELECT 1 FROM listed l WHERE l.code = p.code AND l.i = p.i) GROUP BY i),
st AS (SELECT s.i, a.source, b.source AS source_prev, CASE WHEN s.i % 13 <> 3 THEN (SELECT count(*) FROM listed l WHERE l.i = s.i) END AS eligible, common, ratio_before, ratio_now, ratio_now - ratio_before AS delta,
  (SELECT count(DISTINCT f.i) FROM flow f WHERE f.i IN (s.i, s.i - 1)) AS held FROM sess s LEFT JOIN src a USING (i) LEFT JOIN src b ON b.i = s.i - 1 LEFT JOIN mk USING (i)),
early AS (SELECT *, CASE WHEN eligible IS NULL THEN 'MISSING_LIMIT_LIST' WHEN eligible = 0 THEN 'NO_ELIGIBLE_U' WHEN held < 2 THEN 'MISSING_FLOW' WHEN source NOT IN ('NATIVE', 'LEGACY_CALIBRATED_ROW_GUARD') OR source <> source_prev THEN 'SOURCE_NOT_COMPARABLE' END AS first FROM st),
el AS (SELECT l.code, l.i, l.board, CASE WHEN delta > 0 THEN 'IMPROVING' ELSE 'WEAKENING' END AS market, p.close AS now, q.amount,
  CASE WHEN NOT coalesce(b.c > 0, false) THEN 'R' WHEN abs(b.c - l.close) > 0.011 THEN 'X' WHEN NOT coalesce(p.close > 0, false) THEN 'A' ELSE 'M' END AS st,
  CASE WHEN q.ratio > q.pr THEN 'IMPROVING' WHEN q.ratio < q.pr THEN 'WEAKENING' WHEN q.ratio = q.pr THEN 'FLAT' END AS stock
  FROM listed l JOIN early e ON e.i = l.i AND first IS NULL AND coalesce(delta <> 0, false) LEFT JOIN bars b ON b.code = l.code AND b.i = l.i LEFT JOIN prices p ON p.code = l.code AND p.i = l.i LEFT JOIN pair q ON q.code = l.code AND q.i = l.i)"""

_EVENTS = f"""{_ROWS}, pool AS (SELECT el.code, el.i, board, market, stock, now, amount, horizon, el.i + horizon <= {SPAN.asof} AS mature, CASE WHEN el.i + horizon <= {SPAN.asof} THEN 100 * (t.close / now - 1) END AS outcome, t.close AS later,
  CASE WHEN b.code IS NULL THEN 'MISSING_BAR' WHEN NOT coalesce(least(o, h, l, c) > 0 AND o IS NOT NULL AND h IS NOT NULL AND l IS NOT NULL AND c IS NOT NULL, false) THEN 'MISSING_PRICE' WHEN l > least(o, c) OR h < greatest(o, c) THEN 'INVALID_OHLC' WHEN volume IS NULL THEN 'UNKNOWN_VOLUME'
   WHEN volume <= 0 THEN 'NO_VOLUME' WHEN h = l THEN 'ONE_PRICE_SESSION' ELSE 'PRICE_REFERENCE_ONLY' END AS gate, o * n.close / c AS adjusted
  FROM el CROSS JOIN {_HORIZONS} LEFT JOIN prices t ON t.code = el.code AND t.i = el.i + horizon LEFT JOIN bars b ON b.code = el.code AND b.i = el.i + 1 LEFT JOIN prices n ON n.code = el.code AND n.i = el.i + 1 WHERE st = 'M'),
ev AS (SELECT *, CASE WHEN i + 5 <= {SPAN.split} THEN 'TRAIN' WHEN i <= {SPAN.split} THEN 'EMBARGO' ELSE 'OUT_OF_SAMPLE' END AS cohort, CASE WHEN gate IN ('ONE_PRICE_SESSION', 'PRICE_REFERENCE_ONLY') THEN adjusted END AS reference,
  outcome - avg(outcome) OVER (PARTITION BY i, horizon) AS excess, outcome - avg(outcome) OVER (PARTITION BY i, horizon, board) AS board_excess FROM pool),
ev2 AS (SELECT *, CASE WHEN mature THEN 100 * (reference / now - 1) END AS gap, CASE WHEN horizon >= 2 AND outcome IS NOT NULL THEN 100 * (later / reference - 1) END AS after FROM ev WHERE stock IN ('IMPROVING', 'WEAKENING')),
by_day AS (SELECT cohort, horizon, market, stock, i, count(*) AS events, count(outcome) AS observed, avg(outcome) AS mean_return, avg(excess) AS mean_excess, avg(board_excess) AS mean_board_excess FROM ev2 GROUP BY ALL)"""


@query(f"""{_ROWS}, n AS (SELECT i, count(*) FILTER (st = 'M') AS matched, count(*) FILTER (st = 'X') AS mismatched, count(*) FILTER (st = 'R') AS missing_raw, count(*) FILTER (st = 'A') AS missing_adjusted,
  count(*) FILTER (st = 'M' AND stock <> 'FLAT') AS directed, count(*) FILTER (st = 'M' AND stock IS NULL) AS undirected, count(*) FILTER (st = 'M' AND stock = 'FLAT') AS flat FROM el GROUP BY i)
SELECT e.i, source, source_prev, eligible, CASE WHEN first IS NULL THEN coalesce(common, 0) END AS common, CASE WHEN first IS NULL THEN {R("ratio_before")} END AS ratio_before, CASE WHEN first IS NULL THEN {R("ratio_now")} END AS ratio_now,
 CASE WHEN first IS NULL THEN {R("delta")} END AS delta, CASE WHEN first IS NULL THEN CASE WHEN common IS NULL THEN 'NO_COMMON_STOCKS' ELSE 'AVAILABLE' END END AS market_status, matched, mismatched, missing_raw, missing_adjusted, directed, undirected, flat,
 coalesce(first, CASE WHEN NOT coalesce(delta <> 0, false) THEN 'MARKET_UNAVAILABLE_OR_FLAT' WHEN matched = 0 THEN 'NO_VALID_U_PRICE' WHEN directed = 0 THEN 'NO_VALID_STOCK_DIRECTION' ELSE 'COMPARABLE' END) AS study_status FROM early e LEFT JOIN n USING (i)""")
def limitup_days(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_study(spark, sf)[0], ratio_before=4, ratio_now=4, delta=4)


@query(f"""{_EVENTS} SELECT cohort, horizon, market, stock, i, events, observed, {R("mean_return")} AS mean_return, {R("mean_excess")} AS mean_excess, {R("mean_board_excess")} AS mean_board_excess FROM by_day""")
def limitup_cell_days(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(limitup.cell_days(_study(spark, sf)[1]), mean_return=4, mean_excess=4, mean_board_excess=4)


@query(f"""{_EVENTS}, frame AS (SELECT cohort, horizon, market, stock FROM (SELECT unnest(['TRAIN', 'EMBARGO', 'OUT_OF_SAMPLE']) AS cohort) CROSS JOIN {_HORIZONS} CROSS JOIN (SELECT unnest(['IMPROVING', 'WEAKENING']) AS market) CROSS JOIN (SELECT unnest(['IMPROVING', 'WEAKENING']) AS stock)),
p AS (SELECT cohort, horizon, market, stock, count(*) AS events, count(outcome) AS observed, count(*) FILTER (NOT mature) AS pending, count(*) FILTER (mature AND outcome IS NULL) AS missing_price, median(amount) AS median_amount, count(gap) AS open_observed, avg(gap) AS mean_gap,
  count(after) AS after_observed, avg(outcome) FILTER (after IS NOT NULL) AS mean_to_target, avg(after) AS mean_after_open, avg(outcome) AS mean_return, avg(excess) AS mean_excess FROM ev2 GROUP BY ALL),
d AS (SELECT cohort, horizon, market, stock, count(*) AS trigger_days, count(mean_excess) AS comparable_days, avg(mean_excess) AS equal_day_excess, avg(mean_board_excess) AS equal_day_board_excess, count(mean_board_excess) AS board_days, sum(mean_excess) AS s, min(mean_excess) AS a, max(mean_excess) AS b FROM by_day GROUP BY ALL),
g AS (SELECT cohort, horizon, market, stock, string_agg(gate || ':' || n, ',' ORDER BY gate) AS gates FROM (SELECT cohort, horizon, market, stock, gate, count(*) AS n FROM ev2 WHERE mature GROUP BY ALL) GROUP BY ALL)
SELECT cohort, horizon, market, stock, {", ".join(f"coalesce({c}, 0) AS {c}" for c in "events observed pending missing_price open_observed after_observed trigger_days comparable_days board_days".split())}, {R("median_amount", 2)} AS median_amount, gates,
 {", ".join(f"{R(c)} AS {c}" for c in "mean_gap mean_to_target mean_after_open mean_return mean_excess equal_day_excess equal_day_board_excess".split())}, CASE WHEN comparable_days >= 2 THEN {R("(s - b) / (comparable_days - 1)")} END AS least_without_one, CASE WHEN comparable_days >= 2 THEN {R("(s - a) / (comparable_days - 1)")} END AS most_without_one
FROM frame LEFT JOIN p USING (cohort, horizon, market, stock) LEFT JOIN d USING (cohort, horizon, market, stock) LEFT JOIN g USING (cohort, horizon, market, stock)""")
def limitup_cells(spark: SparkSession, sf: str) -> DataFrame:
    rows = limitup.cells(_study(spark, sf)[1], SPAN).drop("daily")
    text = F.array_join(F.transform(F.map_entries("gates"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    digits = dict.fromkeys("mean_gap mean_to_target mean_after_open mean_return mean_excess equal_day_excess equal_day_board_excess least_without_one most_without_one".split(), 4)
    return rounded(rows.withColumn("gates", text), median_amount=2, **digits)
