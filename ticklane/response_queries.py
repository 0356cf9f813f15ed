"""Queries of quotes and displayed size by security, day and part of the session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklane.plans import response
from ticklane.queries import recovery_sql
from ticklane.registry import R, query, rounded
from ticklane.sources import domain as D
from ticklane.sources import files

#: Half an hour: a code has a quote in ten minutes or so here.
LONGEST = 1_800_000
_MS = "(((t // 10000000 * 60 + t // 100000 % 100) * 60 + t // 1000 % 100) * 1000 + t % 1000)"
_GOOD = "(t >= 0 AND t // 10000000 < 24 AND t // 100000 % 100 < 60 AND t // 1000 % 100 < 60)"
_PART = "CASE WHEN t >= 93000000 AND t < 100000000 THEN 1 WHEN t >= 100000000 AND t < 103000000 THEN 2 WHEN t >= 103000000 AND t < 113000001 THEN 3 WHEN t >= 130000000 AND t < 140000000 THEN 4 WHEN t >= 140000000 AND t < 145700000 THEN 5 END"


def _both(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    x = files.stored(D.tape(spark, sf))  # the feed's table; clocks are long expressions here
    return x.where("kind = 'trade'").select("code", "day", "t", "price", "qty", "side"), x.where("kind = 'quote'").select("code", "day", "trade_day", "t", "bid", "ask")


# each interval's trades are looked up by a join, not by numbering
@query(f"""WITH x AS MATERIALIZED ({D.TAPE}), tr AS (SELECT code, day, t, {_MS} AS ms, price * qty AS amount, side, {_GOOD} AS good, coalesce(price > 0 AND qty > 0, false) AS print FROM x WHERE kind = 'trade'),
q0 AS (SELECT code, day, trade_day, t, {_PART} AS part, bid, ask FROM x WHERE kind = 'quote'),
q AS (SELECT code, day, part, {_MS} AS ms, CASE WHEN bid > 0 AND ask >= bid THEN (bid + ask) / 20000 END AS mid FROM q0 WHERE part IS NOT NULL),
keys AS (SELECT DISTINCT code, day FROM x), dup AS (SELECT code, day, max(n) AS n FROM (SELECT code, day, ms, count(*) AS n FROM q GROUP BY ALL) GROUP BY ALL),
tg AS (SELECT code, day, bool_and(good) AS good, bool_and(print) AS print FROM tr GROUP BY ALL),
qg AS (SELECT code, day, bool_and(coalesce(trade_day = CAST(day AS VARCHAR), false)) AS dated, bool_and(t IS NOT NULL AND (part IS NULL OR {_GOOD})) AS timed FROM q0 GROUP BY ALL),
g AS (SELECT code, day, CASE WHEN NOT coalesce(tg.good, true) THEN 'INVALID_TRADE_CLOCK' WHEN NOT coalesce(print, true) THEN 'INVALID_TRADE_PRINT' WHEN NOT coalesce(dated, true) THEN 'INVALID_QUOTE_DATE' WHEN NOT coalesce(timed, true) THEN 'INVALID_QUOTE_CLOCK' WHEN n > 1 THEN 'DUPLICATE_QUOTE_TIME' END AS fault
  FROM keys LEFT JOIN tg USING (code, day) LEFT JOIN qg USING (code, day) LEFT JOIN dup USING (code, day)),
w AS (SELECT *, lead(ms) OVER o AS e, lead(mid) OVER o AS em, lead(ms, 2) OVER o AS f, lead(mid, 2) OVER o AS fm FROM q JOIN g USING (code, day) WHERE fault IS NULL WINDOW o AS (PARTITION BY code, day, part ORDER BY ms)),
s AS (SELECT w.code, w.day, w.part, w.ms, any_value(e) AS e, any_value(mid) AS mid, any_value(em) AS em, any_value(f) AS f, any_value(fm) AS fm, coalesce(sum(CASE side WHEN 'B' THEN amount WHEN 'S' THEN -amount ELSE 0.0 END), 0.0) AS flow,
  coalesce(sum(CASE WHEN side IN ('B', 'S') THEN 0.0 ELSE amount END), 0.0) AS un, coalesce(sum(amount), 0.0) AS traded FROM w LEFT JOIN tr ON tr.code = w.code AND tr.day = w.day AND tr.ms > w.ms AND tr.ms < w.e GROUP BY w.code, w.day, w.part, w.ms),
st AS (SELECT *, CASE WHEN e IS NULL THEN NULL WHEN e - ms > {LONGEST} THEN 'gap' WHEN mid IS NULL OR em IS NULL THEN 'invalid' WHEN un > 1e-7 THEN 'unknown' WHEN traded <= 1e-7 OR abs(flow) <= greatest(1e-7, traded * 1e-10) THEN 'zero' ELSE 'flow' END AS st FROM s),
al AS (SELECT *, CASE WHEN st = 'flow' THEN sign(flow) * 10000 * (em / mid - 1) END AS a, CASE WHEN st = 'flow' AND fm IS NOT NULL AND f - e <= {LONGEST} THEN sign(flow) * 10000 * (fm / em - 1) END AS b FROM st),
sums AS (SELECT code, day, part, count(*) AS quotes, count(st) AS pairs, {", ".join(f"count(*) FILTER (st = '{s}') AS {s}_pairs" for s in ("gap", "invalid", "unknown", "zero", "flow"))}, median(a) AS median_bps, avg(a) AS mean_bps,
  100 * avg(CASE WHEN a > 0 THEN 1.0 WHEN a IS NOT NULL THEN 0.0 END) AS positive_share, count(*) FILTER (abs(a) < 1e-9) AS zero_moves, count(b) AS next_pairs, median(b) AS next_median_bps, avg(b) AS next_mean_bps FROM al GROUP BY ALL),
fr AS (SELECT code, day, fault, CAST(unnest(CASE WHEN fault IS NULL THEN [1, 2, 3, 4, 5] ELSE [NULL] END) AS INT) AS part FROM g)
SELECT code, day, part, coalesce(fault, CASE WHEN max(coalesce(flow_pairs, 0)) OVER (PARTITION BY code, day) > 0 THEN 'AVAILABLE' ELSE 'NO_COMPARABLE_PAIRS' END) AS status,
 {", ".join(f"CASE WHEN fault IS NULL THEN coalesce({c}, 0) END AS {c}" for c in "quotes pairs gap_pairs invalid_pairs unknown_pairs zero_pairs flow_pairs zero_moves next_pairs".split())},
 {", ".join(f"{R(c)} AS {c}" for c in "median_bps mean_bps positive_share next_median_bps next_mean_bps".split())} FROM fr LEFT JOIN sums USING (code, day, part)""")
def quote_response(spark: SparkSession, sf: str) -> DataFrame:
    digits = dict.fromkeys("median_bps mean_bps positive_share next_median_bps next_mean_bps".split(), 4)
    return rounded(response.quote_response(*_both(spark, sf), LONGEST), **digits)


_SEGMENT = "CASE WHEN t >= 93000000 AND t < 100000000 THEN 1 WHEN t >= 100000000 AND t < 103000000 THEN 2 WHEN t >= 103000000 AND t <= 113000000 THEN 3 WHEN t >= 130000000 AND t < 140000000 THEN 4 WHEN t >= 140000000 AND t <= 150000000 THEN 5 END"


@query(f"""WITH RECURSIVE book AS (SELECT code, day, t, {_MS} AS ms, {_GOOD} AS good, side, price, qty FROM (SELECT code, day, t, 'bid' AS side, bid AS price, bid_qty AS qty FROM ({D.TAPE}) WHERE kind = 'quote' UNION ALL SELECT code, day, t, 'ask', ask, ask_qty FROM ({D.TAPE}) WHERE kind = 'quote')),
parted AS (SELECT *, {_SEGMENT} AS part FROM book), rows AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY code, day, side, part ORDER BY ms, price NULLS FIRST, qty NULLS FIRST) AS n FROM parted WHERE part IS NOT NULL AND good),
gates AS (SELECT code, day, side, part, bool_and(good) AS good FROM parted WHERE part IS NOT NULL GROUP BY ALL), {recovery_sql("SELECT * FROM rows", "code, day, side, part")}
SELECT code, day, side, part, CASE WHEN NOT good THEN 'INVALID_CLOCK' WHEN pairs > 0 THEN 'OBSERVED' ELSE 'NO_COMPARABLE' END AS status, {", ".join(f"CASE WHEN good THEN {c} END AS {c}" for c in ("pairs", "declines", "recovered", "censored"))}, CASE WHEN good THEN median_time END AS median_ms FROM gates LEFT JOIN folded USING (code, day, side, part)""")
def recovery_by_part(spark: SparkSession, sf: str) -> DataFrame:
    x = files.stored(D.tape(spark, sf).where("kind = 'quote'"))
    book = x.select("code", "day", "t", F.lit("bid").alias("side"), F.col("bid").alias("price"), F.col("bid_qty").alias("qty")).unionByName(x.select("code", "day", "t", F.lit("ask").alias("side"), F.col("ask").alias("price"), F.col("ask_qty").alias("qty")))
    return response.recovery_by_part(book)
