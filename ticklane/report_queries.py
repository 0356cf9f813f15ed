"""Queries over snapshots and trades of a session: closing snapshot and book, quotes by segment, the daily report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklane.functions import exprs as X
from ticklane.plans import book, flow, quality
from ticklane.registry import R, query, rounded
from ticklane.sources import domain as D

KEY, TIES = ["code", "i"], ["event_id"]
DAY = "CAST(i AS string)"
_SEGMENT = """CASE WHEN t >= 93000000 AND t < 100000000 THEN 1 WHEN t >= 100000000 AND t < 103000000 THEN 2 WHEN t >= 103000000 AND t <= 113000000 THEN 3
 WHEN t >= 130000000 AND t < 140000000 THEN 4 WHEN t >= 140000000 AND t <= 150000000 THEN 5 END"""
_CLOSING = f"""SELECT code, i, t AS close_time, last AS close, pre_close, volume AS shown_volume, amount AS shown_amount FROM ({D.SNAPSHOTS}) WHERE last > 0
 QUALIFY row_number() OVER (PARTITION BY code, i ORDER BY t DESC NULLS LAST, event_id DESC) = 1"""
_BOOK = f"""SELECT code, i, t AS book_time, list_sum([coalesce(q, 0.0) for q in bid_qty]) AS bid_depth, list_sum([coalesce(q, 0.0) for q in ask_qty]) AS ask_depth FROM ({D.SNAPSHOTS}) WHERE t < 145700000
 QUALIFY row_number() OVER (PARTITION BY code, i ORDER BY t DESC, event_id DESC) = 1"""
_FLOW = f"""SELECT code, i, sum(qty) AS volume, sum(amount) AS amount, sum(CASE side WHEN 'B' THEN amount WHEN 'S' THEN -amount ELSE 0.0 END) AS known_net, sum(CASE WHEN side IN ('B', 'S') THEN 0.0 ELSE amount END) AS unknown,
 count(*) AS trades, sum(CASE WHEN t BETWEEN 93000000 AND 113000000 OR t BETWEEN 130000000 AND 150000000 THEN amount ELSE 0.0 END) AS regular FROM ({D.PRINTS}) WHERE price > 0 AND qty > 0 AND side <> 'C' GROUP BY ALL"""
_REPORT = f"""SELECT *, net / nullif(amount, 0) AS net_ratio, amount / volume AS vwap, 100 * regular / nullif(amount, 0) AS coverage, (volume - shown_volume) / nullif(shown_volume, 0) AS volume_gap,
 (amount - shown_amount) / nullif(shown_amount, 0) AS amount_gap, (bid_depth - ask_depth) / nullif(bid_depth + ask_depth, 0) AS imbalance
 FROM (SELECT x.*, CASE WHEN unknown = 0 THEN known_net END AS net, close, pre_close, 100 * (close / pre_close - 1) AS ret, shown_volume, shown_amount, close_time, book_time, bid_depth, ask_depth
  FROM ({_FLOW}) x JOIN ({_CLOSING}) s USING (code, i) LEFT JOIN ({_BOOK}) b USING (code, i) WHERE pre_close > 0)"""
_LABEL = "CASE WHEN ret IS NULL OR net IS NULL THEN 'unknown' WHEN ret > 0 AND net > 0 THEN 'push' WHEN ret BETWEEN -3 AND 0 AND net > 0 THEN 'support' WHEN ret BETWEEN -1 AND 3 AND net < 0 THEN 'passive' WHEN ret > 0 AND net < 0 THEN 'diverge' ELSE 'other' END"


def report(spark: SparkSession, sf: str) -> DataFrame:
    return book.report_facts(D.prints(spark, sf), D.snapshots(spark, sf), KEY, TIES)


@query(_CLOSING)
def closing_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return book.closing_snapshot(D.snapshots(spark, sf), KEY, TIES)


@query(_BOOK)
def closing_book(spark: SparkSession, sf: str) -> DataFrame:
    return book.closing_book(D.snapshots(spark, sf), KEY, TIES)


@query(f"""SELECT code, i, close, pre_close, {R("ret")} AS ret, {R("amount", 2)} AS amount, volume, {R("net", 2)} AS net, {R("known_net", 2)} AS known_net, {R("unknown", 2)} AS unknown, trades, {R("net_ratio")} AS net_ratio, {R("vwap")} AS vwap,
 {R("coverage", 2)} AS coverage, {R("volume_gap")} AS volume_gap, {R("amount_gap")} AS amount_gap, close_time, book_time, bid_depth, ask_depth, {R("imbalance")} AS imbalance FROM ({_REPORT})""")
def report_facts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(report(spark, sf), ret=4, amount=2, net=2, known_net=2, unknown=2, net_ratio=4, vwap=4, coverage=2, volume_gap=4, amount_gap=4, imbalance=4)


@query(f"""WITH r AS ({_REPORT}), n AS (SELECT s_suppkey AS code, s_name AS name FROM supplier WHERE s_nationkey > 3)
SELECT r.code, r.i, coalesce(n.name, 'no name') AS name, {_LABEL} AS label, {R("r.ret")} AS ret, {R("r.net", 2)} AS net, {R("100 * (a.close / r.close - 1)")} AS after_1, {R("100 * (b.close / r.close - 1)")} AS after_3
FROM (SELECT * FROM r) r LEFT JOIN (SELECT code, i, close FROM r) a ON a.code = r.code AND a.i = r.i + 1 LEFT JOIN (SELECT code, i, close FROM r) b ON b.code = r.code AND b.i = r.i + 3 LEFT JOIN n ON n.code = r.code""")
def report_history(spark: SparkSession, sf: str) -> DataFrame:
    names = D.table(spark, sf, "supplier").where("s_nationkey > 3").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"))
    return rounded(book.named(book.history(report(spark, sf)), names, "no name"), ret=4, net=2, after_1=4, after_3=4)


@query(f"""SELECT i, count(*) AS n, {R("sum(amount)", 2)} AS amount, CASE WHEN count(*) = count(net) THEN {R("sum(net)", 2)} END AS net, count(*) FILTER (net IS NULL) AS unknown_stocks, count(*) FILTER (ret > 0) AS up, count(*) FILTER (ret < 0) AS down,
 {R("100 * quantile_cont(abs(volume_gap), 0.95)")} AS volume_gap_95, {R("100 * quantile_cont(abs(amount_gap), 0.95)")} AS amount_gap_95 FROM ({_REPORT}) GROUP BY i""")
def report_market(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(book.market_by_session(report(spark, sf)), amount=2, net=2, volume_gap_95=4, amount_gap_95=4)


@query(f"""WITH a AS (SELECT code, i, amount, known_net FROM ({_FLOW})), b AS (SELECT code, i, shown_amount AS amount, shown_amount / 2 AS known_net FROM ({_CLOSING})),
j AS (SELECT coalesce(a.code, b.code) AS code, coalesce(a.i, b.i) AS i, a.amount AS am, b.amount, a.known_net AS km, b.known_net, a.code IS NOT NULL AND b.code IS NOT NULL AS paired FROM a FULL JOIN b ON a.code = b.code AND a.i = b.i)
SELECT code, i, {R("am", 2)} AS amount_mine, {R("amount", 2)} AS amount, {R("km", 2)} AS known_net_mine, {R("known_net", 2)} AS known_net, paired AND abs(am - amount) <= greatest(2.0, abs(amount) * 1e-9) AS amount_agrees,
 paired AND abs(km - known_net) <= greatest(2.0, abs(known_net) * 1e-9) AS known_net_agrees FROM j""")
def flow_against_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    kept = D.prints(spark, sf).where(X.traded("price", "qty") & X.not_cancelled("side"))
    mine = kept.groupBy(*KEY).agg(F.sum("amount").alias("amount"), X.known_net().alias("known_net"))
    shown = book.closing_snapshot(D.snapshots(spark, sf), KEY, TIES).select(*KEY, F.col("shown_amount").alias("amount"), (F.col("shown_amount") / 2).alias("known_net"))
    return rounded(book.reconciled(mine, shown, KEY, ["amount", "known_net"]), amount_mine=2, amount=2, known_net_mine=2, known_net=2)


_SEEN = f"SELECT *, {_SEGMENT} AS segment FROM ({D.SNAPSHOTS})"
_GATE = f"""SELECT code, i, CAST(sum(wrong) AS BIGINT) AS bad_dates, CAST(sum(n) FILTER (clock IS NOT NULL) AS BIGINT) AS seen, count(*) FILTER (clock IS NOT NULL AND n > 1) AS repeated
 FROM (SELECT code, i, CASE WHEN segment IS NOT NULL THEN t END AS clock, count(*) FILTER (trade_day <> CAST(i AS VARCHAR)) AS wrong, count(*) AS n FROM ({_SEEN}) GROUP BY ALL) GROUP BY ALL"""


@query(f"SELECT code, i, bad_dates, coalesce(seen, 0) AS observed, CASE WHEN bad_dates > 0 THEN 'INVALID_DATE' WHEN repeated > 0 THEN 'DUPLICATE_TIME' ELSE 'OPEN' END AS gate FROM ({_GATE})")
def quote_gate(spark: SparkSession, sf: str) -> DataFrame:
    return book.quote_gate(D.snapshots(spark, sf), KEY, F.expr(DAY))


@query(f"""WITH s AS (SELECT code, i, segment, t, bid[1] AS b, ask[1] AS a, bid_qty[1] AS p, ask_qty[1] AS q, bid, ask, bid_qty, ask_qty FROM ({_SEEN}) SEMI JOIN (SELECT code, i FROM ({_GATE}) WHERE bad_dates = 0 AND repeated = 0) USING (code, i) WHERE segment IS NOT NULL),
v AS (SELECT *, coalesce(b > 0 AND a >= b, false) AS valid, coalesce(b > 0 AND a >= b AND p >= 0 AND q >= 0 AND p + q > 0, false) AS deep,
 CASE WHEN a > b THEN a - b ELSE least(b - bid[2], ask[2] - a) END AS scale,
 b > 0 AND a >= b AND list_bool_and([x > 0 for x in bid]) AND list_count(bid_qty) = 10 AND list_count(ask_qty) = 10 AND list_bool_and([bid[k] > bid[k + 1] AND ask[k] < ask[k + 1] for k in range(1, 10)]) AND list_sum(bid_qty) + list_sum(ask_qty) > 0 AS laddered FROM s),
x AS (SELECT *, CASE WHEN valid THEN (b + a) / 20000 END AS mid, CASE WHEN valid THEN t END AS clock, lag(deep) OVER w AS dp, lag(b) OVER w AS bp, lag(p) OVER w AS pp,
 CASE WHEN laddered THEN 100 * (list_sum(bid_qty) - list_sum(ask_qty)) / (list_sum(bid_qty) + list_sum(ask_qty)) END AS ten,
 CASE WHEN laddered THEN list_sum([bid_qty[k] / (1 + (b - bid[k]) / scale) for k in range(1, 11)]) END AS wb, CASE WHEN laddered THEN list_sum([ask_qty[k] / (1 + (ask[k] - a) / scale) for k in range(1, 11)]) END AS wa
 FROM v WINDOW w AS (PARTITION BY code, i, segment ORDER BY t)),
g AS (SELECT code, i, segment, count(*) AS observed, count(*) FILTER (valid) AS valid, min(clock) AS first_time, max(clock) AS last_time, arg_min(mid, clock) AS first_mid, arg_max(mid, clock) AS last_mid, min(mid) AS lo,
 median(20000 * (a - b) / (a + b)) FILTER (valid) AS spread, median(100 * (p - q) / (p + q)) FILTER (deep) AS top_imbalance, count(*) FILTER (deep) AS depth_valid, median(ten) FILTER (deep) AS ten_imbalance, median(100 * (wb - wa) / (wb + wa)) FILTER (deep) AS ten_weighted,
 median(10000 * (a - b) * (p - q) / ((a + b) * (p + q))) FILTER (deep) AS microprice, count(ten) FILTER (deep) AS ten_valid, count(*) FILTER (deep AND dp AND bp = b) AS same_bid, count(*) FILTER (deep AND dp AND bp = b AND p > pp) AS same_bid_rise FROM x GROUP BY ALL)
SELECT code, i, segment, observed, valid, first_time, last_time, {R("first_mid", 6)} AS first_mid, {R("last_mid", 6)} AS last_mid, CASE WHEN valid >= 2 THEN {R("lo", 6)} END AS low, {R("spread")} AS spread, {R("top_imbalance")} AS top_imbalance, depth_valid,
 {R("ten_imbalance")} AS ten_imbalance, {R("ten_weighted")} AS ten_weighted, {R("microprice")} AS microprice, ten_valid, same_bid, same_bid_rise, CASE WHEN valid >= 2 THEN {R("100 * (last_mid / first_mid - 1)")} END AS change, CASE WHEN valid >= 2 THEN {R("100 * (last_mid / lo - 1)")} END AS recovery FROM g""")
def quote_path(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(book.quote_path(D.snapshots(spark, sf), KEY, F.expr(DAY)), first_mid=6, last_mid=6, low=6, spread=4, top_imbalance=4, ten_imbalance=4, ten_weighted=4, microprice=4, change=4, recovery=4)


@query(f"""SELECT code, {_SEGMENT} AS segment, {R("sum(amount)", 2)} AS amount, sum(qty) AS qty, {R("sum(CASE side WHEN 'B' THEN amount WHEN 'S' THEN -amount ELSE 0.0 END)", 2)} AS known, {R("sum(CASE WHEN side IN ('B', 'S') THEN 0.0 ELSE amount END)", 2)} AS unknown, count(*) AS trades,
 CASE WHEN sum(CASE WHEN side IN ('B', 'S') THEN 0.0 ELSE amount END) = 0 THEN {R("sum(CASE side WHEN 'B' THEN amount WHEN 'S' THEN -amount ELSE 0.0 END)", 2)} END AS net, {R("sum(amount) / sum(qty)")} AS vwap
 FROM ({D.PRINTS}) WHERE price > 0 AND qty > 0 AND side <> 'C' AND {_SEGMENT} IS NOT NULL GROUP BY ALL""")
def session_segments(spark: SparkSession, sf: str) -> DataFrame:
    kept = D.prints(spark, sf).where(X.traded("price", "qty") & X.not_cancelled("side")).withColumn("segment", X.segment("t")).where("segment IS NOT NULL")
    return rounded(flow.segments(kept, ["code", "segment"]), amount=2, known=2, unknown=2, net=2, vwap=4)


@query(f"""SELECT code, count(*) AS rows, count(*) FILTER (trade_day IS DISTINCT FROM '2') AS bad_date, count(*) FILTER (t IS NULL OR t < 0 OR t >= 240000000 OR (t // 100000) % 100 >= 60 OR (t // 1000) % 100 >= 60) AS bad_clock,
 count(*) FILTER (t = 0) AS zero_clock, count(*) FILTER (t > 150000000) AS after_close, min(t) AS first, max(t) AS last FROM ({D.SNAPSHOTS}) WHERE i = 2 GROUP BY code""")
def clock_profile(spark: SparkSession, sf: str) -> DataFrame:
    return quality.clock_profile(D.snapshots(spark, sf).where("i = 2"), "2")


@query(f"""SELECT i, count(*) AS trades, {R("sum(amount)", 2)} AS amount, {R("sum(CASE side WHEN 'B' THEN amount WHEN 'S' THEN -amount ELSE 0.0 END)", 2)} AS known_net, {R("sum(CASE WHEN side IN ('B', 'S') THEN 0.0 ELSE amount END)", 2)} AS unknown,
 {R("sum(CASE WHEN side IN ('B', 'S') THEN 0.0 ELSE amount END) / nullif(sum(amount), 0)", 6)} AS unknown_rate, count(*) FILTER (side IN ('B', 'S') AND NOT coalesce(pid > 0, false)) AS bad_ids FROM ({D.PRINTS}) WHERE price > 0 AND qty > 0 AND side <> 'C' GROUP BY i""")
def direction_totals(spark: SparkSession, sf: str) -> DataFrame:
    kept = D.prints(spark, sf).where(X.traded("price", "qty") & X.not_cancelled("side"))
    return rounded(quality.direction_totals(kept, ["i"]), amount=2, known_net=2, unknown=2, unknown_rate=6)


@query(f"""SELECT code, i, event_id, ((t // 10000000 * 60 + t // 100000 % 100) * 60 + t // 1000 % 100) * 1000 + t % 1000 AS ms, CAST(t // 10000000 AS BIGINT) AS hour FROM ({D.SNAPSHOTS}) WHERE t IS NOT NULL""")
def snapshot_clocks(spark: SparkSession, sf: str) -> DataFrame:
    return D.snapshots(spark, sf).where("t IS NOT NULL").select("code", "i", "event_id", X.ms_of_day("t").alias("ms"), F.expr("t div 10000000").alias("hour"))


_CODES = "SELECT CASE c_custkey % 8 WHEN 0 THEN '300' WHEN 1 THEN '301' WHEN 2 THEN '302' WHEN 3 THEN '688' WHEN 4 THEN '689' WHEN 5 THEN '600' WHEN 6 THEN '000' ELSE '430' END || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || CASE WHEN c_custkey % 8 IN (3, 4, 5) THEN '.SH' ELSE '.SZ' END AS code FROM customer"


@query(f"""SELECT regexp_matches(code, '{X.UNIVERSE}') AS inside, CASE WHEN left(code, 3) IN ('300', '301', '302') THEN 'GEM' WHEN left(code, 3) IN ('688', '689') THEN 'STAR' ELSE 'MAIN' END AS board, count(*) AS n FROM ({_CODES}) GROUP BY ALL""")
def universe_boards(spark: SparkSession, sf: str) -> DataFrame:
    k, first = F.col("c_custkey"), F.element_at(F.array(*map(F.lit, ("300", "301", "302", "688", "689", "600", "000", "430"))), (F.col("c_custkey") % 8 + 1).cast("int"))
    codes = D.table(spark, sf, "customer").select(F.concat(first, F.lpad((k % 1000).cast("string"), 3, "0"), F.when((k % 8).isin(3, 4, 5), ".SH").otherwise(".SZ")).alias("code"))
    return codes.groupBy(F.col("code").rlike(X.UNIVERSE).alias("inside"), X.board("code").alias("board")).agg(F.count("*").alias("n"))
