"""Queries of whole securities: the checks of a deep look, and the published cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklane.functions import exprs as X
from ticklane.plans import cards, flow
from ticklane.queries import LABELLED
from ticklane.registry import R, query, rounded
from ticklane.report_queries import _FLOW, _SEGMENT
from ticklane.sources import domain as D
from ticklane.sources import files

BOUNDS = (100, 300, 600)
_BUCKET = "CASE WHEN abs(a) < 100 THEN 'small' WHEN abs(a) < 300 THEN 'medium' WHEN abs(a) < 600 THEN 'large' ELSE 'huge' END"
_KEPT = f"SELECT * FROM ({D.PRINTS}) WHERE price > 0 AND qty > 0 AND side <> 'C'"
_ORDERS = """SELECT user_id AS code, CAST(dayofyear(ts) // 7 AS BIGINT) AS i, CASE WHEN event_id % 307 = 0 THEN 'other' ELSE CAST(dayofyear(ts) // 7 AS VARCHAR) END AS trade_day, CASE WHEN event_id % 211 <> 0 THEN CAST(event_id % 90 * 10 AS DOUBLE) END AS qty,
 CASE event_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'U' ELSE 'A' END AS kind, CASE WHEN event_id % 3 = 0 THEN 'B' WHEN event_id % 3 = 1 THEN 'S' END AS side FROM events WHERE event_type IN ('click', 'error')"""
_PARENTS = f"""SELECT code, i, bucket, CAST(floor({R("sum(s)", 6)} + 0.5) AS BIGINT) AS net, count(*) AS n FROM (
 SELECT code, i, {_BUCKET} AS bucket, CASE side WHEN 'B' THEN a ELSE -a END AS s FROM (SELECT code, i, side, pid, sum(amount) AS a FROM ({_KEPT}) WHERE side IN ('B', 'S') AND pid > 0 GROUP BY ALL)
 UNION ALL SELECT code, i, 'no id', CASE side WHEN 'B' THEN amount ELSE -amount END FROM ({_KEPT}) WHERE side IN ('B', 'S') AND NOT coalesce(pid > 0, false)) GROUP BY ALL"""


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    e, i = F.col("event_id"), F.expr("CAST(dayofyear(ts) div 7 AS long)")
    x = D.table(spark, sf, "events").where("event_type IN ('click', 'error')")
    return x.select(
        F.col("user_id").alias("code"), i.alias("i"), F.when(e % 307 == 0, "other").otherwise(i.cast("string")).alias("trade_day"), F.when(e % 211 != 0, (e % 90 * 10).cast("double")).alias("qty"),
        F.when(e % 4 == 0, " ").when(e % 4 == 1, "U").otherwise("A").alias("kind"), F.when(e % 3 == 0, "B").when(e % 3 == 1, "S").alias("side"))


def _kept(spark: SparkSession, sf: str) -> DataFrame:
    return files.stored(D.prints(spark, sf).where(X.traded("price", "qty") & X.not_cancelled("side")))


@query(f"""WITH f AS ({_FLOW}), r AS (SELECT code, i, CASE WHEN code % 7 = 3 THEN amount + 100 ELSE amount + 1 END AS amount, CASE WHEN (unknown > 0) = ((code + i) % 11 <> 4) THEN NULL WHEN code % 13 = 5 THEN known_net - 3 ELSE known_net END AS net FROM f
  UNION ALL SELECT code + 1000000000, i, amount, known_net FROM f WHERE code % 10 = 1),
b AS (SELECT code, i, count(*) FILTER (trade_day <> CAST(i AS VARCHAR)) AS bad_days FROM ({_KEPT}) GROUP BY ALL), p AS (SELECT code, i, count(*) AS parents, CAST(sum(net) AS BIGINT) AS parents_net FROM ({_PARENTS}) GROUP BY ALL),
o AS (SELECT code, i, count(*) AS order_rows, count(*) FILTER (qty IS NULL OR trade_day <> CAST(i AS VARCHAR)) AS bad_orders FROM ({_ORDERS}) GROUP BY ALL),
j AS (SELECT r.code, r.i, trades AS trade_rows, bad_days, r.amount, f.amount AS amount_mine, r.net, CASE WHEN unknown = 0 THEN known_net END AS net_mine, known_net, unknown, 100 * nullif(regular, 0) / amount_mine AS coverage, parents, parents_net, order_rows, bad_orders
  FROM r LEFT JOIN f ON f.code = r.code AND f.i = r.i LEFT JOIN b ON b.code = r.code AND b.i = r.i LEFT JOIN p ON p.code = r.code AND p.i = r.i LEFT JOIN o ON o.code = r.code AND o.i = r.i)
SELECT code, i, trade_rows, bad_days, {R("amount", 2)} AS amount, {R("amount_mine", 2)} AS amount_mine, {R("net", 2)} AS net, {R("net_mine", 2)} AS net_mine, {R("known_net", 2)} AS known_net, {R("unknown", 2)} AS unknown, {R("coverage", 2)} AS coverage, parents, parents_net, order_rows, bad_orders,
 CASE WHEN trade_rows IS NULL THEN 'NO_TRADES' WHEN bad_days > 0 THEN 'BAD_DAY' WHEN abs(amount - amount_mine) > greatest(2.0, 1e-9 * abs(amount)) THEN 'AMOUNT_DIFFERS' WHEN (net IS NULL) <> (net_mine IS NULL) THEN 'NET_STATUS_DIFFERS'
  WHEN abs(net - net_mine) > greatest(2.0, 1e-9 * abs(net)) THEN 'NET_DIFFERS' WHEN abs(coalesce(parents_net, 0) - known_net) > coalesce(parents, 0) + 2 THEN 'PARENTS_UNBALANCED' WHEN order_rows IS NULL THEN 'NO_ORDERS' WHEN bad_orders > 0 THEN 'BAD_ORDERS' ELSE 'PUBLISHED' END AS status FROM j""")
def deep_dive(spark: SparkSession, sf: str) -> DataFrame:
    """Every security's week against a report that is off here and there."""
    trades, code, i = _kept(spark, sf), F.col("code"), F.col("i")
    sums = trades.groupBy("code", "i").agg(F.sum("amount").alias("amount"), X.known_net().alias("known_net"), X.unknown_amount().alias("unknown"))
    net = F.when((F.col("unknown") > 0) == ((code + i) % 11 != 4), None).when(code % 13 == 5, F.col("known_net") - 3).otherwise(F.col("known_net"))
    reported = sums.select("code", "i", F.when(code % 7 == 3, F.col("amount") + 100).otherwise(F.col("amount") + 1).alias("amount"), net.alias("net"))
    reported = reported.unionByName(sums.where("code % 10 = 1").select((code + 1000000000).alias("code"), "i", "amount", F.col("known_net").alias("net")))
    rows = cards.deep_dive(trades, _orders(spark, sf), reported, ["code", "i"], F.col("i").cast("string"), BOUNDS)
    return rounded(rows, amount=2, amount_mine=2, net=2, net_mine=2, known_net=2, unknown=2, coverage=2)


def _dec(x: str) -> str:
    return f"coalesce(CAST(CAST({R(x)} AS DECIMAL(18, 4)) AS VARCHAR), 'null')"


def _int(x: str) -> str:
    return f"coalesce(CAST(CAST(floor({R(x, 6)} + 0.5) AS BIGINT) AS VARCHAR), 'null')"


# SQL writes the JSON itself, so that the text is held against Spark's
_CARD_FACTS = f"SELECT code, i, label, ret, close, amount, net FROM ({LABELLED})"
_LINES = f"""SELECT l_suppkey AS code, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS i, CAST((9 + l_partkey % 7) * 10000000 + l_partkey % 60 * 100000 AS BIGINT) AS t, amount, qty, side, pid FROM (SELECT *, l_extendedprice AS amount, l_quantity AS qty, l_orderkey % 5 * l_orderkey AS pid,
 CASE WHEN l_linenumber = 7 AND l_discount <= 0.01 THEN '?' WHEN l_linenumber = 1 AND l_tax = 0 THEN 'C' WHEN l_returnflag = 'A' THEN 'B' WHEN l_returnflag = 'R' THEN 'S' WHEN l_linestatus = 'F' THEN 'B' ELSE 'S' END AS side FROM lineitem) WHERE side <> 'C' AND amount > 0 AND qty > 0"""


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("l_partkey")
    x = D.table(spark, sf, "lineitem")
    side = (
        F.when((F.col("l_linenumber") == 7) & (F.col("l_discount") <= 0.01), "?").when((F.col("l_linenumber") == 1) & (F.col("l_tax") == 0), "C")
        .when(F.col("l_returnflag") == "A", "B").when(F.col("l_returnflag") == "R", "S").when(F.col("l_linestatus") == "F", "B").otherwise("S")
    )
    rows = x.select(
        F.col("l_suppkey").alias("code"), D.month_index(F.col("l_shipdate")).alias("i"), ((9 + p % 7) * 10000000 + p % 60 * 100000).cast("long").alias("t"), F.col("l_extendedprice").alias("amount"), F.col("l_quantity").alias("qty"),
        side.alias("side"), (F.col("l_orderkey") % 5 * F.col("l_orderkey")).alias("pid"))
    return files.stored(rows.where("side <> 'C' AND amount > 0 AND qty > 0"))


_KINDS = """SELECT l_suppkey AS code, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS i, CAST(l_partkey % 3 AS VARCHAR) AS kind, l_returnflag AS side, count(*) AS r, sum(l_quantity) AS q FROM lineitem GROUP BY ALL"""


@query(f"""WITH f AS ({_CARD_FACTS}), x AS MATERIALIZED ({_LINES}),
sg AS (SELECT code, i, {_SEGMENT} AS segment, sum(amount) AS a, CASE WHEN count(*) FILTER (side NOT IN ('B', 'S')) = 0 THEN sum(CASE side WHEN 'B' THEN amount ELSE -amount END) END AS n, sum(amount) / sum(qty) AS v FROM x WHERE {_SEGMENT} IS NOT NULL GROUP BY ALL),
sj AS (SELECT code, i, string_agg('{{"s":' || segment || ',"a":' || {_int("a")} || ',"n":' || {_int("n")} || ',"v":' || {_dec("v")} || '}}', ',' ORDER BY segment) AS t FROM sg GROUP BY ALL),
pa AS (SELECT code, i, bucket, sum(s) AS net, count(*) AS c FROM (SELECT code, i, CASE WHEN a < 20000 THEN 'small' WHEN a < 50000 THEN 'medium' WHEN a < 80000 THEN 'large' ELSE 'huge' END AS bucket, CASE side WHEN 'B' THEN a ELSE -a END AS s
  FROM (SELECT code, i, side, pid, sum(amount) AS a FROM x WHERE side IN ('B', 'S') AND pid > 0 GROUP BY ALL) UNION ALL SELECT code, i, 'no id', CASE side WHEN 'B' THEN amount ELSE -amount END FROM x WHERE side IN ('B', 'S') AND NOT pid > 0) GROUP BY ALL),
pj AS (SELECT code, i, string_agg('{{"b":"' || bucket || '","n":' || {_int("net")} || ',"c":' || c || '}}', ',' ORDER BY list_position(['small', 'medium', 'large', 'huge', 'no id'], bucket)) AS t FROM pa GROUP BY ALL),
oj AS (SELECT code, i, string_agg('{{"t":"' || kind || '","s":"' || side || '","r":' || r || ',"q":' || {_int("q")} || '}}', ',' ORDER BY kind, side) AS t FROM ({_KINDS}) GROUP BY ALL),
hj AS (SELECT e.code, e.i, string_agg('{{"i":' || h.i || ',"label":"' || h.label || '","ret":' || {_dec("h.ret")} || ',"net":' || {_int("h.net")} || '}}', ',' ORDER BY h.i) AS t FROM f e JOIN f h ON h.code = e.code AND h.i BETWEEN e.i - 6 AND e.i GROUP BY ALL),
c AS (SELECT f.code, f.i, '{{"code":' || f.code || ',"i":' || f.i || ',"label":"' || label || '","ret":' || {_dec("ret")} || ',"close":' || {_dec("close")} || ',"amount":' || {_int("amount")} || ',"net":' || {_int("net")} || ',"direction":"' || CASE WHEN net IS NULL THEN 'UNKNOWN' ELSE 'AVAILABLE' END
  || '","segments":[' || coalesce(sj.t, '') || '],"parents":[' || coalesce(pj.t, '') || '],"orders":[' || coalesce(oj.t, '') || '],"history":[' || hj.t || ']}}' AS card FROM f LEFT JOIN sj USING (code, i) LEFT JOIN pj USING (code, i) LEFT JOIN oj USING (code, i) LEFT JOIN hj USING (code, i))
SELECT code, i, card, sha256(card) AS card_id FROM c""")
def security_cards(spark: SparkSession, sf: str) -> DataFrame:
    """The nested card of every security's session, as text."""
    facts = flow.labelled(files.stored(D.facts(spark, sf)))
    kinds = D.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("code"), D.month_index(F.col("l_shipdate")).alias("i"), (F.col("l_partkey") % 3).alias("kind"), F.col("l_returnflag").alias("side"), F.col("l_quantity").alias("qty"))
    return cards.cards(facts, _lines(spark, sf), kinds, (20_000, 50_000, 80_000))
