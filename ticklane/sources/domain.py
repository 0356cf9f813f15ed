"""The harness tables seen as trades, bars, quotes and orders, with DuckDB SQL for the same views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklane.functions import exprs as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month_index(c) -> F.Column:
    return (F.year(c) * 12 + F.month(c)).cast("long")


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades: code, session (month), i (month number), price, qty, amount, side (B, S, C or ?), pid, trade_id."""
    x = table(spark, sf_dir, "lineitem")
    side = (
        F.when((F.col("l_linenumber") == 7) & (F.col("l_discount") <= 0.01), "?").when((F.col("l_linenumber") == 1) & (F.col("l_tax") == 0), "C")
        .when(F.col("l_returnflag") == "A", "B").when(F.col("l_returnflag") == "R", "S").when(F.col("l_linestatus") == "F", "B").otherwise("S")
    )
    return x.select(
        F.col("l_suppkey").alias("code"), F.trunc(F.to_date("l_shipdate"), "month").alias("session"), month_index(F.col("l_shipdate")).alias("i"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("amount"),
        side.alias("side"), F.col("l_orderkey").alias("pid"), F.col("l_linenumber").cast("long").alias("trade_id"),
    )


DEALS = """SELECT l_suppkey AS code, CAST(date_trunc('month', l_shipdate) AS DATE) AS session, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS i,
 l_extendedprice / l_quantity AS price, l_quantity AS qty, l_extendedprice AS amount,
 CASE WHEN l_linenumber = 7 AND l_discount <= 0.01 THEN '?' WHEN l_linenumber = 1 AND l_tax = 0 THEN 'C' WHEN l_returnflag = 'A' THEN 'B' WHEN l_returnflag = 'R' THEN 'S'
  WHEN l_linestatus = 'F' THEN 'B' ELSE 'S' END AS side, l_orderkey AS pid, CAST(l_linenumber AS BIGINT) AS trade_id FROM lineitem"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily facts: i, code, session, amount, qty, known_net, unknown, net (null if any amount is of unknown side), ratio, trades, close."""
    kept = deals(spark, sf_dir).where(X.traded("price", "qty") & X.not_cancelled("side"))
    sums = kept.groupBy("code", "session", "i").agg(F.sum("amount").alias("a"), F.sum("qty").alias("q"), X.known_net().alias("k"), X.unknown_amount().alias("u"), F.count("*").alias("trades"))
    rounded = sums.select("code", "session", "i", X.rounded("a", 2).alias("amount"), F.col("q").alias("qty"), X.rounded("k", 2).alias("known_net"), X.rounded("u", 2).alias("unknown"), "trades")
    net = X.complete_net("known_net", "unknown")
    return rounded.withColumn("net", net).withColumn("ratio", X.rounded(100 * net / F.col("amount"))).withColumn("close", X.rounded(F.col("amount") / F.col("qty")))


def rounded_sql(x: str, digits: int = 4) -> str:
    return f"floor(({x}) * {10.0**digits} + 0.5) / {10.0**digits}"


FACTS = f"""SELECT *, {rounded_sql("100 * net / amount")} AS ratio, {rounded_sql("amount / qty")} AS close FROM (
 SELECT *, CASE WHEN unknown = 0 THEN known_net END AS net FROM (
  SELECT code, session, i, {rounded_sql("sum(amount)", 2)} AS amount, sum(qty) AS qty,
   {rounded_sql("sum(CASE side WHEN 'B' THEN amount WHEN 'S' THEN -amount ELSE 0.0 END)", 2)} AS known_net,
   {rounded_sql("sum(CASE WHEN side IN ('B', 'S') THEN 0.0 ELSE amount END)", 2)} AS unknown, count(*) AS trades
  FROM ({DEALS}) WHERE price > 0 AND qty > 0 AND side <> 'C' GROUP BY code, session, i))"""


def bars(spark: SparkSession, sf_dir: str, codes: int = 20) -> DataFrame:
    """Candles: code, i, session, o, h, l, c, volume, amount from the orders of a month."""
    x = table(spark, sf_dir, "orders").select((F.col("o_custkey") % codes).alias("code"), month_index(F.col("o_orderdate")).alias("i"), F.trunc(F.to_date("o_orderdate"), "month").alias("session"), F.col("o_totalprice").alias("p"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return x.groupBy("code", "i", "session").agg(
        F.min_by("p", "at").alias("o"), F.max("p").alias("h"), F.min("p").alias("l"), F.max_by("p", "at").alias("c"), F.count("*").cast("double").alias("volume"), F.sum("p").alias("amount"))


BARS = """SELECT o_custkey % 20 AS code, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS i, CAST(date_trunc('month', o_orderdate) AS DATE) AS session,
 arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS o, max(o_totalprice) AS h, min(o_totalprice) AS l, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS c,
 CAST(count(*) AS DOUBLE) AS volume, sum(o_totalprice) AS amount FROM orders GROUP BY ALL"""


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intraday rows: code (15 users each, so that codes grow with the data), day (days since 1970), us (microseconds since 1970),
    kind (quote, B, S or ?), value, event_id."""
    kind = F.when(F.col("event_type") == "view", "quote").when(F.col("event_type") == "purchase", "B").when(F.col("event_type") == "signup", "S").otherwise("?")
    x = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return x.select(F.expr("user_id div 15").alias("code"), F.expr("unix_micros(CAST(ts AS timestamp)) div 86400000000").alias("day"), us.alias("us"), kind.alias("kind"), "value", "event_id")


STREAM = "SELECT user_id // 15 AS code, epoch_us(ts) // 86400000000 AS day, epoch_us(ts) AS us, CASE event_type WHEN 'view' THEN 'quote' WHEN 'purchase' THEN 'B' WHEN 'signup' THEN 'S' ELSE '?' END AS kind, value, event_id FROM events"


#: Clock of an event's day, laid over the session: 24 hours become 09:00 to 14:59, in whole minutes.
_CLOCK = "(9 + hour(ts) div 4) * 10000000 + (hour(ts) % 4 * 15 + minute(ts) div 4) * 100000"
_CLOCK_SQL = "CAST((9 + hour(ts) // 4) * 10000000 + (hour(ts) % 4 * 15 + minute(ts) // 4) * 100000 AS BIGINT)"


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-book snapshots of a code (user) in a session (week i): trade_day, t (HHMMSSmmm; null where it can't be read),
    event_id, last, pre_close, volume and amount of the day so far, ten levels bid, ask, bid_qty, ask_qty, best first."""
    x = table(spark, sf_dir, "events").where("event_type IN ('view', 'click', 'error')")
    i, e = F.expr("CAST(dayofyear(ts) div 7 AS long)"), F.col("event_id")
    best = 1000 + e % 4 * 10
    levels = lambda f: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: f(k).cast("double"))
    ask = best + e % 6 - F.when(e % 13 == 0, 2).otherwise(0)
    return x.select(
        F.col("user_id").alias("code"), i.alias("i"), F.when(e % 1997 == 0, "other").otherwise(i.cast("string")).alias("trade_day"),
        F.when(e % 23 == 0, None).when(e % 31 == 0, 150000000 + e % 900).otherwise(F.expr(_CLOCK)).cast("long").alias("t"), "event_id",
        F.when(e % 17 == 0, 0.0).otherwise(F.col("value")).alias("last"), (10 + F.col("user_id") % 90).cast("double").alias("pre_close"), (e % 1000 * 100).cast("double").alias("volume"), (e % 1000 * F.col("value")).alias("amount"),
        levels(lambda k: best - k * (1 + e % 3 - (e % 29 == 0).cast("int"))).alias("bid"), levels(lambda k: ask + k * (1 + e % 5)).alias("ask"),
        levels(lambda k: F.when(e % 19 != 0, e * (k + 3) % 7 * 100)).alias("bid_qty"), levels(lambda k: e * (k + 5) % 11 * 100).alias("ask_qty"),
    )


SNAPSHOTS = f"""SELECT code, i, CASE WHEN e % 1997 = 0 THEN 'other' ELSE CAST(i AS VARCHAR) END AS trade_day, CASE WHEN e % 23 = 0 THEN NULL WHEN e % 31 = 0 THEN 150000000 + e % 900 ELSE clock END AS t, e AS event_id,
 CASE WHEN e % 17 = 0 THEN 0.0 ELSE value END AS last, CAST(10 + code % 90 AS DOUBLE) AS pre_close, CAST(e % 1000 * 100 AS DOUBLE) AS volume, e % 1000 * value AS amount,
 [CAST(best - k * (1 + e % 3 - CASE WHEN e % 29 = 0 THEN 1 ELSE 0 END) AS DOUBLE) for k in range(10)] AS bid, [CAST(best + e % 6 - CASE WHEN e % 13 = 0 THEN 2 ELSE 0 END + k * (1 + e % 5) AS DOUBLE) for k in range(10)] AS ask,
 [CASE WHEN e % 19 <> 0 THEN CAST(e * (k + 3) % 7 * 100 AS DOUBLE) END for k in range(10)] AS bid_qty, [CAST(e * (k + 5) % 11 * 100 AS DOUBLE) for k in range(10)] AS ask_qty
 FROM (SELECT user_id AS code, event_id AS e, CAST(dayofyear(ts) // 7 AS BIGINT) AS i, {_CLOCK_SQL} AS clock, 1000 + event_id % 4 * 10 AS best, value FROM events WHERE event_type IN ('view', 'click', 'error'))"""


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of the same codes and sessions as the snapshots: code, i, trade_day, t, price, qty, amount, side, pid."""
    x = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'signup')")
    e = F.col("event_id")
    i, qty = F.expr("CAST(dayofyear(ts) div 7 AS long)"), (e % 50 + 1).cast("double")
    side = F.when(e % 37 == 0, "C").when(e % 41 == 0, "?").when(F.col("event_type") == "purchase", "B").otherwise("S")
    return x.select(F.col("user_id").alias("code"), i.alias("i"), F.when(e % 499 == 0, "other").otherwise(i.cast("string")).alias("trade_day"), F.when(e % 101 == 0, 126000000).otherwise(F.expr(_CLOCK)).cast("long").alias("t"), F.col("value").alias("price"), qty.alias("qty"), (F.col("value") * qty).alias("amount"), side.alias("side"), (e % 7 * 3).alias("pid"))


PRINTS = f"""SELECT user_id AS code, i, CASE WHEN event_id % 499 = 0 THEN 'other' ELSE CAST(i AS VARCHAR) END AS trade_day, CASE WHEN event_id % 101 = 0 THEN 126000000 ELSE clock END AS t, value AS price, CAST(event_id % 50 + 1 AS DOUBLE) AS qty,
 value * CAST(event_id % 50 + 1 AS DOUBLE) AS amount, CASE WHEN event_id % 37 = 0 THEN 'C' WHEN event_id % 41 = 0 THEN '?' WHEN event_type = 'purchase' THEN 'B' ELSE 'S' END AS side, event_id % 7 * 3 AS pid
 FROM (SELECT *, CAST(dayofyear(ts) // 7 AS BIGINT) AS i, {_CLOCK_SQL} AS clock FROM events WHERE event_type IN ('purchase', 'signup'))"""


#: Clock of an event's day in milliseconds, its 24 hours laid over 09:30 to 15:00.
_MS = "34200000 + CAST(hour(ts) * 3600000 + minute(ts) * 60000 + floor(second(ts)) * 1000 AS bigint) * 11 div 48"
_MS_SQL = "34200000 + (hour(ts) * 3600000 + minute(ts) * 60000 + second(ts) * 1000) * 11 // 48"


def _hhmmss(ms: str, div: str) -> str:
    return f"CAST({ms} {div} 3600000 * 10000000 + {ms} {div} 60000 % 60 * 100000 + {ms} % 60000 AS bigint)"


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes and trades of a code's days, with what a feed gets wrong now and then: code, day, e (event), kind (quote or trade),
    trade_day, t (HHMMSSmmm), bid and ask (ten-thousandths), their sizes, price, qty and side."""
    x = table(spark, sf_dir, "events").select(F.expr("user_id div 15").alias("code"), F.expr("unix_micros(CAST(ts AS timestamp)) div 86400000000").alias("day"), F.col("event_id").alias("e"), F.expr(_MS).alias("ms"), "event_type", "value")
    quote, e, clock = F.col("event_type").isin("view", "click"), F.col("e"), F.expr(_hhmmss("ms", "div"))
    t = F.when(quote, F.when(e % 887 == 0, 100061000).when(e % 1103 == 0, None).when((F.col("code") + F.col("day")) % 37 == 5, clock - clock % 10000000).otherwise(clock)).otherwise(F.when(e % 1499 == 0, 126000000).otherwise(clock))
    bid = 10000 + e % 4 * 10
    side = F.when(F.col("event_type") == "purchase", "B").when(F.col("event_type") == "signup", "S").when(e % 3 == 0, "B")
    return x.select(
        "code", "day", "e", F.when(quote, "quote").otherwise("trade").alias("kind"), F.when(e % 997 == 0, "other").otherwise(F.col("day").cast("string")).alias("trade_day"), t.cast("long").alias("t"), bid.cast("double").alias("bid"), (bid + e % 6 - F.when(e % 13 == 0, 9).otherwise(0)).cast("double").alias("ask"),
        F.when(e % 31 != 0, (e * 7 % 5 * 100).cast("double")).alias("bid_qty"), (e * 3 % 4 * 100 + 50).cast("double").alias("ask_qty"), F.col("value").alias("price"), F.when(e % 1201 == 0, 0.0).otherwise(e % 50 + 1.0).alias("qty"), side.alias("side"))


TAPE = f"""SELECT code, day, e, CASE WHEN q THEN 'quote' ELSE 'trade' END AS kind, CASE WHEN e % 997 = 0 THEN 'other' ELSE CAST(day AS VARCHAR) END AS trade_day,
 CASE WHEN q THEN CASE WHEN e % 887 = 0 THEN 100061000 WHEN e % 1103 = 0 THEN NULL WHEN (code + day) % 37 = 5 THEN clock - clock % 10000000 ELSE clock END WHEN e % 1499 = 0 THEN 126000000 ELSE clock END AS t,
 CAST(10000 + e % 4 * 10 AS DOUBLE) AS bid, CAST(10000 + e % 4 * 10 + e % 6 - CASE WHEN e % 13 = 0 THEN 9 ELSE 0 END AS DOUBLE) AS ask, CASE WHEN e % 31 <> 0 THEN CAST(e * 7 % 5 * 100 AS DOUBLE) END AS bid_qty, CAST(e * 3 % 4 * 100 + 50 AS DOUBLE) AS ask_qty,
 value AS price, CASE WHEN e % 1201 = 0 THEN 0.0 ELSE e % 50 + 1.0 END AS qty, CASE event_type WHEN 'purchase' THEN 'B' WHEN 'signup' THEN 'S' ELSE CASE WHEN e % 3 = 0 THEN 'B' END END AS side
 FROM (SELECT *, {_hhmmss("ms", "//")} AS clock FROM (SELECT user_id // 15 AS code, epoch_us(ts) // 86400000000 AS day, event_id AS e, {_MS_SQL} AS ms, event_type, event_type IN ('view', 'click') AS q, value FROM events))"""
