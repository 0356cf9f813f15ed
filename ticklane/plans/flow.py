"""Trade-flow aggregates: daily facts, segments, parent orders, order counts, the market's path, candidate pools."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklane.functions import exprs as X
from ticklane.operators.timeline import previous_session


def labelled(facts: DataFrame) -> DataFrame:
    """Facts with the return on the session before, and their label."""
    both = previous_session(facts, ["code"], "i", ["close"])
    return both.withColumn("ret", X.rounded(X.percent_return("close", "close_prev"))).withColumn("label", X.label()).drop("close_prev")


def segments(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Amount, complete net and volume-weighted price by keys (with the segment among them)."""
    sums = trades.groupBy(*keys).agg(F.sum("amount").alias("amount"), F.sum("qty").alias("qty"), X.known_net().alias("known"), X.unknown_amount().alias("unknown"), F.count("*").alias("trades"))
    return sums.withColumn("net", X.complete_net("known", "unknown")).withColumn("vwap", X.ratio("amount", "qty"))


def parents(trades: DataFrame, keys: list[str], bounds=(50_000, 200_000, 1_000_000)) -> DataFrame:
    """Signed sums by parent order (side and id), then by size bucket; trades of known side without a valid id make a bucket
    of their own that counts trades."""
    known = trades.where(F.col("side").isin("B", "S"))
    sign = F.when(F.col("side") == "B", 1).otherwise(-1)
    valid = known.where("pid > 0").groupBy(*keys, "side", "pid").agg(F.sum("amount").alias("amount"))
    by_size = valid.groupBy(*keys, X.size_bucket("amount", bounds).alias("bucket")).agg(F.sum(sign * F.col("amount")).alias("net"), F.count("*").alias("n"))
    loose = known.where(~F.coalesce(F.col("pid") > 0, F.lit(False))).groupBy(*keys).agg(F.sum(sign * F.col("amount")).alias("net"), F.count("*").alias("n"))
    return by_size.unionByName(loose.withColumn("bucket", F.lit("no id")).select(by_size.columns))


def order_counts(orders: DataFrame, keys: list[str], kind: str, side: str, qty: str) -> DataFrame:
    clean = lambda c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("none"))
    return orders.groupBy(*keys, clean(kind).alias("kind"), clean(side).alias("side")).agg(F.count("*").alias("n"), F.sum(qty).alias("qty"))


def market_path(labelled_facts: DataFrame) -> DataFrame:
    """By session: sums, breadth and the exact 95th percentile of absolute ratios; net is null if any security's is."""
    return labelled_facts.groupBy("i", "session").agg(
        F.count("*").alias("n"), F.sum("amount").alias("amount"), F.when(F.count_if(F.col("net").isNull()) == 0, F.sum("net")).alias("net"),
        F.count_if(F.col("net").isNull()).alias("unknown_stocks"), F.count_if(F.col("ret") > 0).alias("up"), F.count_if(F.col("ret") < 0).alias("down"),
        F.percentile(F.abs("ratio"), 0.95).alias("p95"))


#: The pools, by name: condition, order and size.
POOLS = [
    ("push", "ret > 0 AND net > 0", "ratio DESC", 8), ("support", "ret BETWEEN -3 AND 0 AND net > 0", "ratio DESC", 6), ("passive", "ret BETWEEN -1 AND 3 AND net < 0", "ret DESC", 6),
    ("diverge", "ret > 3 AND net < 0", "ratio ASC", 6), ("weak", "ret < 0 AND net < 0", "ratio ASC", 6),
]


def pools(day: DataFrame, least_amount: float) -> DataFrame:
    """Top-k pools of one session, ties by code; each code once, in the first pool that has it (order: pool, place)."""
    liquid = day.where(F.col("amount") >= least_amount)
    parts = []
    for at, (name, rule, order, k) in enumerate(POOLS):
        c, way = order.split()
        first = liquid.where(rule).orderBy(F.col(c).desc() if way == "DESC" else F.col(c).asc(), "code").limit(k)
        parts.append(first.select("code", "ratio", "ret", F.lit(at).alias("pool_order"), F.lit(name).alias("pool")))
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy("code").agg(F.min(F.struct("pool_order", "pool", "ratio", "ret")).alias("m")).select("code", "m.pool", "m.ratio", "m.ret")
