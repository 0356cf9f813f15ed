"""What candidate order ids and quotes say about trades' sides: counts to read, never a decision about identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklane.functions import exprs as X
from ticklane.operators.timeline import asof_before

AUDIT = ["valid_rows", "keys", "repeated", "multi_side", "matched", "same_side", "single_same_side", "repeated_matched", "single_matched", "comparable", "earlier", "same_time", "later"]


def _clock(t: str) -> Column:
    return F.coalesce(X.clock_valid(t) & (F.col(t) > 0), F.lit(False))


def key_audit(trades: DataFrame, orders: DataFrame, key: str) -> DataFrame:
    """By code: how trades (code, side, pid, t) of known side with an id meet orders (code, side, t and the candidate id
    ``key``). Status MISSING_FIELD if orders have no such column (all counts null), NO_VALID_KEYS where no order of the code
    has an id above 0. Without a column t in orders the five figures of time are null. Times are compared for ids of one
    order, where both clocks are valid."""
    eligible = trades.where(F.col("side").isin("B", "S") & (F.col("pid") > 0))
    counts = eligible.groupBy("code").agg(F.count("*").alias("eligible"))
    rows = orders.groupBy("code").agg(F.count("*").alias("order_rows"))
    codes = counts.join(rows, "code", "full_outer").na.fill(0, ["eligible", "order_rows"])
    if key not in orders.columns:
        return codes.select("code", F.lit("MISSING_FIELD").alias("status"), "order_rows", "eligible", *(F.lit(None).cast("long").alias(c) for c in AUDIT))
    timed = "t" in orders.columns
    groups = orders.where(F.col(key) > 0).groupBy("code", F.col(key).alias("pid")).agg(
        F.count("*").alias("n"), F.countDistinct("side").alias("sides"), F.max(F.col("side") == "B").alias("has_b"), F.max(F.col("side") == "S").alias("has_s"),
        (F.min("t") if timed else F.lit(None).cast("long")).alias("order_t"))
    keys = groups.groupBy("code").agg(F.sum("n").alias("valid_rows"), F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("sides") > 1).alias("multi_side"))
    met = eligible.join(groups, ["code", "pid"], "left")
    agrees = ((F.col("side") == "B") & F.col("has_b")) | ((F.col("side") == "S") & F.col("has_s"))
    single = F.col("n") == 1
    both = single & _clock("t") & _clock("order_t")
    clocks = {"single_matched": single, "comparable": both, "earlier": both & (F.col("order_t") < F.col("t")), "same_time": both & (F.col("order_t") == F.col("t")), "later": both & (F.col("order_t") > F.col("t"))}
    sums = met.groupBy("code").agg(
        F.count("n").alias("matched"), F.count_if(agrees).alias("same_side"), F.count_if(single & agrees).alias("single_same_side"), F.count_if(F.col("n") > 1).alias("repeated_matched"),
        *((F.count_if(rule) if timed else F.lit(None).cast("long")).alias(name) for name, rule in clocks.items()))
    out = codes.join(keys, "code", "left").join(sums, "code", "left")
    counted = AUDIT if timed else AUDIT[:8]
    status = F.when(F.col("keys") > 0, "AVAILABLE").otherwise("NO_VALID_KEYS")
    return out.na.fill(0, counted).select("code", status.alias("status"), "order_rows", "eligible", *AUDIT)


def id_agreement(rows: DataFrame) -> DataFrame:
    """By exchange: legacy trades, those of known side, those whose two order ids can be compared, and those where the later
    order is the side's; cancellations, rows without price or quantity and codes outside the universe are left out."""
    digits = F.lpad(F.col("SecuCode").cast("string"), 6, "0")
    exchange = F.when(F.col("SecuCode") >= 600000, "SH").otherwise("SZ")
    kept = rows.where((F.col("Price") > 0) & (F.col("Volume") > 0) & ~F.col("Side").isin(-1, -11) & F.concat(digits, F.lit("."), exchange).rlike(X.UNIVERSE))
    buys, sells = F.col("BuyID"), F.col("SellID")
    return kept.groupBy(exchange.alias("exchange")).agg(
        F.count("*").alias("rows"), F.count_if(F.col("Side").isin(0, 1)).alias("known"), F.count_if((buys > 0) & (sells > 0) & (buys != sells)).alias("comparable"),
        F.count_if(((F.col("Side") == 0) & (buys > sells)) | ((F.col("Side") == 1) & (sells > buys))).alias("agreement"), F.sum(F.col("Price").cast("double") * F.col("Volume") / 100).alias("amount"))


def quote_agreement(trades: DataFrame, quotes: DataFrame, freshest: int = 1000) -> DataFrame:
    """By code and side (B, S): trades (code, ms, price, side) at or beyond a fresh unlocked quote (code, ms, bid, ask) strictly
    before them, and those on their own side of it. Quotes should be one a moment."""
    held = asof_before(trades.where(F.col("side").isin("B", "S")), quotes, ["code"], "ms", ["bid", "ask"])
    buy, sell = F.col("price") >= F.col("ask"), F.col("price") <= F.col("bid")
    fresh = held.where((F.col("ms") - F.col("right_time") <= freshest) & (F.col("bid") > 0) & (F.col("ask") > F.col("bid")) & (buy | sell))
    return fresh.groupBy("code", "side").agg(F.count("*").alias("eligible"), F.count_if(((F.col("side") == "B") & buy) | ((F.col("side") == "S") & sell)).alias("agreement"))
