"""One security's day as a whole: the checks a deep look must pass, and the nested card that is published.

Figures come from a few aggregates over the trades of all securities at once; arrays in a card hold one entry a part of the session,
size of parent order, kind of order or session of its history, so a card's size does not grow with the trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklane.functions import exprs as X
from ticklane.plans import flow
from ticklane.plans.requests import agrees

#: Fixed value: the order of parent sizes in a card.
BUCKETS = ("small", "medium", "large", "huge", "no id")


def whole(c) -> Column:
    """To the nearest whole number, halves up; null stays. Sums are taken to six digits before, so that the order of adding up doesn't
    decide a half."""
    return F.when(X.finite(c), F.floor(X.rounded(c, 6) + 0.5)).cast("long")


def four(c) -> Column:
    return X.rounded(c).cast("decimal(18,4)")


def counted_parents(trades: DataFrame, key: list[str], bounds) -> DataFrame:
    """Parents by key and size with whole sums, as they are published."""
    return flow.parents(trades, key, bounds).select(*key, "bucket", whole("net").alias("net"), "n")


def deep_dive(trades: DataFrame, orders: DataFrame, reported: DataFrame, key: list[str], day: Column, bounds) -> DataFrame:
    """Each reported key with what its trades say and what is wrong with that, the first of: NO_TRADES, BAD_DAY, AMOUNT_DIFFERS,
    NET_STATUS_DIFFERS (one side knows a net, the other not), NET_DIFFERS, PARENTS_UNBALANCED (their whole sums are more than their
    number and 2 away from the known net), NO_ORDERS, BAD_ORDERS (a quantity or day is missing or wrong), else PUBLISHED.

    trades: key, trade_day, t, amount, qty, side, pid (counted ones only); orders: key, trade_day, qty; reported: key, amount, net."""
    told = lambda c: F.coalesce(c, F.lit(False))
    regular = F.sum(F.when(X.regular_session("t"), F.col("amount")))
    sums = trades.groupBy(*key).agg(
        F.count("*").alias("trade_rows"), F.count_if(~told(F.col("trade_day") == day)).alias("bad_days"), F.sum("amount").alias("amount_mine"), X.known_net().alias("known_net"), X.unknown_amount().alias("unknown"), regular.alias("regular"))
    sums = sums.withColumn("net_mine", X.complete_net("known_net", "unknown")).withColumn("coverage", 100 * F.col("regular") / F.nullif("amount_mine", F.lit(0.0))).drop("regular")
    parents = counted_parents(trades, key, bounds).groupBy(*key).agg(F.count("*").alias("parents"), F.sum("net").alias("parents_net"))
    asked = orders.groupBy(*key).agg(F.count("*").alias("order_rows"), F.count_if(F.col("qty").isNull() | ~told(F.col("trade_day") == day)).alias("bad_orders"))
    rows = reported.select(*key, "amount", "net")
    for part in (sums, parents, asked):
        rows = rows.join(part, key, "left")
    parts, total = F.coalesce("parents", F.lit(0)), F.coalesce("parents_net", F.lit(0))
    status = (
        F.when(F.col("trade_rows").isNull(), "NO_TRADES").when(F.col("bad_days") > 0, "BAD_DAY").when(~agrees("amount", "amount_mine"), "AMOUNT_DIFFERS")
        .when(F.col("net").isNull() != F.col("net_mine").isNull(), "NET_STATUS_DIFFERS").when(~agrees("net", "net_mine"), "NET_DIFFERS")
        .when(F.abs(total - F.col("known_net")) > parts + 2, "PARENTS_UNBALANCED").when(F.col("order_rows").isNull(), "NO_ORDERS").when(F.col("bad_orders") > 0, "BAD_ORDERS").otherwise("PUBLISHED")
    )
    return rows.select(*key, "trade_rows", "bad_days", "amount", "amount_mine", "net", "net_mine", "known_net", "unknown", "coverage", "parents", "parents_net", "order_rows", "bad_orders", status.alias("status"))


def _gathered(rows: DataFrame, key: list[str], name: str, entry: Column) -> DataFrame:
    """An array of entries by key in the order of their first fields."""
    return rows.groupBy(*key).agg(F.array_sort(F.collect_list(entry)).alias(name))


def cards(facts: DataFrame, trades: DataFrame, orders: DataFrame, bounds, sessions: int = 7) -> DataFrame:
    """code, i, card (JSON; an unknown figure is there as null) and card_id (its sha256) of facts (code, i, label, ret, close, amount, net).

    Parts of the session and sizes of parents stand in their fixed order, orders by kind and side, the history by session: the last
    ``sessions`` up to i, as far as there are facts. An array without entries is empty."""
    key = ["code", "i"]
    parts = flow.segments(trades.withColumn("segment", X.segment("t")).where("segment IS NOT NULL"), [*key, "segment"])
    rank = sum((F.when(F.col("bucket") == b, F.lit(k)).otherwise(F.lit(0)) for k, b in enumerate(BUCKETS)), F.lit(0))
    parents = counted_parents(trades, key, bounds).withColumn("place", rank)
    kinds = flow.order_counts(orders, key, "kind", "side", "qty")
    span = Window.partitionBy("code").orderBy("i").rangeBetween(-(sessions - 1), 0)
    past = F.struct("i", "label", four("ret").alias("ret"), whole("net").alias("net"))
    rows = facts.withColumn("history", F.array_sort(F.collect_list(past).over(span)))
    for part in (
        _gathered(parts, key, "segments", F.struct(F.col("segment").alias("s"), whole("amount").alias("a"), whole("net").alias("n"), four("vwap").alias("v"))),
        _gathered(parents, key, "placed", F.struct("place", F.struct(F.col("bucket").alias("b"), F.col("net").alias("n"), F.col("n").alias("c")).alias("x"))),
        _gathered(kinds, key, "orders", F.struct(F.col("kind").alias("t"), F.col("side").alias("s"), F.col("n").alias("r"), whole("qty").alias("q"))),
    ):
        rows = rows.join(part, key, "left")
    entries = {c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)) for c in ("segments", "placed", "orders")}
    card = F.struct(
        "code", "i", "label", four("ret").alias("ret"), four("close").alias("close"), whole("amount").alias("amount"), whole("net").alias("net"), F.when(F.col("net").isNull(), "UNKNOWN").otherwise("AVAILABLE").alias("direction"),
        entries["segments"].alias("segments"), F.transform(entries["placed"], lambda p: p["x"]).alias("parents"), entries["orders"].alias("orders"), "history",
    )
    return rows.select("code", "i", F.to_json(card, {"ignoreNullFields": "false"}).alias("card"), X.content_id(card).alias("card_id"))
