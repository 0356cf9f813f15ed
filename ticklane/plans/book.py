"""Order-book snapshots: the last ones of a session, its quotes by segment, and the daily report made of them and the trades.

Snapshots have t (HHMMSSmmm as a number, null where it can't be read), last, pre_close, volume, amount and the ladders bid, ask,
bid_qty and ask_qty (arrays, best level first). A table without rows gives no rows; nulls in a ladder leave the figures null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklane.functions import exprs as X
from ticklane.operators.timeline import previous_session

#: Fixed value: books count until this clock, the closing auction's not.
BOOK_CLOSE = 145700000


def _later(*ties: str) -> Column:
    return F.struct("t", *ties)


def closing_snapshot(snapshots: DataFrame, key: list[str], ties: list[str]) -> DataFrame:
    """The last snapshot of each key with a price above 0, by the number of its clock, the late ones included; one aggregate
    that combines before its shuffle. Clocks that can't be read come before all others."""
    wanted = F.struct(F.col("t").alias("close_time"), F.col("last").alias("close"), "pre_close", F.col("volume").alias("shown_volume"), F.col("amount").alias("shown_amount"))
    kept = snapshots.where(X.finite("last") & (F.col("last") > 0))
    return kept.groupBy(*key).agg(F.max_by(wanted, F.struct(F.coalesce("t", F.lit(-1)), *ties)).alias("s")).select(*key, "s.*")


def depth(levels: str) -> Column:
    """Quantity over all levels; an unknown level counts nothing in the report's depth."""
    return F.aggregate(levels, F.lit(0.0), lambda acc, q: acc + F.coalesce(q, F.lit(0.0)))


def closing_book(snapshots: DataFrame, key: list[str], ties: list[str]) -> DataFrame:
    """Depth of each key's last book before the closing auction."""
    wanted = F.struct(F.col("t").alias("book_time"), depth("bid_qty").alias("bid_depth"), depth("ask_qty").alias("ask_depth"))
    kept = snapshots.where(F.col("t") < BOOK_CLOSE)
    return kept.groupBy(*key).agg(F.max_by(wanted, _later(*ties)).alias("s")).select(*key, "s.*")


def report_facts(trades: DataFrame, snapshots: DataFrame, key: list[str], ties: list[str]) -> DataFrame:
    """Daily facts of the report: flow of the trades with the closing snapshot (needed, with a previous close above 0) and the
    closing book (null where there is none); gaps of volume and amount against what the snapshot shows, as shares."""
    kept = trades.where(X.traded("price", "qty") & X.not_cancelled("side"))
    inside = F.when(X.regular_session("t"), F.col("amount")).otherwise(0.0)
    sums = kept.groupBy(*key).agg(F.sum("qty").alias("volume"), F.sum("amount").alias("amount"), X.known_net().alias("known_net"), X.unknown_amount().alias("unknown"), F.count("*").alias("trades"), F.sum(inside).alias("regular"))
    rows = sums.join(closing_snapshot(snapshots, key, ties).where("pre_close > 0"), key).join(closing_book(snapshots, key, ties), key, "left")
    net = X.complete_net("known_net", "unknown")
    gap = lambda mine, shown: (F.col(mine) - F.col(shown)) / F.nullif(F.col(shown), F.lit(0.0))
    return rows.select(
        *key, "close", "pre_close", X.percent_return("close", "pre_close").alias("ret"), "amount", "volume", net.alias("net"), "known_net", "unknown", "trades", X.ratio(net, F.col("amount")).alias("net_ratio"), X.ratio("amount", "volume").alias("vwap"),
        (100 * X.ratio("regular", "amount")).alias("coverage"), gap("volume", "shown_volume").alias("volume_gap"), gap("amount", "shown_amount").alias("amount_gap"), "close_time", "book_time", "bid_depth", "ask_depth", (X.imbalance("bid_depth", "ask_depth") / 100).alias("imbalance"),
    )


def named(rows: DataFrame, names: DataFrame, unknown: str) -> DataFrame:
    """Rows with the name of their code; one name a code (the least, where a list repeats it), ``unknown`` where there is none."""
    one = names.groupBy("code").agg(F.min("name").alias("name"))
    return rows.join(one, "code", "left").withColumn("name", F.coalesce("name", F.lit(unknown)))


def history(facts: DataFrame) -> DataFrame:
    """Each code's sessions (i: place in the calendar) with label, return, net, and the changes to the closes one and three
    sessions on; null where that session has no row."""
    rows = previous_session(previous_session(facts, ["code"], "i", ["close"], "_1", -1), ["code"], "i", ["close"], "_3", -3)
    return rows.select("code", "i", X.label().alias("label"), "ret", "net", X.percent_return("close_1", "close").alias("after_1"), X.percent_return("close_3", "close").alias("after_3"))


def market_by_session(facts: DataFrame) -> DataFrame:
    """By session: codes, sums, breadth, codes of unknown net, and the exact 95th percentiles of both gaps, in percent."""
    return facts.groupBy("i").agg(
        F.count("*").alias("n"), F.sum("amount").alias("amount"), F.when(F.count_if(F.col("net").isNull()) == 0, F.sum("net")).alias("net"), F.count_if(F.col("net").isNull()).alias("unknown_stocks"), F.count_if(F.col("ret") > 0).alias("up"),
        F.count_if(F.col("ret") < 0).alias("down"), (100 * F.percentile(F.abs("volume_gap"), 0.95)).alias("volume_gap_95"), (100 * F.percentile(F.abs("amount_gap"), 0.95)).alias("amount_gap_95"))


def reconciled(mine: DataFrame, reported: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Both sides' figures by key and whether each agrees within the greater of 2 and a billionth of the reported one; nulls
    agree with nulls only. A key of one side alone is there, and agrees in nothing."""
    both = mine.select(*key, *(F.col(c).alias(f"{c}_mine") for c in columns), F.lit(True).alias("m")).join(reported.select(*key, *columns, F.lit(True).alias("r")), key, "full_outer")
    near = lambda c: F.coalesce(F.abs(F.col(f"{c}_mine") - F.col(c)) <= F.greatest(F.lit(2.0), F.abs(F.col(c)) * 1e-9), F.col(f"{c}_mine").isNull() & F.col(c).isNull())
    matched = F.col("m").isNotNull() & F.col("r").isNotNull()
    return both.select(*key, *(x for c in columns for x in (f"{c}_mine", c)), *((matched & near(c)).alias(f"{c}_agrees") for c in columns))


def quote_gate(snapshots: DataFrame, key: list[str], day: Column) -> DataFrame:
    """Whether a key's quotes may be used: INVALID_DATE if a row is of another day, DUPLICATE_TIME if two rows of the regular
    session have one clock (rows outside don't matter), else OPEN."""
    clock = F.when(X.segment("t").isNotNull(), F.col("t"))
    wrong = ~F.coalesce(F.col("trade_day") == day, F.lit(False))
    by_clock = snapshots.groupBy(*key, clock.alias("clock")).agg(F.count_if(wrong).alias("wrong"), F.count("*").alias("n"))
    sums = by_clock.groupBy(*key).agg(F.sum("wrong").alias("bad_dates"), F.coalesce(F.sum(F.when(F.col("clock").isNotNull(), F.col("n"))), F.lit(0)).alias("observed"), F.count_if(F.col("clock").isNotNull() & (F.col("n") > 1)).alias("repeated"))
    return sums.select(*key, "bad_dates", "observed", F.when(F.col("bad_dates") > 0, "INVALID_DATE").when(F.col("repeated") > 0, "DUPLICATE_TIME").otherwise("OPEN").alias("gate"))


def quote_path(snapshots: DataFrame, key: list[str], day: Column) -> DataFrame:
    """By key and segment, of the keys whose gate is open: observed and valid quotes (bid above 0, ask not below it), mids, and
    medians of spread (basis points), imbalance of the top and of ten levels, plain and weighted, and microprice premium.

    Valid depth needs quantities not below 0 with a sum above it. Neighbours with the same bid compare their displayed quantity
    only if the row right before has valid depth: any other row breaks the chain. Changes are null with fewer than two quotes."""
    gate = quote_gate(snapshots, key, day).where("gate = 'OPEN'").select(*key)
    top = lambda c: F.get(c, F.lit(0))
    yes = lambda c: F.coalesce(c, F.lit(False))
    rows = snapshots.withColumn("segment", X.segment("t")).where("segment IS NOT NULL").join(gate, key, "left_semi")
    b, a, p, q = (F.col(c) for c in ("b", "a", "p", "q"))
    rows = rows.select(*key, "segment", "t", top("bid").alias("b"), top("ask").alias("a"), top("bid_qty").alias("p"), top("ask_qty").alias("q"), X.ladder_imbalance("bid", "ask", "bid_qty", "ask_qty").alias("ten"), X.ladder_imbalance("bid", "ask", "bid_qty", "ask_qty", True).alias("ten_weighted"))
    rows = rows.withColumn("valid", yes(X.finite("b") & X.finite("a") & (b > 0) & (a >= b)))
    rows = rows.withColumn("deep", F.col("valid") & yes(X.finite("p") & X.finite("q") & (p >= 0) & (q >= 0) & (p + q > 0)))
    w = Window.partitionBy(*key, "segment").orderBy("t")
    same = F.col("deep") & yes(F.lag("deep").over(w)) & yes(F.lag("b").over(w) == b)
    rows = rows.withColumn("same", same).withColumn("rise", F.col("same") & (p > F.lag("p").over(w)))
    mid, deep = F.when(F.col("valid"), (b + a) / 20000), lambda c: F.when(F.col("deep"), c)
    rows = rows.withColumn("mid", mid).withColumn("clock", F.when(F.col("valid"), F.col("t")))
    sums = rows.groupBy(*key, "segment").agg(
        F.count("*").alias("observed"), F.count_if("valid").alias("valid"), F.min("clock").alias("first_time"), F.max("clock").alias("last_time"), F.min_by("mid", "clock").alias("first_mid"), F.max_by("mid", "clock").alias("last_mid"), F.min("mid").alias("low"),
        F.median(F.when(F.col("valid"), X.spread_bps("b", "a"))).alias("spread"), F.median(deep(X.imbalance("p", "q"))).alias("top_imbalance"), F.count_if("deep").alias("depth_valid"), F.median(deep(F.col("ten"))).alias("ten_imbalance"),
        F.median(deep(F.col("ten_weighted"))).alias("ten_weighted"), F.median(deep(X.microprice_bps("b", "a", "p", "q"))).alias("microprice"), F.count(deep(F.col("ten"))).alias("ten_valid"), F.count_if("same").alias("same_bid"), F.count_if("rise").alias("same_bid_rise"))
    two = F.col("valid") >= 2
    return sums.withColumn("change", F.when(two, 100 * (F.col("last_mid") / F.col("first_mid") - 1))).withColumn("recovery", F.when(two, 100 * (F.col("last_mid") / F.col("low") - 1))).withColumn("low", F.when(two, F.col("low")))
