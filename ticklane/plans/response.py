"""How quotes moved with the flow between them, and what displayed size did after it fell, by security, day and part of the session.

An interval lies between two neighbouring quotes of one part of the session; one that is too long, or has an end without a mid, or
holds trades of unknown side, says nothing and is counted as such. Trades at a quote's very time belong to no interval, since
their order is not known. The interval that follows is looked at only from one that says something. Descriptive, not causal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklane.functions import exprs as X
from ticklane.plans.micro import displayed_recovery

#: Parts of the session, from a clock (HHMMSSmmm) to before another; what comes after 14:57 is an auction.
WINDOWS = ((1, 93000000, 100000000), (2, 100000000, 103000000), (3, 103000000, 113000001), (4, 130000000, 140000000), (5, 140000000, 145700000))
MAX_GAP_MS = 10_000
KEY = ["code", "day"]


def window_of(t: str) -> Column:
    part = F.lit(None).cast("int")
    for n, start, end in WINDOWS:
        part = F.when((F.col(t) >= start) & (F.col(t) < end), n).otherwise(part)
    return part


def mid(bid: str, ask: str) -> Column:
    good = X.finite(bid) & X.finite(ask) & (F.col(bid) > 0) & (F.col(ask) >= F.col(bid))
    return F.when(good, (F.col(bid) + F.col(ask)) / 20000)


def _timeline(trades: DataFrame, quotes: DataFrame) -> DataFrame:
    """Trades and quotes as rows of one shape; what is wrong with a row is marked on it. A quote outside the parts is kept for its
    marks alone."""
    none = lambda kind: F.lit(None).cast(kind)
    flag = lambda c: F.coalesce(c, F.lit(True)).cast("int")
    ticks = trades.select(
        *KEY, X.ms_of_day("t").alias("ms"), none("int").alias("part"), none("double").alias("mid"), (F.col("price") * F.col("qty")).alias("amount"), F.coalesce("side", F.lit("?")).alias("side"), F.lit("T").alias("kind"),
        flag(~X.clock_valid("t")).alias("trade_clock"), flag(~X.traded("price", "qty")).alias("trade_print"), F.lit(0).alias("quote_date"), F.lit(0).alias("quote_clock"),
    )
    part = window_of("t")
    bad_clock = F.col("t").isNull() | (part.isNotNull() & ~X.clock_valid("t"))
    seen = quotes.select(
        *KEY, F.when(part.isNotNull(), X.ms_of_day("t")).alias("ms"), part.alias("part"), mid("bid", "ask").alias("mid"), none("double").alias("amount"), none("string").alias("side"), F.when(part.isNotNull(), "Q").otherwise("-").alias("kind"),
        F.lit(0).alias("trade_clock"), F.lit(0).alias("trade_print"), flag(F.col("trade_day") != F.col("day").cast("string")).alias("quote_date"), flag(bad_clock).alias("quote_clock"),
    )
    return ticks.unionByName(seen)


def _intervals(both: DataFrame) -> DataFrame:
    """A row for each quote: its time, part and mid, and the flow strictly after it and before the next quote. All windows and sums are
    of one security's day, so there is one shuffle."""
    upto = Window.partitionBy(*KEY).orderBy("ms")
    quote = F.when(F.col("kind") == "Q", 1)
    numbered = both.withColumn("number", F.count(quote).over(upto.rangeBetween(Window.unboundedPreceding, 0))).withColumn("tied", F.count(quote).over(upto.rangeBetween(0, 0)))
    of_quote = lambda c: F.max(F.when(F.col("kind") == "Q", F.col(c))).alias(c)
    between = (F.col("kind") == "T") & (F.col("tied") == 0)
    traded = lambda which: F.coalesce(F.sum(F.when(between & which, F.col("amount"))), F.lit(0.0))
    buy, sell = F.col("side") == "B", F.col("side") == "S"
    return numbered.groupBy(*KEY, "number").agg(
        of_quote("ms"), of_quote("part"), of_quote("mid"), F.count(quote).alias("quotes"), (traded(buy) - traded(sell)).alias("flow"), traded(~buy & ~sell).alias("unknown"), traded(F.lit(True)).alias("traded"),
        *(F.max(c).alias(c) for c in ("trade_clock", "trade_print", "quote_date", "quote_clock")))


def _pairs(rows: DataFrame, longest: int) -> DataFrame:
    """Neighbouring quotes of a part: state (gap, invalid, unknown, zero or flow), aligned and next_aligned in basis points."""
    along = Window.partitionBy(*KEY, "part").orderBy("ms")
    ahead = lambda c, k: F.lead(c, k).over(along)
    rows = rows.where("part IS NOT NULL").withColumn("end", ahead("ms", 1)).withColumn("end_mid", ahead("mid", 1)).withColumn("then", ahead("ms", 2)).withColumn("then_mid", ahead("mid", 2))
    gap, length = F.col("end") - F.col("ms"), F.greatest(F.lit(1e-7), F.col("traded") * 1e-10)
    state = (
        F.when(F.col("end").isNull(), None).when((gap <= 0) | (gap > longest), "gap").when(F.col("mid").isNull() | F.col("end_mid").isNull(), "invalid")
        .when(F.col("unknown") > 1e-7, "unknown").when((F.col("traded") <= 1e-7) | (F.abs("flow") <= length), "zero").otherwise("flow")
    )
    way = F.when(state == "flow", F.signum("flow") * 10000)
    near = F.col("then_mid").isNotNull() & (F.col("then") > F.col("end")) & (F.col("then") - F.col("end") <= longest)
    return rows.select(*KEY, "part", state.alias("state"), (way * (F.col("end_mid") / F.col("mid") - 1)).alias("aligned"), F.when(near, way * (F.col("then_mid") / F.col("end_mid") - 1)).alias("next_aligned"))


def quote_response(trades: DataFrame, quotes: DataFrame, longest: int = MAX_GAP_MS) -> DataFrame:
    """By security and day (code, day) and part of the session: counts of quotes and of intervals by what they say, median, mean and
    positive share of the moves in the flow's direction, zero moves, and the same for the following interval.

    trades: code, day, t, price, qty, side (null: unknown); quotes: code, day, trade_day, t, bid, ask (ten-thousandths). Status, the first
    that holds: INVALID_TRADE_CLOCK, INVALID_TRADE_PRINT, INVALID_QUOTE_DATE, INVALID_QUOTE_CLOCK, DUPLICATE_QUOTE_TIME (one row
    without a part), else NO_COMPARABLE_PAIRS or AVAILABLE (five rows). A day without quotes has five parts of no quotes."""
    rows = _intervals(_timeline(trades, quotes))
    flags = rows.groupBy(*KEY).agg(*(F.max(c).alias(c) for c in ("trade_clock", "trade_print", "quote_date", "quote_clock")), F.max("quotes").alias("most"))
    fault = (
        F.when(F.col("trade_clock") == 1, "INVALID_TRADE_CLOCK").when(F.col("trade_print") == 1, "INVALID_TRADE_PRINT").when(F.col("quote_date") == 1, "INVALID_QUOTE_DATE")
        .when(F.col("quote_clock") == 1, "INVALID_QUOTE_CLOCK").when(F.col("most") > 1, "DUPLICATE_QUOTE_TIME")
    )
    parts = F.when(fault.isNull(), F.array(*(F.lit(n) for n, _, _ in WINDOWS))).otherwise(F.array(F.lit(None).cast("int")))
    frame = flags.select(*KEY, fault.alias("fault"), F.explode(parts).alias("part"))
    said = lambda s: F.count_if(F.coalesce(F.col("state") == s, F.lit(False)))
    sums = _pairs(rows, longest).groupBy(*KEY, "part").agg(
        F.count("*").alias("quotes"), F.count("state").alias("pairs"), *(said(s).alias(f"{s}_pairs") for s in ("gap", "invalid", "unknown", "zero", "flow")),
        F.median("aligned").alias("median_bps"), F.avg("aligned").alias("mean_bps"), (100 * F.avg((F.col("aligned") > 0).cast("int"))).alias("positive_share"), F.count_if(F.abs("aligned") < 1e-9).alias("zero_moves"),
        F.count("next_aligned").alias("next_pairs"), F.median("next_aligned").alias("next_median_bps"), F.avg("next_aligned").alias("next_mean_bps"))
    counts = ["quotes", "pairs", "gap_pairs", "invalid_pairs", "unknown_pairs", "zero_pairs", "flow_pairs", "zero_moves", "next_pairs"]
    whole = frame.join(sums, [*KEY, "part"], "left")
    some = F.max("flow_pairs").over(Window.partitionBy(*KEY)) > 0
    status = F.coalesce("fault", F.when(some, "AVAILABLE").otherwise("NO_COMPARABLE_PAIRS"))
    filled = (F.when(F.col("fault").isNull(), F.coalesce(c, F.lit(0))).alias(c) for c in counts)
    return whole.withColumn("status", status).select(*KEY, "part", "status", *filled, "median_bps", "mean_bps", "positive_share", "next_median_bps", "next_mean_bps")


def recovery_by_part(book: DataFrame) -> DataFrame:
    """Displayed recovery by code, day, side and the session's part (book: those, t, price, qty; parts as for flow, the last to its end).

    A row whose clock can't be right makes its part INVALID_CLOCK, with null figures; a part without two rows at one price is
    NO_COMPARABLE. median_ms is the time to recovery. Only a part's rows are folded together."""
    key = [*KEY, "side", "part"]
    rows = book.withColumn("part", X.segment("t")).where("part IS NOT NULL").withColumn("good", X.clock_valid("t")).withColumn("ms", X.ms_of_day("t"))
    gates = rows.groupBy(*key).agg(F.bool_and("good").alias("good"))
    folded = displayed_recovery(rows.where("good"), key, "ms")
    whole = gates.join(folded, key, "left")
    known = lambda c: F.when(F.col("good"), F.col(c)).alias(c)
    status = F.when(~F.col("good"), "INVALID_CLOCK").when(F.col("pairs") > 0, "OBSERVED").otherwise("NO_COMPARABLE")
    return whole.select(*key, status.alias("status"), known("pairs"), known("declines"), known("recovered"), known("censored"), known("median_time").alias("median_ms"))
