"""Studies of events beyond their outcomes: the next session's open as a reference, paths of closes, paired contrasts.

Events are (code, i, kind), i numbering the sessions. An empty table gives no rows; an unknown price leaves a figure null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklane.functions import exprs as X
from ticklane.operators.timeline import drawdown, leave_one_out


def adjusted_open(gate: Column, o: Column, c: Column, adjusted_close: Column) -> Column:
    """The open on the scale of the adjusted closes, where the gate lets it stand as a reference."""
    return F.when(gate.isin("ONE_PRICE_SESSION", "PRICE_REFERENCE_ONLY") & (adjusted_close > 0) & (c > 0), o * adjusted_close / c)


def at_horizons(events: DataFrame, closes: DataFrame, horizons: list[int]) -> DataFrame:
    """Each event at each horizon with the closes of its session and of the target (null if missing) and whether the calendar
    reaches that far (mature)."""
    last = closes.agg(F.max("i").alias("last"))  # one row
    spread = events.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).withColumn("target", F.col("i") + F.col("horizon"))
    now = closes.select("code", "i", F.col("close").alias("now"))
    then = closes.select("code", F.col("i").alias("target"), F.col("close").alias("then"))
    rows = spread.join(now, ["code", "i"], "left").join(then, ["code", "target"], "left").join(F.broadcast(last))
    return rows.withColumn("mature", F.col("target") <= F.col("last")).drop("last")


def open_references(events: DataFrame, bars: DataFrame, closes: DataFrame, horizons: list[int]) -> DataFrame:
    """By kind and horizon: events, pending, without an outcome, observed; what the gate said of the next session's bar, as a
    map; the mean gap from the signal's close to the next open; and for horizons of two and more the mean changes from signal
    and from that open to the target, over the events that have both."""
    next_bar = bars.select("code", (F.col("i") - 1).alias("i"), "o", "h", "l", "c", "volume", F.lit(True).alias("there"))
    next_close = closes.select("code", (F.col("i") - 1).alias("i"), F.col("close").alias("next_close"))
    opened = events.join(next_bar, ["code", "i"], "left").join(next_close, ["code", "i"], "left")
    opened = opened.withColumn("gate", X.entry_gate("o", "h", "l", "c", "volume", F.col("there").isNotNull()))
    opened = opened.withColumn("reference", adjusted_open(F.col("gate"), F.col("o"), F.col("c"), F.col("next_close"))).select("code", "i", "kind", "gate", "reference")
    rows = at_horizons(opened, closes, horizons).withColumn("outcome", F.when(F.col("mature"), X.percent_return("then", "now"))).withColumn("gap", F.when(F.col("mature"), X.percent_return("reference", "now")))
    after = F.when((F.col("horizon") >= 2) & F.col("outcome").isNotNull(), X.percent_return("then", "reference"))
    rows = rows.withColumn("after", after).withColumn("paired", F.when(F.col("after").isNotNull(), F.col("outcome")))
    keys = ["kind", "horizon"]
    gates = status_counts(rows.where("mature"), keys, "gate")
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("events"), F.count_if(~F.col("mature")).alias("pending"), F.count_if(F.col("mature") & F.col("outcome").isNull()).alias("missing_price"), F.count("outcome").alias("observed"), F.count("gap").alias("open_observed"),
        F.avg("gap").alias("mean_gap"), F.count("after").alias("after_observed"), F.avg("paired").alias("mean_to_target"), F.avg("after").alias("mean_after_open"))
    return sums.join(gates, keys, "left")


def status_counts(rows: DataFrame, keys: list[str], status: str) -> DataFrame:
    """How often each status stands, as one map a key, in the order of the statuses; a map holds as many entries as there are
    statuses, whatever the rows."""
    counts = rows.groupBy(*keys, status).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(status, "n")))).alias(f"{status}s"))


def close_paths(events: DataFrame, closes: DataFrame, horizons: list[int]) -> DataFrame:
    """Drawdown of the closes from an event's session to its target, with the sessions of its peak and trough; null if any
    session of the path has no close. A path is horizon + 1 closes."""
    spread = events.select("code", "i", "kind", F.explode(F.array(*map(F.lit, horizons))).alias("horizon"))
    steps = spread.withColumn("s", F.explode(F.sequence(F.col("i"), F.col("i") + F.col("horizon"))))
    rows = steps.join(closes.select("code", F.col("i").alias("s"), "close"), ["code", "s"], "left")
    path = F.array_sort(F.collect_list(F.struct("s", F.col("close").cast("double").alias("v"))))
    paths = rows.groupBy("code", "i", "kind", "horizon").agg(path.alias("path"))
    dd = drawdown(F.transform("path", lambda p: F.struct(p["v"].alias("v"), p["s"].cast("string").alias("at"))))
    return paths.withColumn("d", dd).select("code", "i", "kind", "horizon", F.col("d.dd").alias("drawdown"), F.col("d.peak").cast("long").alias("peak_i"), F.col("d.trough").cast("long").alias("trough_i"))


def _range(days: DataFrame, keys: list[str], value: str) -> DataFrame:
    sums = days.groupBy(*keys).agg(F.count("*").alias("days"), F.avg(value).alias("mean"), F.sum(value).alias("s"), F.min(value).alias("a"), F.max(value).alias("b"))
    low, high = leave_one_out("s", "days", "a", "b")
    return sums.withColumn("least_without_one", low).withColumn("most_without_one", high).drop("s", "a", "b")


def day_pairs(rows: DataFrame) -> DataFrame:
    """By market direction: sessions with outcomes on both sides, the mean of their spreads (improving less weakening), and its
    range with one session left out. Rows: i, market, stock, outcome."""
    side = lambda s: F.avg(F.when(F.col("stock") == s, F.col("outcome")))
    days = rows.groupBy("market", "i").agg((side("improving") - side("weakening")).alias("spread")).where("spread IS NOT NULL")
    return _range(days, ["market"], "spread")


def board_contrasts(rows: DataFrame) -> DataFrame:
    """By market direction and board (and ALL): pairs inside a session and board, averaged over a session's boards, then over
    sessions: the mean spread, the median session, the spread of median stocks, the mean over pairs with three and more on
    each side, and the range with one session left out."""
    mine = lambda s: F.when(F.col("stock") == s, F.col("outcome"))
    up, down = mine("improving"), mine("weakening")
    pairs = rows.groupBy("market", "i", "board").agg(
        F.count(up).alias("improving"), F.count(down).alias("weakening"), (F.avg(up) - F.avg(down)).alias("spread"), (F.median(up) - F.median(down)).alias("median_spread")).where("spread IS NOT NULL")
    both = pairs.withColumn("board", F.explode(F.array(F.lit("ALL"), "board")))
    three = F.when((F.col("improving") >= 3) & (F.col("weakening") >= 3), F.col("spread"))
    days = both.groupBy("market", "board", "i").agg(
        F.count("*").alias("boards"), F.sum("improving").alias("improving"), F.sum("weakening").alias("weakening"), F.avg("spread").alias("spread"), F.avg("median_spread").alias("median_spread"), F.avg(three).alias("three"))
    keys = ["market", "board"]
    sums = days.groupBy(*keys).agg(
        F.sum("boards").alias("board_days"), F.sum("improving").alias("improving"), F.sum("weakening").alias("weakening"), F.median("spread").alias("median_day"), F.avg("median_spread").alias("mean_median_spread"), F.count("three").alias("three_days"), F.avg("three").alias("three_spread"))
    return sums.join(_range(days, keys, "spread"), keys)


def source_strata(days: DataFrame, sources: DataFrame) -> DataFrame:
    """By the pair of sources of a session and the one before: sessions with events, those with a mean excess, their events,
    and the mean of the means. days: i, observed, excess; sources: i, source; a session without a source is unknown."""
    was = sources.select((F.col("i") + 1).alias("i"), F.col("source").alias("source_prev"))
    rows = days.join(sources, "i", "left").join(was, "i", "left")
    pair = F.concat_ws(" > ", F.coalesce("source_prev", F.lit("unknown")), F.coalesce("source", F.lit("unknown")))
    seen = F.col("excess").isNotNull()
    return rows.groupBy(pair.alias("pair")).agg(F.count("*").alias("trigger_days"), F.count("excess").alias("comparable_days"), F.coalesce(F.sum(F.when(seen, F.col("observed"))), F.lit(0)).alias("comparable_events"), F.avg("excess").alias("mean_excess"))
