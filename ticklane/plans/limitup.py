"""The study of securities at their upper limit: their own change of flow against the market's, and what came after.

Each session is looked at in a fixed order, and the first thing that is missing is its status; figures of later steps are null
then, not zero. Securities whose raw close agrees with the list and that have an adjusted close are the session's pool, which is
the benchmark, events or not; those whose own ratio moved are the events. Cells are cohort x horizon x market x stock, and empty
cells stay. An empty table of lists makes every session MISSING_LIMIT_LIST; no other table may be asked for more than it has."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklane.functions import exprs as X
from ticklane.operators.timeline import leave_one_out
from ticklane.plans.contrasts import adjusted_open, status_counts

#: Sources whose sides can be compared, and how far a raw close may be from the list's.
COMPARABLE_SOURCES, CLOSE_TOLERANCE = ("NATIVE", "LEGACY_CALIBRATED_ROW_GUARD"), 0.011
SIDES, COHORTS = ("IMPROVING", "WEAKENING"), ("TRAIN", "EMBARGO", "OUT_OF_SAMPLE")
CELL = ["cohort", "horizon", "market", "stock"]


@dataclass(frozen=True)
class Span:
    """Sessions of the signals (start to end), the last one of the training part, and the last one whose prices may be used."""

    start: int
    end: int
    split: int
    asof: int
    horizons: tuple[int, ...] = (1, 3, 5)

    def __post_init__(self):
        if not self.start <= self.split < self.end <= self.asof or not self.horizons or any(type(h) is not int or h < 1 for h in self.horizons):
            raise ValueError(f"sessions or horizons of a study: {self}")


def positive(c) -> Column:
    return F.coalesce(X.finite(c) & (X.col(c) > 0), F.lit(False))


def adjacent(flow: DataFrame) -> DataFrame:
    """Flow (code, i, amount, net, unknown, ratio) beside that of the session before (``_prev``), null if it has no row; ``both``: usable
    in both. One window by security instead of a join."""
    w = Window.partitionBy("code").orderBy("i")
    near = F.lag("i").over(w) == F.col("i") - 1
    before = lambda c: F.when(near, F.lag(c).over(w)).alias(f"{c}_prev")
    rows = flow.withColumn("usable", X.usable_event())
    rows = rows.select("code", "i", "amount", "net", "ratio", "usable", *(before(c) for c in ("amount", "net", "ratio", "usable")))
    return rows.withColumn("both", F.col("usable") & F.coalesce("usable_prev", F.lit(False)))


def market_change(pairs: DataFrame, apart: DataFrame) -> DataFrame:
    """By session: common (securities usable in it and before, those in ``apart`` left out), ratios before and now, delta and status:
    NO_COMMON_STOCKS (as a missing row), INVALID_AMOUNT, INVALID_RATIO or AVAILABLE."""
    sums = pairs.where("both").join(apart.select("code", "i").distinct(), ["code", "i"], "left_anti").groupBy("i").agg(F.count("*").alias("common"), *(F.sum(c).alias(c) for c in ("amount", "net", "amount_prev", "net_prev")))
    priced = positive("amount") & positive("amount_prev")
    before, now = F.when(priced, 100 * F.col("net_prev") / F.col("amount_prev")), F.when(priced, 100 * F.col("net") / F.col("amount"))
    rows = sums.select("i", "common", before.alias("ratio_before"), now.alias("ratio_now"), priced.alias("priced")).withColumn("delta", F.col("ratio_now") - F.col("ratio_before"))
    good = F.coalesce(X.finite("ratio_before") & X.finite("ratio_now") & X.finite("delta"), F.lit(False))
    status = F.when(~F.col("priced"), "INVALID_AMOUNT").when(~good, "INVALID_RATIO").otherwise("AVAILABLE")
    known = lambda c: F.when(status == "AVAILABLE", F.col(c)).alias(c)
    return rows.select("i", "common", known("ratio_before"), known("ratio_now"), known("delta"), status.alias("market_status"))


def _sessions(flow: DataFrame, pairs: DataFrame, sources: DataFrame, lists: DataFrame, listed: DataFrame, span: Span) -> DataFrame:
    """A row a session: eligible, the market's figures, and early: the status that ends it before its securities are looked at."""
    days = flow.sparkSession.range(span.start, span.end + 1).withColumnRenamed("id", "i")
    later = lambda rows, name: rows.withColumn("i", F.col("i") + 1).withColumnRenamed(name, f"{name}_prev")
    held = flow.select("i", F.lit(True).alias("flow")).distinct()
    told = sources.select("i", F.col("status").alias("source"))
    marks = lists.groupBy("i").agg(F.lit(True).alias("has_list")).join(listed.groupBy("i").agg(F.count("*").alias("eligible")), "i", "left")
    rows = days
    for part in (marks, held, later(held, "flow"), told, later(told, "source"), market_change(pairs, listed)):
        rows = rows.join(part, "i", "left")
    eligible = F.when(F.col("has_list"), F.coalesce("eligible", F.lit(0)))
    comparable = F.col("source").isin(*COMPARABLE_SOURCES) & F.col("source").eqNullSafe(F.col("source_prev"))
    seen = F.coalesce(F.col("flow") & F.col("flow_prev"), F.lit(False))
    before_market = (
        F.when(F.col("has_list").isNull(), "MISSING_LIMIT_LIST").when(eligible == 0, "NO_ELIGIBLE_U")
        .when(~seen, "MISSING_FLOW").when(~F.coalesce(comparable, F.lit(False)), "SOURCE_NOT_COMPARABLE")
    )
    flat = ~F.coalesce(F.col("delta") != 0, F.lit(False))
    rows = rows.withColumn("eligible", eligible).withColumn("before_market", before_market)
    asked = F.col("before_market").isNull()
    known = lambda c: F.when(asked, F.col(c)).alias(c)
    return rows.select(
        "i", "source", "source_prev", "eligible", F.when(asked, F.coalesce("common", F.lit(0))).alias("common"), known("ratio_before"), known("ratio_now"), known("delta"),
        F.when(asked, F.coalesce("market_status", F.lit("NO_COMMON_STOCKS"))).alias("market_status"), F.coalesce("before_market", F.when(flat, "MARKET_UNAVAILABLE_OR_FLAT")).alias("early"),
    )


def securities(sessions: DataFrame, pairs: DataFrame, listed: DataFrame, prices: DataFrame, bars: DataFrame) -> DataFrame:
    """The listed securities of the sessions that are looked at: code, i, board, market, state (what is missing of it, or MATCHED),
    now (adjusted close), amount and stock (null: no direction; FLAT)."""
    open_ = sessions.where("early IS NULL").select("i", F.when(F.col("delta") > 0, SIDES[0]).otherwise(SIDES[1]).alias("market"))
    rows = listed.select("code", "i", "board", F.col("close").alias("told")).join(F.broadcast(open_), "i")  # a row a session
    rows = rows.join(bars.select("code", "i", "c"), ["code", "i"], "left").join(prices.select("code", "i", F.col("close").alias("now")), ["code", "i"], "left")
    rows = rows.join(pairs.select("code", "i", "amount", "ratio", "ratio_prev", "both"), ["code", "i"], "left")
    state = F.when(~positive("c"), "MISSING_RAW").when(F.abs(F.col("c") - F.col("told")) > CLOSE_TOLERANCE, "MISMATCHED").when(~positive("now"), "MISSING_ADJUSTED").otherwise("MATCHED")
    moved = F.col("ratio") - F.col("ratio_prev")
    stock = F.when(F.col("both"), F.when(moved > 0, SIDES[0]).when(moved < 0, SIDES[1]).otherwise("FLAT"))
    return rows.select("code", "i", "board", "market", state.alias("state"), "now", "amount", F.when(state == "MATCHED", stock).alias("stock"))


def days(sessions: DataFrame, rows: DataFrame) -> DataFrame:
    """A row a session: study_status, the market's figures and what became of the listed securities (null where none were looked at)."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    matched, state, stock = F.col("state") == "MATCHED", F.col("state"), F.col("stock")
    counts = rows.groupBy("i").agg(
        n(matched).alias("matched"), n(state == "MISMATCHED").alias("mismatched"), n(state == "MISSING_RAW").alias("missing_raw"), n(state == "MISSING_ADJUSTED").alias("missing_adjusted"),
        n(stock.isin(*SIDES)).alias("directed"), n(matched & stock.isNull()).alias("undirected"), n(stock == "FLAT").alias("flat"),
    )
    status = F.coalesce("early", F.when(F.col("matched") == 0, "NO_VALID_U_PRICE").when(F.col("directed") == 0, "NO_VALID_STOCK_DIRECTION").otherwise("COMPARABLE"))
    return sessions.join(counts, "i", "left").withColumn("study_status", status).drop("early")


def outcomes(rows: DataFrame, prices: DataFrame, bars: DataFrame, span: Span) -> DataFrame:
    """Each event at each horizon: cohort, market, stock, mature, gate of the next session's bar, gap to its open, outcome, excess over
    the session's pool and over its board's, and the changes to the target from the open (horizons of two and more)."""
    price = prices.where(positive("close")).select("code", "i", "close")
    opened = bars.select("code", (F.col("i") - 1).alias("i"), "o", "h", "l", F.col("c").alias("next_c"), "volume", F.lit(True).alias("there"))
    pool = rows.where("state = 'MATCHED'").join(opened, ["code", "i"], "left").join(price.select("code", (F.col("i") - 1).alias("i"), F.col("close").alias("next_close")), ["code", "i"], "left")
    gate = X.entry_gate("o", "h", "l", "next_c", "volume", F.col("there").isNotNull())
    pool = pool.withColumn("gate", gate).withColumn("reference", adjusted_open(F.col("gate"), F.col("o"), F.col("next_c"), F.col("next_close")))
    pool = pool.select("code", "i", "board", "market", "stock", "now", "amount", "gate", "reference", F.explode(F.array(*map(F.lit, span.horizons))).alias("horizon")).withColumn("target", F.col("i") + F.col("horizon"))
    mature = F.col("target") <= span.asof
    pool = pool.join(price.select("code", F.col("i").alias("target"), F.col("close").alias("then")), ["code", "target"], "left").withColumn("mature", mature)
    pool = pool.withColumn("outcome", F.when(mature, X.percent_return("then", "now")))
    means = pool.groupBy("i", "horizon", "board").agg(F.sum("outcome").alias("s"), F.count("outcome").alias("n"))  # a row a session, horizon and board
    boards = means.select("i", "horizon", "board", (F.col("s") / F.nullif("n", F.lit(0))).alias("board_benchmark"))
    whole = means.groupBy("i", "horizon").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("benchmark"))
    events = pool.where(F.col("stock").isin(*SIDES)).join(whole, ["i", "horizon"]).join(boards, ["i", "horizon", "board"])
    gap = F.when(mature, X.percent_return("reference", "now"))
    after = F.when((F.col("horizon") >= 2) & F.col("outcome").isNotNull(), X.percent_return("then", "reference"))
    return events.select(
        X.cohort("i", span.split, max(span.horizons)).alias("cohort"), "horizon", "market", "stock", "code", "i", "board", "amount", "mature", F.when(mature, F.col("gate")).alias("gate"), gap.alias("gap"),
        "outcome", (F.col("outcome") - F.col("benchmark")).alias("excess"), (F.col("outcome") - F.col("board_benchmark")).alias("board_excess"), after.alias("after"), F.when(after.isNotNull(), F.col("outcome")).alias("paired"),
    )


def cell_days(events: DataFrame) -> DataFrame:
    """By cell and session: events, observed and the means of outcome and of both kinds of excess."""
    return events.groupBy(*CELL, "i").agg(F.count("*").alias("events"), F.count("outcome").alias("observed"), F.avg("outcome").alias("mean_return"), F.avg("excess").alias("mean_excess"), F.avg("board_excess").alias("mean_board_excess"))


def frame(events: DataFrame, span: Span) -> DataFrame:
    """All cells: cohort x horizon x market x stock."""
    spark = events.sparkSession
    rows = [(c, h, m, s) for c in COHORTS for h in span.horizons for m in SIDES for s in SIDES]
    return spark.createDataFrame(rows, "cohort string, horizon int, market string, stock string")


def cells(events: DataFrame, span: Span) -> DataFrame:
    """Every cell with its counts, pooled means, means of session means, their range with one session left out, gates (a map) and
    its sessions (``daily``, an array by session)."""
    by_day = cell_days(events)
    each = F.struct("i", "events", "observed", "mean_return", "mean_excess", "mean_board_excess")
    equal = by_day.groupBy(*CELL).agg(
        F.count("*").alias("trigger_days"), F.count("mean_excess").alias("comparable_days"), F.avg("mean_excess").alias("equal_day_excess"), F.avg("mean_board_excess").alias("equal_day_board_excess"),
        F.count("mean_board_excess").alias("board_days"), F.sum("mean_excess").alias("s"), F.min("mean_excess").alias("a"), F.max("mean_excess").alias("b"), F.array_sort(F.collect_list(each)).alias("daily"))
    low, high = leave_one_out("s", "comparable_days", "a", "b")
    equal = equal.withColumn("least_without_one", low).withColumn("most_without_one", high).drop("s", "a", "b")
    pooled = events.groupBy(*CELL).agg(
        F.count("*").alias("events"), F.count("outcome").alias("observed"), F.count_if(~F.col("mature")).alias("pending"), F.count_if(F.col("mature") & F.col("outcome").isNull()).alias("missing_price"),
        F.median("amount").alias("median_amount"), F.count("gap").alias("open_observed"), F.avg("gap").alias("mean_gap"), F.count("after").alias("after_observed"), F.avg("paired").alias("mean_to_target"), F.avg("after").alias("mean_after_open"),
        F.avg("outcome").alias("mean_return"), F.avg("excess").alias("mean_excess"))
    gates = status_counts(events.where("mature"), CELL, "gate")
    rows = frame(events, span)
    for part in (pooled, equal, gates):
        rows = rows.join(part, CELL, "left")
    return rows.na.fill(0, ["events", "observed", "pending", "missing_price", "open_observed", "after_observed", "trigger_days", "comparable_days", "board_days"])


def study(flow: DataFrame, sources: DataFrame, lists: DataFrame, listed: DataFrame, prices: DataFrame, bars: DataFrame, span: Span) -> tuple[DataFrame, DataFrame]:
    """(days, events): flow (code, i, amount, net, unknown, ratio), sources (i, status), lists (i: sessions whose list is there), listed
    (code, i, close, board), prices (code, i, close), bars (code, i, o, h, l, c, volume)."""
    inside = flow.where(F.col("i").between(span.start - 1, span.end))
    pairs = adjacent(inside)
    listed = listed.where(F.col("i").between(span.start, span.end))
    sessions = _sessions(inside, pairs, sources, lists, listed, span)
    rows = securities(sessions, pairs, listed, prices, bars)
    return days(sessions, rows), outcomes(rows, prices, bars, span)
