"""The whole follow-up of flow events: which sessions are studied and why others aren't, every event at every horizon with its outcome, its
pool, the next session's gate and the path of closes, and sums with each session's share in them.

Sessions are numbered without gaps by the calendar. A session whose flow isn't held, or lacks in the one before, is never bridged; two adjacent
sessions of different sources, or of one whose sides are unknown, are never compared. Nothing after ``asof`` is looked at. Null or impossible
prices leave figures null; empty tables give no rows; a row that stands twice in a table of facts, prices or bars is an error of the caller's."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklane.functions import exprs as X
from ticklane.operators.timeline import leave_one_out
from ticklane.plans.contrasts import close_paths, status_counts

#: Sources whose sides are known.
PERMITTED = ("NATIVE", "LEGACY_CALIBRATED_ROW_GUARD")
GROUP = ["cohort", "kind", "horizon"]
#: Digits of values whose median is taken: equal ones are counted, so a group's memory is bounded by their range, not by its rows.
MEDIAN_DIGITS = 4


@dataclass(frozen=True)
class Span:
    """Events of sessions start to end; prices up to asof; split is the last session of training."""

    start: int
    end: int
    asof: int
    split: int
    horizons: tuple[int, ...] = (1, 3, 5)

    def __post_init__(self):
        if not self.start <= self.end <= self.asof or not self.start <= self.split < self.end:
            raise ValueError(f"start <= end <= asof and start <= split < end, not {self}")
        if not self.horizons or len(set(self.horizons)) != len(self.horizons) or any(type(h) is not int or h < 1 for h in self.horizons):
            raise ValueError(f"different horizons of whole sessions from 1, not {self.horizons}")


def signal_days(calendar: DataFrame, sources: DataFrame, span: Span) -> DataFrame:
    """Each session i of the span: status STUDIED, MISSING_FLOW (with the sessions that lack) or CROSSING_SOURCES, previous_source and source.

    ``sources`` has a row (i, source) for each session whose flow is held."""
    held = sources.select("i", "source")
    before = held.select((F.col("i") + 1).alias("i"), F.col("source").alias("previous_source"), F.lit(True).alias("has_previous"))
    days = calendar.select("i").distinct().where(F.col("i").between(span.start, span.end))
    rows = days.join(before, "i", "left").join(held.withColumn("has", F.lit(True)), "i", "left")
    missing = F.array_compact(F.array(F.when(F.col("has_previous").isNull(), F.col("i") - 1), F.when(F.col("has").isNull(), F.col("i"))))
    same = F.col("source").isin(*PERMITTED) & (F.col("source") == F.col("previous_source"))
    status = F.when(F.size("missing") > 0, "MISSING_FLOW").when(~F.coalesce(same, F.lit(False)), "CROSSING_SOURCES").otherwise("STUDIED")
    return rows.withColumn("missing", missing).select("i", status.alias("status"), "missing", "previous_source", "source")


def observations(facts: DataFrame, prices: DataFrame, bars: DataFrame, days: DataFrame, span: Span) -> DataFrame:
    """Every event of the studied sessions at every horizon: cohort, status (PENDING, MISSING_PRICE, OBSERVED), ratios, closes, outcome; the mean
    outcome of the pool (codes usable in the session and the one before, events or not), how many it is of, and the excess; the gate of the next
    session's bar; and the deepest fall of the closes on the way, with its sessions and a status.

    facts: code, i, amount, net, unknown, ratio; prices: code, i, close; bars: code, i, o, h, l, c, volume."""
    studied = days.where("status = 'STUDIED'").select("i")
    usable = facts.where(X.usable_event()).select("code", "i", "ratio")
    before = usable.select("code", (F.col("i") + 1).alias("i"), F.col("ratio").alias("before"))
    pool = usable.join(studied, "i").join(before, ["code", "i"]).withColumn("kind", X.event_kind("before", "ratio"))
    spread = pool.withColumn("horizon", F.explode(F.array(*map(F.lit, span.horizons)))).withColumn("target", F.col("i") + F.col("horizon"))
    mature = F.col("target") <= span.asof
    good = prices.where(X.finite("close") & (F.col("close") > 0)).select("code", "i", "close")
    later = good.where(F.col("i") <= span.asof).select("code", F.col("i").alias("target"), F.col("close").alias("later"))
    priced = spread.join(good, ["code", "i"], "left").join(later, ["code", "target"], "left").withColumn("outcome", F.when(mature, X.percent_return("later", "close")))
    means = priced.groupBy("i", "horizon").agg(F.avg("outcome").alias("benchmark"), F.count("outcome").alias("pool_n"))
    next_bar = bars.where(F.col("i") <= span.asof).select("code", (F.col("i") - 1).alias("i"), "o", "h", "l", "c", "volume", F.lit(True).alias("there"))
    gate = F.when(F.col("i") + 1 > span.asof, "PENDING").otherwise(X.entry_gate("o", "h", "l", "c", "volume", F.col("there").isNotNull()))
    events = pool.where("kind IS NOT NULL").select("code", "i", "kind")
    paths = close_paths(events, good.where(F.col("i") <= span.asof), list(span.horizons)).drop("kind")
    rows = priced.where("kind IS NOT NULL").join(means, ["i", "horizon"]).join(next_bar, ["code", "i"], "left").join(paths, ["code", "i", "horizon"], "left")
    status = F.when(~mature, "PENDING").when(F.col("outcome").isNull(), "MISSING_PRICE").otherwise("OBSERVED")
    path_status = F.when(~mature, "PENDING").when(F.col("drawdown").isNull(), "MISSING_PRICE").otherwise("OBSERVED")
    return rows.select(
        "code", "i", "kind", "horizon", "target", X.cohort("i", span.split, max(span.horizons)).alias("cohort"), status.alias("status"), "before", "ratio", (F.col("ratio") - F.col("before")).alias("change"), "close", "later",
        "outcome", "benchmark", "pool_n", (F.col("outcome") - F.col("benchmark")).alias("excess"), gate.alias("gate"), path_status.alias("path_status"), *(F.when(mature, F.col(c)).alias(c) for c in ("drawdown", "peak_i", "trough_i")))


def breakdown(rows: DataFrame) -> DataFrame:
    """By cohort, kind, horizon and session: events by status, and the means of outcomes and excesses beside the session's pool."""
    n = lambda s: F.count_if(F.col("status") == s)
    return rows.groupBy(*GROUP, "i").agg(
        F.count("*").alias("events"), n("OBSERVED").alias("observed"), n("PENDING").alias("pending"), n("MISSING_PRICE").alias("missing_price"), F.avg("outcome").alias("mean_outcome"), F.max("benchmark").alias("benchmark"),
        F.max("pool_n").alias("pool_n"), F.avg("excess").alias("mean_excess"), F.sum("outcome").alias("s"), F.sum("excess").alias("e"), F.count("excess").alias("en"), F.count_if(F.col("outcome") > 0).alias("positive"))


def summary(rows: DataFrame) -> DataFrame:
    """By cohort, kind and horizon: counts, means, medians, share of rises, the pool's mean size, counts of gates as a map, the mean of session means
    and its range with one session left out, and ``days``: an array with a struct of each session's figures, in order."""
    by_day = breakdown(rows)
    day = F.struct("i", "events", "observed", "pending", "missing_price", "mean_outcome", "benchmark", F.when(F.col("events") > F.col("pending"), F.col("pool_n")).alias("pool_n"), "mean_excess")
    total = lambda c: F.sum(c).alias(c)
    sums = by_day.groupBy(*GROUP).agg(
        *map(total, ("events", "observed", "pending", "missing_price", "positive", "s", "e", "en")), F.sum(F.col("pool_n") * F.col("observed")).alias("pools"), F.count_if(F.col("observed") > 0).alias("signal_days"), F.count("*").alias("trigger_days"),
        F.avg("mean_excess").alias("equal_day_mean"), F.count("mean_excess").alias("excess_days"), F.sum("mean_excess").alias("ds"), F.min("mean_excess").alias("da"), F.max("mean_excess").alias("db"), F.array_sort(F.collect_list(day)).alias("days"))
    low, high = leave_one_out("ds", "excess_days", "da", "db")
    share = lambda a, b: F.try_divide(F.col(a), F.nullif(F.col(b), F.lit(0)))
    middle = rows.groupBy(*GROUP).agg(F.median(X.rounded("outcome", MEDIAN_DIGITS)).alias("median_outcome"), F.median(X.rounded("drawdown", MEDIAN_DIGITS)).alias("median_drawdown"), F.count("drawdown").alias("paths"))
    told = sums.select(
        *GROUP, "events", "observed", "pending", "missing_price", "signal_days", "trigger_days", share("s", "observed").alias("mean_outcome"), share("positive", "observed").alias("positive_share"), share("e", "en").alias("mean_excess"),
        share("pools", "observed").alias("mean_pool_n"), "equal_day_mean", low.alias("least_without_one"), high.alias("most_without_one"), "days")
    return told.join(middle, GROUP).join(status_counts(rows, GROUP, "gate"), GROUP)
