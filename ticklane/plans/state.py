"""Continuous state over calendar sessions: levels, changes, runs, slopes, drawdowns, events, peers, breadth.

Every window figure is null unless all sessions of the window are usable; missing sessions are never bridged."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticklane.functions import exprs as X
from ticklane.operators.timeline import drawdown, equal_count_group, grid, midrank_percentile, previous_session, trailing_run


def panel(facts: DataFrame) -> DataFrame:
    """Facts on the dense grid of codes and sessions."""
    return grid(facts.select("code").distinct(), facts.select("i").distinct(), facts, ["code", "i"])


def merged(flow: DataFrame, prices: DataFrame) -> DataFrame:
    """Flow facts (code, i, amount, net, unknown, ratio) and closes (code, i, close) side by side, whichever of the two a code has in a
    session, with ``evidence``: BOTH, FLOW or PRICE. Neither fills a gap of the other."""
    rows = flow.select("code", "i", "amount", "net", "unknown", "ratio", F.lit(True).alias("in_flow")).join(prices.where("close IS NOT NULL").select("code", "i", "close"), ["code", "i"], "full_outer")
    evidence = F.when(F.col("in_flow") & F.col("close").isNotNull(), "BOTH").when(F.col("in_flow"), "FLOW").otherwise("PRICE")
    return rows.withColumn("evidence", evidence).drop("in_flow")


def universe_panel(universe: DataFrame, sessions: DataFrame, facts: DataFrame) -> DataFrame:
    """Every code of the universe at every session, those without any fact too; codes outside it are left out."""
    return grid(universe.select("code").distinct(), sessions.select("i").distinct(), facts, ["code", "i"])


def states(dense: DataFrame, n: int = 5) -> DataFrame:
    """State of each code at each session over the window of the last n sessions (fewer at the calendar's start: status
    PARTIAL)."""
    rows = dense.withColumn("u", X.usable_state()).withColumn("level", F.when(F.col("u"), F.col("ratio")))
    rows = rows.withColumn("sign", F.signum("level"))
    rows = previous_session(rows, ["code"], "i", ["level", "sign", "amount"])
    order = Window.partitionBy("code").orderBy("i")
    span = order.rowsBetween(-(n - 1), Window.currentRow)
    full = F.sum(F.col("u").cast("int")).over(span) == n
    x = F.col("i").cast("double")
    count = F.count("level").over(span)
    sx, sy = F.sum(x).over(span), F.sum("level").over(span)
    slope = (F.lit(n) * F.sum(x * F.col("level")).over(span) - sx * sy) / F.nullif(F.lit(n) * F.sum(x * x).over(span) - sx * sx, F.lit(0.0))
    rows = rows.withColumn("delta", F.col("level") - F.col("level_prev"))
    rows = rows.withColumn("weighted", F.when(full, 100 * F.sum("net").over(span) / F.sum("amount").over(span)))
    rows = rows.withColumn("slope", F.when(full & (F.lit(n) > 1), slope)).withColumn("valid", count).withColumn("positive_days", F.count_if(F.col("level") > 0).over(span))
    rows = rows.withColumn("status", F.when(full, "AVAILABLE").otherwise("PARTIAL"))
    rows = trailing_run(rows, ["code"], "i", F.col("u") & (F.col("sign") == F.coalesce("sign_prev", "sign")) & F.col("level_prev").isNotNull(), "same")
    # a run of k equal pairs is k + 1 sessions long
    streak = F.when(F.col("level").isNotNull(), F.least(F.col("same") + 1, F.lit(n)))
    rows = rows.withColumn("streak", streak).withColumn("left_censored", F.coalesce(F.col("streak") == n, F.lit(False)))
    for name, holds in (("improve", F.col("level") > F.col("level_prev")), ("worsen", F.col("level") < F.col("level_prev"))):
        rows = trailing_run(rows, ["code"], "i", holds, name)
        rows = rows.withColumn(name, F.when(F.col("level").isNotNull(), F.least(F.col(name), F.lit(n - 1))))
    rows = rows.withColumn("amount_change", F.when((F.col("amount") > 0) & (F.col("amount_prev") > 0), 100 * (F.col("amount") / F.col("amount_prev") - 1)))
    prior = order.rowsBetween(-(n - 1), -1)
    prior_mean = F.when((F.count("amount").over(prior) == n - 1) & F.col("amount").isNotNull(), F.avg("amount").over(prior))
    rows = rows.withColumn("amount_relative", 100 * (F.col("amount") / prior_mean - 1))
    longer = order.rowsBetween(-n, Window.currentRow)
    path = F.collect_list(F.struct(F.col("close").alias("v"), F.col("i").alias("at"))).over(longer)
    rows = rows.withColumn("path", F.when(F.count("close").over(longer) == n + 1, path)).withColumn("dd", drawdown(F.col("path")))
    rows = rows.withColumn("price_return", 100 * (F.col("close") / F.get("path", F.lit(0))["v"] - 1))
    return rows.select(
        "code", "i", "status", "valid", "positive_days", "level", X.rounded("delta").alias("delta"), X.rounded("weighted").alias("weighted"), X.rounded("slope", 6).alias("slope"),
        "streak", "left_censored", "improve", "worsen", X.rounded("amount_change").alias("amount_change"), X.rounded("amount_relative").alias("amount_relative"),
        X.rounded("price_return").alias("price_return"), X.rounded("dd.dd").alias("drawdown"), F.col("dd.peak").cast("long").alias("peak_i"), F.col("dd.trough").cast("long").alias("trough_i"),
    )


def flow_events(facts: DataFrame) -> DataFrame:
    """Events between adjacent usable sessions."""
    rows = facts.withColumn("u", X.usable_event())
    both = previous_session(rows, ["code"], "i", ["ratio", "u"])
    return both.where("u AND u_prev").withColumn("kind", X.event_kind("ratio_prev", "ratio")).where("kind IS NOT NULL").select("code", "i", "kind", F.col("ratio_prev").alias("before"), "ratio")


def lifecycles(facts: DataFrame) -> DataFrame:
    """Status of each event after all later sessions of the grid, and the session at which it was settled; the first later
    row that isn't ACTIVE decides, however late. One pass over each code's sessions, from the last to the first."""
    dense = previous_session(panel(facts).withColumn("u", X.usable_event()), ["code"], "i", ["ratio", "u"])
    rows = dense.withColumn("kind", F.when(F.col("u") & F.col("u_prev"), X.event_kind("ratio_prev", "ratio")))
    later = Window.partitionBy("code").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    settled = F.lit(None)
    for kind in ("SELL_TO_BUY", "BUY_TO_SELL", "SELL_EASING", "SELL_WORSENING"):
        step = X.lifecycle_step(F.lit(kind), "ratio_prev", "ratio", "u")
        rows = rows.withColumn(kind, F.last(F.when(step != "ACTIVE", F.struct(F.col("i").alias("later"), step.alias("step"))), ignorenulls=True).over(later))
        settled = F.when(F.col("kind") == kind, F.col(kind)).otherwise(settled)
    rows = rows.where("kind IS NOT NULL").withColumn("s", settled)
    return rows.select("code", "i", "kind", F.coalesce("s.step", F.lit("ACTIVE")).alias("status"), F.col("s.later").alias("settled_i"))


def peers(facts: DataFrame, caps: DataFrame) -> DataFrame:
    """In each session: groups of equal count by market value and by amount, the number of levels in both groups, and the
    midrank percentile of the level inside both. A session's codes are ordered in one task, sessions in many."""
    rows = facts.join(caps, "code")
    for name, by in (("size", "cap"), ("liquidity", "amount")):
        known = F.col(by).isNotNull()
        rows = equal_count_group(rows.withColumn("ranked", known), ["i", "ranked"], [by, "code"], f"{name}_group")
        rows = rows.withColumn(f"{name}_group", F.when(known, F.col(f"{name}_group")))
        rows = rows.withColumn(f"{name}_peers", F.when(known, F.count("ratio").over(Window.partitionBy("i", f"{name}_group"))))
        rows = midrank_percentile(rows, ["i", f"{name}_group"], "ratio", f"{name}_percentile")
        rows = rows.withColumn(f"{name}_percentile", F.when(known, F.col(f"{name}_percentile")))
    return rows.drop("ranked")


def breadth(facts: DataFrame, start: int, end: int) -> DataFrame:
    """By session: figures of the codes usable in every session of the window, beside all that traded."""
    window = facts.where(F.col("i").between(start, end)).withColumn("u", X.usable_view())
    common = window.groupBy("code").agg(F.count_if("u").alias("k")).where(F.col("k") == end - start + 1).select("code", F.lit(True).alias("common"))
    rows = window.join(common, "code", "left")
    mine = lambda c: F.when(F.col("common"), F.col(c))
    return rows.groupBy("i").agg(
        F.sum("amount").alias("amount"), F.count("common").alias("common"), F.sum(mine("amount")).alias("common_amount"), F.sum(mine("net")).alias("common_net"),
        (100 * F.avg(F.when(F.col("common"), (F.col("ratio") > 0).cast("int")))).alias("buy_share"))


def change_counts(facts: DataFrame, i: int) -> DataFrame:
    """How the ratios moved from the session before i: one row of counts."""
    now = facts.where(F.col("i") == i).select("code", F.when(X.usable_view(), F.col("ratio")).alias("now"))
    was = facts.where(F.col("i") == i - 1).select("code", F.when(X.usable_view(), F.col("ratio")).alias("was"))
    a, b = F.col("was"), F.col("now")
    return now.join(was, "code", "full_outer").agg(
        F.count_if(b > a).alias("improve"), F.count_if(b < a).alias("worsen"), F.count_if(b == a).alias("flat"), F.count_if(a.isNull() | b.isNull()).alias("unknown"),
        F.count_if((a < 0) & (b > 0)).alias("to_buy"), F.count_if((a > 0) & (b < 0)).alias("to_sell"))
