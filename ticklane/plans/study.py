"""Follow-up of events against a same-session pool, summed up with sessions as equals, and paired contrasts of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklane.functions import exprs as X
from ticklane.operators.timeline import leave_one_out
from ticklane.plans.state import flow_events


def observations(facts: DataFrame, horizons: list[int], split: int) -> DataFrame:
    """Every event at every horizon: status (PENDING, MISSING_PRICE, OBSERVED), outcome, the pool's mean and the excess. The
    pool is every code usable in the session and the one before, events or not."""
    last = facts.agg(F.max("i")).first()[0]
    usable = facts.where(X.usable_event()).select("code", "i")
    both = usable.join(usable.select("code", (F.col("i") + 1).alias("i")), ["code", "i"])
    spread = both.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).withColumn("target", F.col("i") + F.col("horizon"))
    price = facts.select("code", "i", "close")
    later = price.select("code", F.col("i").alias("target"), F.col("close").alias("after"))
    pool = spread.join(price, ["code", "i"]).join(later, ["code", "target"], "left").withColumn("outcome", X.percent_return("after", "close"))
    means = pool.groupBy("i", "horizon").agg(F.avg("outcome").alias("benchmark"), F.count("outcome").alias("pool_n"))
    rows = flow_events(facts).select("code", "i", "kind").join(pool, ["code", "i"]).join(means, ["i", "horizon"])
    status = F.when(F.col("target") > F.lit(last), "PENDING").when(F.col("outcome").isNull(), "MISSING_PRICE").otherwise("OBSERVED")
    return rows.select("code", "i", "kind", "horizon", X.cohort("i", split, max(horizons)).alias("cohort"), status.alias("status"), "outcome", "benchmark", "pool_n", (F.col("outcome") - F.col("benchmark")).alias("excess"))


def summary(rows: DataFrame) -> DataFrame:
    """By cohort, kind and horizon: pooled mean and median, the mean of session means, and its range with one session left out."""
    keys = ["cohort", "kind", "horizon"]
    seen = rows.where("status = 'OBSERVED'")
    days = seen.groupBy(*keys, "i").agg(F.avg("excess").alias("day_mean"))
    by_day = days.groupBy(*keys).agg(F.count("*").alias("days"), F.avg("day_mean").alias("equal_day_mean"), F.sum("day_mean").alias("s"), F.min("day_mean").alias("a"), F.max("day_mean").alias("b"))
    low, high = leave_one_out("s", "days", "a", "b")
    pooled = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "OBSERVED").alias("observed"), F.count_if(F.col("status") == "PENDING").alias("pending"),
        F.avg(F.when(F.col("status") == "OBSERVED", F.col("excess"))).alias("pooled_mean"), F.median(F.when(F.col("status") == "OBSERVED", F.col("excess"))).alias("median"))
    return pooled.join(by_day.withColumn("least_without_one", low).withColumn("most_without_one", high).drop("s", "a", "b"), keys, "left")


def market_direction(facts: DataFrame, apart: DataFrame | None = None) -> DataFrame:
    """By session: change of the amount-weighted ratio on the codes usable in it and the session before, those in ``apart``
    (code, i) left out; status NO_COMMON_STOCKS where there are none."""
    usable = facts.where(X.usable_event()).select("code", "i", "amount", "net")
    was = usable.select("code", (F.col("i") + 1).alias("i"), F.col("amount").alias("amount_prev"), F.col("net").alias("net_prev"))
    both = usable.join(was, ["code", "i"])
    if apart is not None:
        both = both.join(apart, ["code", "i"], "left_anti")
    sums = both.groupBy("i").agg(F.count("*").alias("common"), *(F.sum(c).alias(c) for c in ("amount", "net", "amount_prev", "net_prev")))
    change = 100 * F.col("net") / F.col("amount") - 100 * F.col("net_prev") / F.col("amount_prev")
    return facts.select("i").distinct().join(sums, "i", "left").select("i", F.coalesce("common", F.lit(0)).alias("common"), change.alias("change"), F.when(F.col("common").isNull(), "NO_COMMON_STOCKS").otherwise("AVAILABLE").alias("status"))


def cells(facts: DataFrame, leaders: DataFrame, boards: DataFrame, horizon: int) -> DataFrame:
    """Outcomes of leaders (code, i) in the four cells of market direction and own direction, flat ones left out."""
    market = market_direction(facts, leaders).where("status = 'AVAILABLE' AND change <> 0").select("i", F.when(F.col("change") > 0, "improving").otherwise("weakening").alias("market"))
    own = facts.where(X.usable_event()).select("code", "i", "ratio", "close")
    was = own.select("code", (F.col("i") + 1).alias("i"), F.col("ratio").alias("ratio_prev"))
    after = facts.select("code", (F.col("i") - horizon).alias("i"), F.col("close").alias("after"))
    rows = leaders.join(own, ["code", "i"]).join(was, ["code", "i"]).where("ratio <> ratio_prev").join(after, ["code", "i"]).join(market, "i").join(boards, "code")
    return rows.select("code", "i", "board", "market", F.when(F.col("ratio") > F.col("ratio_prev"), "improving").otherwise("weakening").alias("stock"), X.percent_return("after", "close").alias("outcome"))


def cell_frame(rows: DataFrame) -> DataFrame:
    """All four cells, empty ones too: n, sessions, mean of session means."""
    spark = rows.sparkSession
    sides = spark.createDataFrame([("improving",), ("weakening",)], "market string")
    frame = sides.crossJoin(sides.select(F.col("market").alias("stock")))
    days = rows.groupBy("market", "stock", "i").agg(F.avg("outcome").alias("m"), F.count("*").alias("n"))
    sums = days.groupBy("market", "stock").agg(F.sum("n").alias("n"), F.count("*").alias("days"), F.avg("m").alias("mean"))
    return frame.join(sums, ["market", "stock"], "left").na.fill(0, ["n", "days"])


def matched_contrast(rows: DataFrame) -> DataFrame:
    """Improving less weakening stocks, paired inside session and board, averaged over a session's boards, then sessions; with
    each session's influence (mean less the mean without it)."""
    pairs = rows.groupBy("i", "board").agg(F.avg(F.when(F.col("stock") == "improving", F.col("outcome"))).alias("a"), F.avg(F.when(F.col("stock") == "weakening", F.col("outcome"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    days = pairs.groupBy("i").agg(F.avg(F.col("a") - F.col("b")).alias("spread"), F.count("*").alias("boards"))
    total = days.agg(F.sum("spread").alias("s"), F.count("*").alias("n"))  # one row
    joined = days.crossJoin(F.broadcast(total))
    return joined.select("i", "boards", "spread", (F.col("s") / F.col("n")).alias("mean"), F.when(F.col("n") >= 2, F.col("s") / F.col("n") - (F.col("s") - F.col("spread")) / F.nullif(F.col("n") - 1, F.lit(0))).alias("influence"))
