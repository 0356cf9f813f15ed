"""The market over the window of sessions up to each one: flow of a common cohort, breadth of a price cohort, how ratios moved.

The flow cohort of an end session holds the codes usable in every session of its window, the price cohort those with a return in
every one; neither is filled from the other. All end sessions come from one pass over the grid: a code in a cohort gives its own last
n sessions, which are added up by (end, session), so nothing is joined to itself and no session is picked on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklane.functions import exprs as X

#: What a view says of its window.
INCOMPLETE, NO_FLOW, NO_PRICE = "INCOMPLETE_WINDOW", "NO_COMMON_COHORT", "NO_COMMON_PRICE_COHORT"


def _marked(dense: DataFrame, n: int) -> DataFrame:
    """The grid with u (usable for a view), ret (on the session before), the last n sessions and whether the code is in both cohorts."""
    w = Window.partitionBy("code").orderBy("i")
    span = w.rowsBetween(-(n - 1), Window.currentRow)
    rows = dense.withColumn("u", X.usable_view() & F.coalesce(X.finite("net"), F.lit(False))).withColumn("ret", X.percent_return("close", F.lag("close").over(w)))
    before = F.when(F.lag("u").over(w), F.lag("ratio").over(w))
    held = F.collect_list(F.struct("i", "amount", "net", "ratio", "ret")).over(span)
    return rows.select(
        "code", "i", "amount", "u", "ret", F.when(F.col("u"), F.col("ratio")).alias("now"), before.alias("before"), held.alias("held"),
        (F.sum(F.col("u").cast("int")).over(span) == n).alias("flow"), (F.count("ret").over(span) == n).alias("price"))


def _frame(dense: DataFrame, n: int) -> DataFrame:
    """Each end session with the sessions of its window and the length of that; a calendar is some thousand rows at most."""
    days = dense.select("i").distinct().withColumn("at", F.row_number().over(Window.orderBy("i")))
    ends = days.select(F.col("i").alias("end"), F.explode(F.sequence(F.greatest(F.col("at") - n + 1, F.lit(1)), F.col("at"))).alias("at"), F.least("at", F.lit(n)).alias("length"))
    return ends.join(F.broadcast(days), "at").drop("at")


def _share(part: str, of: str) -> Column:
    return 100 * F.col(part) / F.nullif(F.col(of), F.lit(0))


def trajectories(dense: DataFrame, n: int) -> DataFrame:
    """A row for each end session and session of its window (end, i, length): the market's amount and coverages, the flow cohort's amount, net,
    ratio and share of buyers, the price cohort's shares of risers, fallers and flat ones, and their changes on the session before in the window.

    dense: code, i, amount, net, unknown, ratio, close on every code and session. Sums over nobody are null."""
    rows = _marked(dense, n)
    good = F.coalesce(X.finite("amount") & (F.col("amount") > 0), F.lit(False))
    market = rows.groupBy("i").agg(
        F.count("*").alias("total"), F.sum(F.when(good, F.col("amount"))).alias("amount"), F.count_if(good).alias("amount_coverage"), F.count_if("u").alias("direction_coverage"), F.count("ret").alias("price_coverage"))
    each = rows.where("flow OR price").select(F.col("i").alias("end"), "flow", "price", F.explode("held").alias("x")).select("end", "flow", "price", "x.*")
    mine = lambda c: F.sum(F.when(F.col("flow"), F.col(c)))
    moved = lambda test: F.count_if(F.col("price") & test)
    sums = each.groupBy("end", "i").agg(
        F.count_if("flow").alias("common"), mine("amount").alias("common_amount"), mine("net").alias("common_net"), F.count_if(F.col("flow") & (F.col("ratio") > 0)).alias("buyers"), F.count_if("price").alias("price_common"),
        moved(F.col("ret") > 0).alias("up"), moved(F.col("ret") < 0).alias("down"), moved(F.col("ret") == 0).alias("level"))
    told = _frame(dense, n).join(F.broadcast(market), "i").join(sums, ["end", "i"], "left").na.fill(0, ["common", "price_common"])
    told = told.withColumn("ratio", 100 * F.col("common_net") / F.nullif("common_amount", F.lit(0.0))).withColumn("buy_share", _share("buyers", "common"))
    for name in ("up", "down", "level"):
        told = told.withColumn(f"{name}_share", _share(name, "price_common"))
    along = Window.partitionBy("end").orderBy("i")
    deltas = ((F.col(c) - F.lag(c).over(along)).alias(f"{c}_delta") for c in ("ratio", "buy_share", "up_share"))
    return told.select(
        "end", "i", "length", "total", "amount", "amount_coverage", "direction_coverage", "price_coverage", "common", "common_amount", "common_net", "ratio", "buy_share",
        "price_common", "up_share", "down_share", "level_share", *deltas)


def slope(values: Column) -> Column:
    """Least-squares slope over the places of an array; null with fewer than two values or a missing one."""
    n = F.size(values)
    middle = (n - 1) / F.lit(2.0)
    places = F.transform(values, lambda v, k: (k - middle) * v)
    square = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda acc, k: acc + (k - middle) * (k - middle))
    return F.when((n >= 2) & F.forall(values, lambda v: v.isNotNull()), F.aggregate(places, F.lit(0.0), lambda acc, v: acc + v) / F.nullif(square, F.lit(0.0)))


def _until(flags: Column) -> Column:
    """How many of the first flags hold."""
    at = F.array_position(flags, False)
    return F.when(at > 0, at - 1).otherwise(F.size(flags)).cast("int")


def persistence(values: Column, boundary: float = 0.0) -> Column:
    """Struct of side (sign of the last value against the boundary), days of that side at the end and left_censored; nulls if the last
    value is missing."""
    back = F.reverse(values)
    last = F.get(back, F.lit(0))
    side = F.signum(last - boundary)
    days = F.when(last.isNotNull(), _until(F.transform(back, lambda v: F.coalesce(F.signum(v - boundary) == side, F.lit(False)))))
    return F.struct(side.cast("int").alias("side"), days.alias("days"), F.coalesce(days == F.size(values), F.lit(False)).alias("left_censored"))


def improvement(values: Column) -> Column:
    """Struct of comparisons (strict rises at the end) and left_censored; null with fewer than two values or a missing one."""
    back, n = F.reverse(values), F.size(values)
    rises = F.transform(F.slice(back, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda v, k: F.coalesce(v > F.get(back, k + 1), F.lit(False)))
    complete = (n >= 2) & F.forall(values, lambda v: v.isNotNull())
    count = F.when(complete, _until(rises))
    return F.struct(count.alias("comparisons"), F.coalesce(count == n - 1, F.lit(False)).alias("left_censored"))


def markets(paths: DataFrame, n: int) -> DataFrame:
    """By end session, from ``trajectories``: status and price_status, latest ratio, shares, changes and slopes, how long the ratio has been on
    its side of 0 and the share of buyers on its side of 50, and how often in a row the ratio rose. Null unless a status is AVAILABLE."""
    entry = F.struct("i", "ratio", "buy_share", "up_share")
    rows = paths.groupBy("end").agg(F.max("length").alias("length"), F.max("common").alias("common"), F.max("price_common").alias("price_common"), F.max("total").alias("total"), F.array_sort(F.collect_list(entry)).alias("x"))
    short = F.col("length") < n
    status = F.when(short, INCOMPLETE).when(F.col("common") == 0, NO_FLOW).otherwise("AVAILABLE")
    price = F.when(short, INCOMPLETE).when(F.col("price_common") == 0, NO_PRICE).otherwise("AVAILABLE")
    rows = rows.select("end", "total", "common", "price_common", status.alias("status"), price.alias("price_status"), "x.ratio", "x.buy_share", "x.up_share")
    last, step = lambda c: F.get(c, F.lit(n - 1)), lambda c: F.get(c, F.lit(n - 1)) - F.get(c, F.lit(n - 2)) if n > 1 else F.lit(None).cast("double")
    flow, priced = F.col("status") == "AVAILABLE", F.col("price_status") == "AVAILABLE"
    side, breadth, rising = persistence(F.col("ratio")), persistence(F.col("buy_share"), 50.0), improvement(F.col("ratio"))
    named = {
        "latest_ratio": (flow, last("ratio")), "latest_buy_share": (flow, last("buy_share")), "ratio_delta": (flow, step("ratio")), "buy_share_delta": (flow, step("buy_share")), "ratio_slope": (flow, slope(F.col("ratio"))), "buy_share_slope": (flow, slope(F.col("buy_share"))),
        "ratio_side": (flow, side["side"]), "ratio_days": (flow, side["days"]), "ratio_left_censored": (flow, side["left_censored"]), "breadth_side": (flow, breadth["side"]), "breadth_days": (flow, breadth["days"]),
        "rises": (flow, rising["comparisons"]), "rises_left_censored": (flow, rising["left_censored"]), "latest_up_share": (priced, last("up_share")), "up_share_delta": (priced, step("up_share")), "up_share_slope": (priced, slope(F.col("up_share"))),
    }
    return rows.select("end", "total", "common", "price_common", "status", "price_status", *(F.when(ok, c).alias(name) for name, (ok, c) in named.items()))


def changes(dense: DataFrame) -> DataFrame:
    """By session but the first: how the codes' usable ratios moved from the session before (improve, worsen, flat, unknown) and how many
    turned to buying or selling."""
    rows = _marked(dense, 1)
    first = dense.agg(F.min("i").alias("first"))  # one row
    a, b = F.col("before"), F.col("now")
    return rows.join(F.broadcast(first), F.col("i") > F.col("first")).groupBy("i").agg(
        F.count_if(b > a).alias("improve"), F.count_if(b < a).alias("worsen"), F.count_if(b == a).alias("flat"), F.count_if(a.isNull() | b.isNull()).alias("unknown"),
        F.count_if((a < 0) & (b > 0)).alias("to_buy"), F.count_if((a > 0) & (b < 0)).alias("to_sell"))
