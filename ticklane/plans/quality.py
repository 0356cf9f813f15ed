"""Audits of raw tables: duplicates, clocks, physical order, linkage, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticklane.functions import exprs as X


def duplicate_counts(rows: DataFrame, on: list[str], code: str) -> DataFrame:
    """One row: groups of equal rows, rows in them, rows beyond the first, codes with any. Nulls are equal to nulls."""
    groups = rows.groupBy(*on).agg(F.count("*").alias("n"), F.min(code).alias("a_code")).where("n > 1")
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("affected"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess"), F.countDistinct("a_code").alias("codes"))


def exact_duplicates(rows: DataFrame, key: list[str], code: str) -> DataFrame:
    """Two phases: rows whose key repeats first, then the whole rows of these, so that wide rows are grouped only where they
    may repeat."""
    repeated = rows.groupBy(*key).count().where("count > 1").drop("count")
    k = repeated.select(*[F.col(c).alias(f"k_{c}") for c in key])
    same = [rows[c].eqNullSafe(k[f"k_{c}"]) for c in key]
    candidates = rows.join(k, same, "left_semi")
    return duplicate_counts(candidates, rows.columns, code)


def same_time_duplicates(rows: DataFrame, code: str, time: str) -> DataFrame:
    groups = rows.groupBy(code, time).agg(F.count("*").alias("n"))
    twice = F.col("n") > 1
    return groups.agg(
        F.sum("n").alias("eligible"), F.count_if(twice).alias("groups"), F.countDistinct(F.when(twice, F.col(code))).alias("codes"),
        F.coalesce(F.sum(F.when(twice, F.col("n"))), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(twice, F.col("n") - 1)), F.lit(0)).alias("excess"))


def clock_profile(rows: DataFrame, day: str) -> DataFrame:
    """By code: rows, wrong days, invalid and zero clocks, rows after the close, first and last clock (t: HHMMSSmmm)."""
    return rows.groupBy("code").agg(
        F.count("*").alias("rows"), F.count_if(~F.col("trade_day").eqNullSafe(F.lit(day))).alias("bad_date"), F.count_if(~F.coalesce(X.clock_valid("t"), F.lit(False))).alias("bad_clock"),
        F.count_if(F.col("t") == 0).alias("zero_clock"), F.count_if(F.col("t") > 150000000).alias("after_close"), F.min("t").alias("first"), F.max("t").alias("last"))


def direction_totals(trades: DataFrame, keys: list[str]) -> DataFrame:
    """By keys: trades, amount, known net, amount of unknown side and its share (null without an amount), and trades of a known
    side whose parent's id is not above 0."""
    sums = trades.groupBy(*keys).agg(
        F.count("*").alias("trades"), F.sum("amount").alias("amount"), X.known_net().alias("known_net"), X.unknown_amount().alias("unknown"),
        F.count_if(F.col("side").isin("B", "S") & ~F.coalesce(F.col("pid") > 0, F.lit(False))).alias("bad_ids"))
    return sums.withColumn("unknown_rate", X.ratio("unknown", "amount"))


def regressions(rows: DataFrame, code: str, time: str, place: str) -> DataFrame:
    """One row: pairs of rows of a code next to each other in physical order, steps back in time, codes with any."""
    was = F.lag(time).over(Window.partitionBy(code).orderBy(place))
    back = F.col(time) < F.col("was")
    return rows.withColumn("was", was).agg(F.count("*").alias("eligible"), F.count("was").alias("pairs"), F.count_if(back).alias("regressions"), F.countDistinct(F.when(back, F.col(code))).alias("codes"))


def linkage(trades: DataFrame, orders: DataFrame, on: str) -> DataFrame:
    """One row: trades with an id, those whose id is among the orders, and those whose id names more than one order."""
    ids = orders.where(F.col(on) > 0).groupBy(on).agg(F.count("*").alias("orders"))
    joined = trades.where(F.col(on) > 0).join(ids, on, "left")
    return joined.agg(F.count("*").alias("eligible"), F.count("orders").alias("matched"), F.count_if(F.col("orders") > 1).alias("repeated"), F.count_if(F.col("orders") == 1).alias("single"))


def coverage(tables: dict[str, DataFrame], code: str) -> DataFrame:
    """By code: in which tables it is, and whether in all."""
    first, *rest = (t.select(code).distinct().withColumn("in", F.lit(name)) for name, t in tables.items())
    for t in rest:
        first = first.unionByName(t)
    flags = first.groupBy(code).agg(*(F.coalesce(F.max(F.col("in") == name), F.lit(False)).alias(f"in_{name}") for name in tables))
    everywhere = F.lit(True)
    for name in tables:
        everywhere = everywhere & F.col(f"in_{name}")
    return flags.withColumn("complete", everywhere)
