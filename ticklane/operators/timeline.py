"""Operators over sessions and times. Each is a few windows or joins on the caller's keys, so it scales with the rows of a
key's partition; none of them collects a key's rows into one value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid(keys: DataFrame, sessions: DataFrame, facts: DataFrame, on: list[str]) -> DataFrame:
    """Every key at every session, with nulls where there is no fact. ``sessions`` is a calendar, some thousand rows."""
    return keys.crossJoin(F.broadcast(sessions)).join(facts, on, "left")


def previous_session(df: DataFrame, key: list[str], index: str, columns: list[str], suffix: str = "_prev", step: int = 1) -> DataFrame:
    """Columns of the row ``step`` sessions earlier by calendar index; a missing session is not bridged."""
    other = df.select(*key, (F.col(index) + step).alias(index), *[F.col(c).alias(c + suffix) for c in columns])
    return df.join(other, [*key, index], "left")


def trailing_run(df: DataFrame, key: list[str], index: str, holds: Column, name: str) -> DataFrame:
    """Length of the run of rows up to each one for which ``holds``; rows must be on a dense grid."""
    upto = Window.partitionBy(*key).orderBy(index).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    broken = F.max(F.when(~F.coalesce(holds, F.lit(False)), F.col(index))).over(upto)
    first = F.min(index).over(upto)
    return df.withColumn(name, F.col(index) - F.coalesce(broken, first - 1))


def drawdown(path: Column, zero: bool = False) -> Column:
    """Largest fall from a running peak over an array of structs (v, at), in its order: struct of dd (percent, 0 if it never
    falls), peak and trough (at; null then). New peaks and troughs need a strict move, so the earliest tie stands. Null if
    any value is missing, or is 0 unless ``zero``; nothing falls from a peak of 0."""
    none = F.lit(None).cast("string")
    first = F.get(path, F.lit(0))
    start = F.struct(first["v"].cast("double").alias("top"), first["at"].cast("string").alias("top_at"), F.lit(0.0).alias("dd"), none.alias("peak"), none.alias("trough"))

    def step(acc: Column, x: Column) -> Column:
        fall = F.when(acc["top"] == 0, F.lit(0.0)).otherwise(100 * (x["v"] / acc["top"] - 1))
        deeper, higher = fall < acc["dd"], x["v"] > acc["top"]
        return F.struct(
            F.when(higher, x["v"]).otherwise(acc["top"]).cast("double").alias("top"), F.when(higher, x["at"].cast("string")).otherwise(acc["top_at"]).alias("top_at"),
            F.when(deeper, fall).otherwise(acc["dd"]).alias("dd"), F.when(deeper, acc["top_at"]).otherwise(acc["peak"]).alias("peak"), F.when(deeper, x["at"].cast("string")).otherwise(acc["trough"]).alias("trough"),
        )

    complete = F.forall(path, lambda x: F.coalesce((x["v"] >= 0) if zero else (x["v"] > 0), F.lit(False)))
    return F.when(complete & (F.size(path) > 0), F.aggregate(path, start, step))


def asof_before(left: DataFrame, right: DataFrame, key: list[str], time: str, columns: list[str]) -> DataFrame:
    """Each left row with the columns of the last right row of its key strictly before it (null if none), and its time.

    Union and one window, so the cost is one sort of the key's rows; ties on time leave the right row out."""
    held = F.struct(F.col(time).alias("right_time"), *columns)
    names = [c for c in left.columns if c not in (*key, time)]
    rows = left.select(*key, time, F.struct(*names).alias("l"), F.lit(0).alias("o"), F.lit(None).cast(right.select(held.alias("h")).schema["h"].dataType).alias("h"))
    both = rows.unionByName(right.select(*key, time, F.lit(None).cast(rows.schema["l"].dataType).alias("l"), F.lit(1).alias("o"), held.alias("h")))
    before = Window.partitionBy(*key).orderBy(time, "o").rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("h", F.last("h", ignorenulls=True).over(before)).where("o = 0")
    return found.select(*key, time, "l.*", "h.*")


def intervals(ticks: DataFrame, quotes: DataFrame, key: list[str], time: str) -> DataFrame:
    """Each tick with the quotes around it: prev_time and next_time, strictly before and after; ticks at a quote's very time
    and ticks without a quote on both sides are left out."""
    marks = quotes.select(*key, F.col(time).alias("t")).distinct()
    rows = ticks.withColumn("t", F.col(time)).withColumn("is_tick", F.lit(True))
    both = rows.unionByName(marks.withColumn("is_tick", F.lit(False)), allowMissingColumns=True)
    upto = Window.partitionBy(*key).orderBy("t", F.col("is_tick").cast("int")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = Window.partitionBy(*key).orderBy(F.desc("t"), F.col("is_tick").cast("int")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.when(~F.col("is_tick"), F.col("t"))
    found = both.withColumn("prev_time", F.last(mark, ignorenulls=True).over(upto)).withColumn("next_time", F.last(mark, ignorenulls=True).over(onward))
    return found.where("is_tick AND prev_time < t AND t < next_time").drop("t", "is_tick")


def equal_count_group(df: DataFrame, partition: list[str], order: list, name: str, most: int = 10, least_rows: int = 20) -> DataFrame:
    """Groups 1..g by rank, floor((rank - 1) * g / n) + 1 with g = clamp(n div least_rows, 1, most); not ntile."""
    n = F.count("*").over(Window.partitionBy(*partition))
    groups = F.least(F.lit(most), F.greatest(F.lit(1), F.floor(n / least_rows)))
    rank = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    return df.withColumn(name, (F.floor((rank - 1) * groups / n) + 1).cast("long"))


def midrank_percentile(df: DataFrame, partition: list[str], value: str, name: str, least: int = 20) -> DataFrame:
    """100 * (rank - 1 + ties / 2) / n over the rows with a value; null where there are fewer than ``least`` of them."""
    known = F.col(value).isNotNull()
    n = F.count(value).over(Window.partitionBy(*partition))
    rank = F.rank().over(Window.partitionBy(*partition).orderBy(F.asc_nulls_last(value)))
    ties = F.count("*").over(Window.partitionBy(*partition, value))
    return df.withColumn(name, F.when(known & (n >= least), 100 * (rank - 1 + ties / 2) / n))


def leave_one_out(total, n, low, high) -> tuple[Column, Column]:
    """Least and greatest mean with one value left out: (sum - max) / (n - 1) and (sum - min) / (n - 1)."""
    t, n, a, b = (F.col(c) for c in (total, n, low, high))
    return F.when(n >= 2, (t - b) / F.nullif(n - 1, F.lit(0))), F.when(n >= 2, (t - a) / F.nullif(n - 1, F.lit(0)))
