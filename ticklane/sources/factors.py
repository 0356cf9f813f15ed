"""Daily price files: by day and by security, tied to the names of their files; adjusted closes and candle bundles.

A file that holds another day or security than its name says is an error, and so is a security that has two prices on a day.
Errors are found by small aggregates over all files before rows are given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticklane.functions import exprs as X
from ticklane.sources import files

#: Prices on the scale of the latest share count, and what goes with them.
QFQ = ["open_qfq", "high_qfq", "low_qfq", "close_qfq"]
BY_DAY, BY_CODE = "{key}_stk_factor_pro.csv", "{key}_stk_factor_pro.csv"
DAILY = "{key}_daily.csv"


def _number(name: str) -> Column:
    v = F.col(name).try_cast("double")
    return F.when(X.finite(v), v)


def _read(spark: SparkSession, paths: list[str], layout: str, columns: list[str]) -> DataFrame:
    """Text columns ``columns`` of CSV files with a header, with the key of each row's file as ``named``. A column a file lacks is
    null, whatever the order of the others."""
    if not paths:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in [*columns, "named"]))
    by_head: dict[tuple, list[str]] = {}
    heads = spark.read.text(paths).select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_block_start").alias("at"), "value")
    first = heads.where("at = 0").groupBy("p").agg(F.first("value").alias("head"))  # a line a file
    for r in first.collect():
        by_head.setdefault(tuple(h.strip().lstrip("﻿") for h in r["head"].split(",")), []).append(r["p"])
    out = None
    for head, held in sorted(by_head.items()):
        raw = spark.read.schema(", ".join(f"`{h}` string" for h in head)).option("header", True).option("enforceSchema", True).csv(held)
        got = raw.select(*(F.col(f"`{c}`") if c in head else F.lit(None).cast("string").alias(c) for c in columns), files.key_of_file(layout).alias("named"))
        out = got if out is None else out.unionByName(got)
    return out


def _raise_on(rows: DataFrame, what: str) -> None:
    bad = rows.first()
    if bad is not None:
        raise ValueError(f"{what}: {bad.asDict()}")


def adjusted_closes(spark: SparkSession, root: str, days: list[str], layout: str = BY_DAY) -> DataFrame:
    """day, code, close (times the factor; null if either is missing or the product is not above 0) and the raw o, h, l, c and volume
    of files by day. Rows of another day than their file's are left out; a code that stands twice on a day raises."""
    held = files.listed(spark, root, layout)
    rows = _read(spark, [held[d] for d in days if d in held], layout, ["ts_code", "trade_date", "open", "high", "low", "close", "vol", "adj_factor"])
    rows = rows.where(F.col("trade_date") == F.col("named"))
    _raise_on(rows.groupBy("named", "ts_code").count().where("count > 1").select("named", "ts_code"), "a security stands twice in a day's prices")
    close = _number("close") * _number("adj_factor")
    return rows.select(F.col("named").alias("day"), F.col("ts_code").alias("code"), F.when(X.finite(close) & (close > 0), close).alias("close"), _number("open").alias("o"), _number("high").alias("h"), _number("low").alias("l"), _number("close").alias("c"), _number("vol").alias("volume"))


def factor_rows(spark: SparkSession, root: str, layout: str, keys: list[str], by: str) -> DataFrame:
    """Rows of the files of ``keys`` (codes with _ for the dot, or days), checked against the names of their files: ``by`` is "ts_code"
    or "trade_date". Keys without a file have no rows; ``files.listed`` tells which they are."""
    held = files.listed(spark, root, layout)
    rows = _read(spark, [held[k] for k in keys if k in held], layout, ["ts_code", "trade_date", *QFQ, "vol", "amount"])
    named = F.regexp_replace("named", "_", ".") if by == "ts_code" else F.col("named")
    _raise_on(rows.where((F.col(by) != named)).select("named", by), "a file holds another key than its name says")
    return rows.withColumn("named", named)


def candles(rows: DataFrame, dates: DataFrame, target: str, count: int = 60) -> DataFrame:
    """Candles of the last ``count`` dates up to ``target``, the distinct ones of rows and of ``dates`` (trade_date): code, position
    (from 0), trade_date, o, h, l, c, volume, amount (times 1000) and rejected (the code's bars with bad prices). A code all of whose bars
    are bad has one row without a position. Rows that stand twice count once; two different ones for a code and date raise."""
    upto = rows.where(F.col("trade_date") <= target)
    last = upto.select("trade_date").union(dates.select("trade_date").where(F.col("trade_date") <= target)).distinct().orderBy(F.desc("trade_date")).limit(count)
    order = last.withColumn("position", F.row_number().over(Window.orderBy("trade_date")) - 1)  # ``count`` rows
    kept = upto.join(F.broadcast(order), "trade_date").select("ts_code", "trade_date", "position", *QFQ, "vol", "amount").distinct()
    _raise_on(kept.groupBy("ts_code", "trade_date").count().where("count > 1").select("ts_code", "trade_date"), "two different bars of a security on a date")
    o, h, l, c = (_number(q) for q in QFQ)  # noqa: E741
    good = F.coalesce((F.least(o, h, l, c) > 0) & o.isNotNull() & h.isNotNull() & l.isNotNull() & c.isNotNull() & (l <= F.least(o, c)) & (h >= F.greatest(o, c)), F.lit(False))
    positive = lambda name, scale: F.when(_number(name) >= 0, _number(name) * scale)
    bars = kept.select(F.col("ts_code").alias("code"), "position", "trade_date", o.alias("o"), h.alias("h"), l.alias("l"), c.alias("c"), positive("vol", 1.0).alias("volume"), positive("amount", 1000.0).alias("amount"), good.alias("good"))
    mine = Window.partitionBy("code")
    told = bars.withColumn("rejected", F.count_if(~F.col("good")).over(mine)).withColumn("n", F.count("*").over(mine))
    # a code with nothing but bad bars keeps one row, which says how many
    only = F.row_number().over(mine.orderBy("position")) == 1
    told = told.withColumn("lone", (F.col("rejected") == F.col("n")) & only).where("good OR lone")
    blank = lambda name: F.when(F.col("good"), F.col(name)).alias(name)
    return told.select("code", *(blank(x) for x in ("position", "trade_date", "o", "h", "l", "c", "volume", "amount")), "rejected")
