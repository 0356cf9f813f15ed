"""Daily flow facts from native and legacy trade files of several roots, with a status for each day.

A day is read from the first root that has its file and from no other, so sources are never stacked. What kind of file it is
follows from its columns: native files count once their publication is committed; legacy files of a calibrated root have sides
that the order ids must bear out row by row; other legacy files have amounts but no sides. Days of one kind and schema are one
scan, and all days one aggregate. A day without facts stays as a row of its own with its status."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklane.functions import exprs as X
from ticklane.sources import files
from ticklane.sources.readers import TRADE_COLUMNS, whole

#: The columns a legacy file must have, and those that calibration needs besides.
LEGACY_COLUMNS, ID_COLUMNS = {"SecuCode", "TradingDay", "Price", "Volume", "Side"}, {"BuyID", "SellID"}
READABLE = ("NATIVE", "LEGACY_CALIBRATED_ROW_GUARD", "LEGACY_DIRECTION_UNKNOWN")
SOURCES = "day string, status string, root string, path string"


@dataclass(frozen=True)
class Root:
    """A folder of daily files; ``calibrated`` if the sides of its legacy files have been held against order ids."""

    name: str
    path: str
    calibrated: bool = False


def kind_of(columns: set[str], calibrated: bool) -> str:
    if TRADE_COLUMNS["code"] in columns:
        return "NATIVE"
    if not LEGACY_COLUMNS <= columns:
        return "UNKNOWN_SCHEMA"
    return "LEGACY_CALIBRATED_ROW_GUARD" if calibrated and ID_COLUMNS <= columns else "LEGACY_DIRECTION_UNKNOWN"


def committed(spark: SparkSession, root: str, days: list[str], audit: str = "_conversion_audit") -> set[str]:
    """The days whose publication has its marker and whose manifest says so; a manifest that can't be read says nothing."""
    manifests = {d: f"{root}/{audit}/{d}/manifest.json" for d in days if files.exists(spark, f"{root}/{audit}/{d}/COMMITTED")}
    manifests = {d: p for d, p in manifests.items() if files.exists(spark, p)}
    if not manifests:
        return set()
    texts = spark.read.text(list(manifests.values()), wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/manifest.json$", 1).alias("day"), "value")
    good = texts.where(F.get_json_object("value", "$.commit_state") == "COMMITTED")
    return {r["day"] for r in good.select("day").collect()}  # a row a day asked for


def choose(spark: SparkSession, roots: list[Root], days: list[str], layout: str = "deal_{key}.parquet") -> tuple[list[tuple], dict]:
    """(day, status, root, path) of each day, and the paths to read by (status, schema). Reads footers and control files only."""
    held = [(r, files.listed(spark, r.path, layout)) for r in roots]
    first = {d: next(((r, paths[d]) for r, paths in held if d in paths), None) for d in days}
    schemas = {d: spark.read.parquet(found[1]).schema for d, found in first.items() if found}
    kinds = {d: kind_of(set(s.names), first[d][0].calibrated) for d, s in schemas.items()}
    whole_ = {r.name: committed(spark, r.path, [d for d in kinds if kinds[d] == "NATIVE" and first[d][0] is r]) for r in roots}
    rows, reads = [], {}
    for d in days:
        if first[d] is None:
            rows.append((d, "MISSING", None, None))
            continue
        root, path = first[d]
        status = kinds[d] if kinds[d] != "NATIVE" or d in whole_[root.name] else "UNCOMMITTED"
        rows.append((d, status, root.name, path))
        if status in READABLE:
            reads.setdefault((status, schemas[d].simpleString()), (schemas[d], []))[1].append(path)
    return rows, reads


def _typed(raw: DataFrame, status: str) -> DataFrame:
    """day (of the file), code, trade_day, price, qty and side (B, S, C, else unknown) of the rows of files of one kind."""
    number = lambda c: c.cast("string").try_cast("double")
    if status == "NATIVE":
        get = lambda name: F.col(f"`{TRADE_COLUMNS[name]}`")
        return raw.select("day", get("code").alias("code"), whole(get("trade_day")).cast("string").alias("trade_day"), (number(get("price")) / 10000).alias("price"), number(get("qty")).alias("qty"), get("side").cast("string").alias("side"))
    n = lambda c: whole(F.col(c))
    cancelled = F.col("Side").cast("string").isin("-1", "-11")
    if status == "LEGACY_CALIBRATED_ROW_GUARD":
        told = F.when((n("Side") == 0) & (n("SellID") > 0) & (n("BuyID") > n("SellID")), "B").when((n("Side") == 1) & (n("BuyID") > 0) & (n("SellID") > n("BuyID")), "S")
    else:
        told = F.lit(None).cast("string")
    code = F.concat(F.lpad(n("SecuCode").cast("string"), 6, "0"), F.when(n("SecuCode") >= 600000, ".SH").otherwise(".SZ"))
    return raw.select("day", code.alias("code"), n("TradingDay").cast("string").alias("trade_day"), (number(F.col("Price")) / 100).alias("price"), number(F.col("Volume")).alias("qty"), F.when(cancelled, "C").otherwise(told).alias("side"))


def _reason(status: Column, unknown: Column) -> Column:
    return (
        F.when(status == "LEGACY_DIRECTION_UNKNOWN", "SOURCE_NOT_CALIBRATED").when(~(unknown > 0), None)
        .when(status == "NATIVE", "UNKNOWN_SIDE").otherwise("SIDE_AND_IDS_DISAGREE")
    )


def daily_facts(spark: SparkSession, roots: list[Root], days: list[str], layout: str = "deal_{key}.parquet") -> DataFrame:
    """day, status, root, code, amount, net (of known sides; null without calibration), unknown, ratio, trades and reason (why a
    figure is not complete). Days that have no facts have one row with a null code. Rows of another day than their file's, outside
    the universe, cancelled, or without a positive price and quantity don't count."""
    rows, reads = choose(spark, roots, days, layout)
    parts = [_typed(spark.read.schema(schema).parquet(*paths).select("*", files.key_of_file(layout).alias("day")), status).withColumn("status", F.lit(status)) for (status, _), (schema, paths) in sorted(reads.items())]
    empty = spark.createDataFrame([], "day string, code string, trade_day string, price double, qty double, side string, status string")
    ticks = empty
    for part in parts:
        ticks = ticks.unionByName(part)
    kept = ticks.where((F.col("trade_day") == F.col("day")) & F.col("code").rlike(X.UNIVERSE) & X.traded("price", "qty") & X.not_cancelled("side"))
    sums = kept.withColumn("amount", F.col("price") * F.col("qty")).groupBy("day", "status", "code").agg(F.sum("amount").alias("amount"), X.known_net().alias("net"), X.unknown_amount().alias("unknown"), F.count("*").alias("trades"))
    net = F.when(F.col("status") != "LEGACY_DIRECTION_UNKNOWN", F.col("net"))
    facts = sums.withColumn("net", net).withColumn("ratio", 100 * F.col("net") / F.nullif("amount", F.lit(0.0))).withColumn("reason", _reason(F.col("status"), F.col("unknown")))
    chosen = spark.createDataFrame(rows, SOURCES).drop("path")  # a row a day
    return chosen.join(facts.drop("status"), "day", "left")


def lineage(rows: DataFrame, facts: DataFrame, day: str = "day") -> DataFrame:
    """Rows with the status and root of their day; a day that facts don't know is MISSING."""
    told = facts.select(F.col("day").alias(day), F.col("status").alias("source_status"), F.col("root").alias("source")).distinct()
    return rows.join(told, day, "left").withColumn("source_status", F.coalesce("source_status", F.lit("MISSING")))
