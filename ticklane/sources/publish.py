"""What may be read of a folder of daily sources, and reports published from them.

A day counts once all its files are there and its manifest and marker say so (the gate). A report of a day is built from the sessions of its
window and counts as long as they pass the gate and are the same files as then, and its rows are those that were published. Rows are written to
a staging folder that no reader looks at; the provenance with their digest goes to its place first and the rows last, so whatever a lost
driver leaves half done is missing or stale, never ready.

Folders are listed, and small control files written, on the driver: so much a day. Rows are only read and hashed by Spark, all days in one pass.
An empty folder or calendar gives an empty catalogue; a null day is no day; columns of reports may have any names but ``day``."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticklane.sources import files

AUDIT, STAGING = "_conversion_audit", "_staging"
#: Sessions in a report's window, and the layouts of the three files a day must have.
WINDOW = 7
LAYOUTS = {"deal": "deal_{key}.parquet", "snapshot": "snapshot_{key}.parquet", "order_raw": "order_raw_{key}.parquet"}


def gates(spark: SparkSession, root: str, layouts: dict[str, str] = LAYOUTS) -> DataFrame:
    """day and missing, an array of what a day lacks: kinds of files in the order of ``layouts``, then ``manifest`` (none, or no JSON object), or
    else ``COMMITTED`` (no marker, or another state). Days are all that have any file, manifest or marker."""
    kinds = {kind: files.listed(spark, root, layout) for kind, layout in layouts.items()}
    manifests = files.listed(spark, root, f"{AUDIT}/{{key}}/manifest.json")
    markers = files.listed(spark, root, f"{AUDIT}/{{key}}/COMMITTED")
    days = sorted(set(manifests) | set(markers) | {d for held in kinds.values() for d in held})
    rows = [(d, [k for k, held in kinds.items() if d not in held], d in markers) for d in days]
    listed = spark.createDataFrame(rows, "day string, absent array<string>, marker boolean")
    if manifests:
        texts = spark.read.text(list(manifests.values()), wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/manifest.json$", 1).alias("day"), "value")
        told = texts.select("day", F.json_object_keys("value").isNotNull().alias("readable"), F.get_json_object("value", "$.commit_state").alias("state"))
    else:
        told = spark.createDataFrame([], "day string, readable boolean, state string")
    control = F.when(~F.coalesce("readable", F.lit(False)), "manifest").when(~F.col("marker") | ~F.col("state").eqNullSafe(F.lit("COMMITTED")), "COMMITTED")
    return listed.join(told, "day", "left").select("day", F.array_compact(F.concat("absent", F.array(control))).alias("missing"))


def _numbered(days: DataFrame, sessions: DataFrame) -> DataFrame:
    """Days and sessions with the number of sessions up to them, in one task: a row a day of a calendar."""
    both = days.select("day", F.lit(0).alias("s")).unionByName(sessions.select("day", F.lit(1).alias("s"))).where("day IS NOT NULL").groupBy("day").agg(F.max("s").alias("session"))
    return both.withColumn("at", F.sum("session").over(Window.orderBy("day")))


def catalogue(spark: SparkSession, root: str, sessions: DataFrame, layouts: dict[str, str] = LAYOUTS, extra: dict[str, str] | None = None, window: int = WINDOW) -> DataFrame:
    """Each day with any file of ``layouts`` or ``extra``: complete, missing, window (its sessions (day) up to the day; empty where the calendar
    has too few), window_missing (those that fail the gate), can_build, and whether it has each of the ``extra`` files."""
    more = {name: files.listed(spark, root, layout) for name, layout in (extra or {}).items()}
    found = sorted({d for held in more.values() for d in held} | {d for layout in layouts.values() for d in files.listed(spark, root, layout)})
    days = spark.createDataFrame([(d, *(d in held for held in more.values())) for d in found], ", ".join(["day string", *(f"{name} boolean" for name in more)]))
    gate = gates(spark, root, layouts)
    lacking = F.coalesce("missing", F.array(*map(F.lit, [*layouts, "manifest"])))
    numbered = _numbered(days, sessions).join(gate, "day", "left").withColumn("missing", lacking)
    calendar = numbered.where("session = 1").select("at", F.col("day").alias("in_window"), (F.size("missing") > 0).alias("fails"))
    wanted = numbered.join(days, "day").where(F.col("at") >= window).select("day", F.explode(F.sequence(F.col("at") - (window - 1), F.col("at"))).alias("at"))
    windows = wanted.join(calendar, "at").groupBy("day").agg(
        F.sort_array(F.collect_list("in_window")).alias("window"), F.sort_array(F.collect_list(F.when(F.col("fails"), F.col("in_window")))).alias("window_missing"))
    none = F.array().cast("array<string>")
    told = days.join(numbered.select("day", "missing"), "day").join(windows, "day", "left").withColumns({c: F.coalesce(c, none) for c in ("window", "window_missing")})
    complete = F.size("missing") == 0
    ready = complete & (F.size("window") == window) & F.try_element_at("window", F.lit(-1)).eqNullSafe(F.col("day")) & (F.size("window_missing") == 0)
    return told.select("day", complete.alias("complete"), "missing", "window", "window_missing", F.coalesce(ready, F.lit(False)).alias("can_build"), *more)


def _print(*sums: Column) -> Column:
    return F.sha2(F.concat_ws(",", *(F.coalesce(s.cast("string"), F.lit("")) for s in sums)), 256)


def source_prints(spark: SparkSession, root: str, catalogued: DataFrame, layouts: dict[str, str] = LAYOUTS) -> DataFrame:
    """day and sources, a digest of the names, lengths and times of change of all files of the day's window and of its manifests' text. Of the
    sources only listings are read, and hashes of files are added up, so no list of them is held anywhere."""
    held = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime", "length")
    day = F.coalesce(*(F.nullif(F.regexp_extract("path", files.pattern(layout), 1), F.lit("")) for layout in layouts.values()))
    each = held.select(day.alias("at"), F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)").alias("h"), "length").where("at IS NOT NULL")
    manifests = files.listed(spark, root, f"{AUDIT}/{{key}}/manifest.json")
    if manifests:  # Spark lists no folder whose name begins with a low line, so they are named one by one
        texts = spark.read.text(list(manifests.values()), wholetext=True)
        each = each.unionByName(texts.select(F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/manifest.json$", 1).alias("at"), F.xxhash64("value").cast("decimal(38,0)").alias("h"), F.octet_length("value").cast("long").alias("length")))
    by_day = each.groupBy("at").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.sum("h").alias("h"))
    wide = catalogued.select("day", F.explode_outer("window").alias("at")).join(by_day, "at", "left")
    return wide.groupBy("day").agg(_print(F.count("at"), F.sum("n"), F.sum("bytes"), F.sum("h")).alias("sources"))


def row_prints(rows: DataFrame, day: str = "day") -> DataFrame:
    """day, n and a digest of its rows, for all days at once and in any order of rows."""
    names = sorted(c for c in rows.columns if c != day)
    columns = [F.col(f"`{c}`") for c in names]
    gaps = F.concat_ws("", *(F.when(c.isNull(), "1").otherwise("0") for c in columns))  # a null changes no hash
    sums = [F.sum(F.xxhash64(F.lit(seed), gaps, *columns).cast("decimal(38,0)")) for seed in (1, 2)]
    kinds = json.dumps([(c, rows.schema[c].dataType.simpleString()) for c in names])
    return rows.groupBy(F.col(day).alias("day")).agg(F.count("*").alias("n"), _print(F.lit(kinds), F.count("*"), *sums).alias("rows_digest"))


def publish(spark: SparkSession, reports: str, rows: DataFrame, root: str, sessions: DataFrame, layouts: dict[str, str] = LAYOUTS) -> DataFrame:
    """Publish the report rows (day and others) of all their days: day and status, PUBLISHED, SOURCES_INCOMPLETE (the day can't be built) or
    SOURCES_CHANGED (while the rows were made). One write for all days; a day that isn't published keeps what it had."""
    rows, staged = rows.withColumn("day", F.col("day").cast("string")), f"{reports}/{STAGING}/{uuid.uuid4().hex}"
    known = files.stored(catalogue(spark, root, sessions, layouts))
    before = files.stored(source_prints(spark, root, known, layouts))
    rows.where("day IS NOT NULL").write.partitionBy("day").parquet(staged)
    written = spark.read.schema(rows.schema).option("basePath", staged).parquet(staged)
    after = source_prints(spark, root, known, layouts).withColumnRenamed("sources", "now")
    told = row_prints(written).join(known.select("day", "can_build"), "day", "left").join(before, "day", "left").join(after, "day", "left")
    status = F.when(~F.coalesce("can_build", F.lit(False)), "SOURCES_INCOMPLETE").when(~F.col("sources").eqNullSafe(F.col("now")), "SOURCES_CHANGED").otherwise("PUBLISHED")
    days = told.select("day", status.alias("status"), "sources", "rows_digest").collect()  # a row a day
    for r in days:
        if r.status == "PUBLISHED":
            files.put(spark, f"{reports}/_provenance/{r.day}.json", json.dumps({"rows": r.rows_digest, "sources": r.sources}))
            files.remove(spark, f"{reports}/day={r.day}")
            files.move(spark, f"{staged}/day={r.day}", f"{reports}/day={r.day}")
    files.remove(spark, staged)
    return spark.createDataFrame([(r.day, r.status) for r in days], "day string, status string")


def report_states(spark: SparkSession, reports: str, schema: str, root: str, sessions: DataFrame, layouts: dict[str, str] = LAYOUTS) -> DataFrame:
    """day, status and reason of each catalogued day. missing: no report. stale: NO_PROVENANCE, SOURCES_INCOMPLETE (as they stand now),
    BAD_PROVENANCE (no JSON object with both digests), SOURCES_CHANGED, EMPTY or ROWS_CHANGED, the first that holds. Else ready, without a reason.

    ``schema`` (DDL, without day) is that of the reports; all their rows are read once."""
    known = files.stored(catalogue(spark, root, sessions, layouts))
    held, notes = files.listed(spark, reports, "day={key}"), files.listed(spark, reports, "_provenance/{key}.json")
    listed = spark.createDataFrame([(d, d in notes) for d in held], "day string, noted boolean")
    texts = spark.read.text(list(notes.values()), wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+).json$", 1).alias("day"), "value") if notes else spark.createDataFrame([], "day string, value string")
    said = texts.select("day", F.get_json_object("value", "$.rows").alias("rows_then"), F.get_json_object("value", "$.sources").alias("sources_then"))
    full = f"{schema}, day string"
    rows = spark.read.schema(full).option("basePath", reports).parquet(*held.values()) if held else spark.createDataFrame([], full)
    now = row_prints(rows).join(source_prints(spark, root, known, layouts), "day", "full")
    told = known.select("day", "can_build").join(listed, "day", "left").join(said, "day", "left").join(now, "day", "left")
    reason = (
        F.when(F.col("noted").isNull(), None).when(~F.col("noted"), "NO_PROVENANCE").when(~F.col("can_build"), "SOURCES_INCOMPLETE")
        .when(F.col("rows_then").isNull() | F.col("sources_then").isNull(), "BAD_PROVENANCE").when(~F.col("sources_then").eqNullSafe(F.col("sources")), "SOURCES_CHANGED")
        .when(F.col("n").isNull(), "EMPTY").when(F.col("rows_then") != F.col("rows_digest"), "ROWS_CHANGED")
    )
    status = F.when(F.col("noted").isNull(), "missing").when(F.col("reason").isNull(), "ready").otherwise("stale")
    return told.withColumn("reason", reason).select("day", status.alias("status"), "reason")
