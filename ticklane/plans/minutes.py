"""Minute bars: fall from a running peak inside a day, against the close before it, and over a window of days.

A day is summed up by its extremes and its own fall, so a window needs a few numbers a day. Any day of the window that isn't
OBSERVED makes the window's value null (INCOMPLETE_MINUTES): missing minutes are never filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklane.functions import exprs as X
from ticklane.operators.timeline import drawdown

#: First and last minute of the two halves of a session, in minutes of the day.
HALVES = ((571, 690), (781, 900))


def slot_valid(time: Column) -> Column:
    """HHMM at a minute's end."""
    minute = F.floor(time / 100) * 60 + time % 100
    return (time % 100 < 60) & (minute.between(*HALVES[0]) | minute.between(*HALVES[1]))


def _label(time: Column) -> Column:
    digits = F.lpad(time.cast("string"), 4, "0")
    return F.concat_ws(":", F.substring(digits, 1, 2), F.substring(digits, 3, 2))


def day_paths(minutes: DataFrame, factors: DataFrame, zero: bool = False) -> DataFrame:
    """By code and day of ``factors`` (code, day, factor; null or not above 0: MISSING_FACTOR): status, minutes present and
    traded, the adjusted close's extremes, and the fall inside the day. Minutes: code, day, time (HHMM), close, volume; a bad
    slot, a repeated one, a bad volume or the bad price of a traded minute make the day INVALID_MINUTE; minutes without
    volume have no price. A price of 0 is bad unless ``zero``."""
    w = Window.partitionBy("code", "day").orderBy("time")
    traded, priced = F.col("volume") > 0, (F.col("close") >= 0) if zero else (F.col("close") > 0)
    bad = ~F.coalesce(slot_valid(F.col("time")), F.lit(False)) | F.coalesce(F.col("time") <= F.lag("time").over(w), F.lit(False))
    bad = bad | ~F.coalesce(X.finite("volume") & (F.col("volume") >= 0), F.lit(False)) | (F.coalesce(traded, F.lit(False)) & ~F.coalesce(X.finite("close") & priced, F.lit(False)))
    path = F.array_sort(F.collect_list(F.when(traded, F.struct("time", "close"))))  # 240 minutes at most where it is used
    sums = minutes.withColumn("bad", bad).groupBy("code", "day").agg(F.max("bad").alias("bad"), F.count("*").alias("present"), F.count_if(traded).alias("traded"), path.alias("path"))
    rows = factors.join(sums, ["code", "day"], "left")
    factor_ok = F.coalesce(X.finite("factor") & (F.col("factor") > 0), F.lit(False))
    status = (
        F.when(~factor_ok, "MISSING_FACTOR").when(F.col("present").isNull(), "NO_MINUTE_ROWS").when(F.col("bad"), "INVALID_MINUTE")
        .when(F.col("traded") == 0, "NO_TRADED_MINUTES").otherwise("OBSERVED")
    )
    seen = F.when(F.col("status") == "OBSERVED", F.transform("path", lambda p: F.struct((p["close"] * F.col("factor")).alias("v"), _label(p["time"]).alias("at"))))
    rows = rows.withColumn("status", status).withColumn("seen", seen).withColumn("d", drawdown(F.col("seen"), zero))
    top = F.array_max(F.transform("seen", lambda p: p["v"]))
    low = F.array_min(F.transform("seen", lambda p: p["v"]))
    at = lambda v: F.get(F.filter("seen", lambda p: p["v"] == v), F.lit(0))["at"]
    return rows.select(
        "code", "day", "status", F.coalesce("present", F.lit(0)).alias("present"), F.coalesce("traded", F.lit(0)).alias("traded"), low.alias("low"), at(low).alias("low_at"), top.alias("high"), at(top).alias("high_at"),
        F.col("d.dd").alias("within"), F.col("d.peak").alias("within_peak"), F.col("d.trough").alias("within_trough"), "seen")


def against_close(days: DataFrame, closes: DataFrame) -> DataFrame:
    """Fall of one day's minutes from a peak that starts at the close before (code, day, pre_close); null, with a status, where
    that close or a traded minute is missing."""
    rows = days.join(closes, ["code", "day"], "left")
    known = F.coalesce(X.finite("pre_close") & (F.col("pre_close") > 0), F.lit(False))
    start = F.array(F.struct(F.col("pre_close").cast("double").alias("v"), F.lit("previous close").alias("at")))
    status = F.when(F.col("status") != "OBSERVED", F.col("status")).when(~known, "MISSING_PREVIOUS_CLOSE").otherwise("OBSERVED")
    rows = rows.withColumn("status", status).withColumn("d", F.when(F.col("status") == "OBSERVED", drawdown(F.concat(start, "seen"))))
    return rows.select("code", "day", "status", F.col("d.dd").alias("drawdown"), F.col("d.peak").alias("peak"), F.col("d.trough").alias("trough"))


def over_window(days: DataFrame, baselines: DataFrame, window: DataFrame) -> DataFrame:
    """By code of ``baselines`` (code, baseline: the adjusted close before the window) over the days of ``window`` (day; some
    dozens): status, fall, peak, trough, minutes present, traded and expected, and the number of days that are missing."""
    dense = baselines.crossJoin(F.broadcast(window.select("day"))).join(days.drop("seen"), ["code", "day"], "left")
    seen = F.coalesce(F.col("status") == "OBSERVED", F.lit(False))
    one = F.struct("day", "low", "low_at", "high", "high_at", "within", "within_peak", "within_trough")
    sums = dense.groupBy("code").agg(
        F.first("baseline").alias("baseline"), F.count_if(~seen).alias("missing"), F.sum(F.when(seen, F.col("present")).otherwise(0)).alias("present"),
        F.sum(F.when(seen, F.col("traded")).otherwise(0)).alias("traded"), (240 * F.count("*")).alias("expected"), F.array_sort(F.collect_list(F.when(seen, one))).alias("days"))
    none = F.lit(None).cast("string")
    start = F.struct(F.col("baseline").cast("double").alias("top"), F.lit("close before window").alias("top_at"), F.lit(0.0).alias("dd"), none.alias("peak"), none.alias("trough"))

    def step(acc: Column, x: Column) -> Column:
        named = lambda c: F.concat_ws(" ", x["day"].cast("string"), x[c])
        across = 100 * (x["low"] / acc["top"] - 1)
        inside = x["within"] < F.least(across, acc["dd"])
        deeper = across < acc["dd"]
        higher = x["high"] > acc["top"]
        return F.struct(
            F.when(higher, x["high"]).otherwise(acc["top"]).alias("top"), F.when(higher, named("high_at")).otherwise(acc["top_at"]).alias("top_at"), F.least(acc["dd"], across, x["within"]).alias("dd"),
            F.when(inside, named("within_peak")).when(deeper, acc["top_at"]).otherwise(acc["peak"]).alias("peak"), F.when(inside, named("within_trough")).when(deeper, named("low_at")).otherwise(acc["trough"]).alias("trough"))

    known = F.coalesce(X.finite("baseline") & (F.col("baseline") > 0), F.lit(False))
    status = F.when(~known, "MISSING_BASELINE").when(F.col("missing") > 0, "INCOMPLETE_MINUTES").otherwise("OBSERVED")
    rows = sums.withColumn("status", status).withColumn("d", F.when(F.col("status") == "OBSERVED", F.aggregate("days", start, step)))
    return rows.select("code", "status", F.col("d.dd").alias("drawdown"), F.col("d.peak").alias("peak"), F.col("d.trough").alias("trough"), "present", "traded", "expected", "missing")
