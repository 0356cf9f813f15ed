"""Screens over cards, states, events and patterns: filters that leave unknown values out, look-ups, texts from values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def candidates(cards: DataFrame, states: DataFrame, label: str | None = None, direction: int | None = None, search: str = "", change: str | None = None, known_streak: bool | None = None, focus: DataFrame | None = None, sort: str | None = None, descending: bool = True) -> DataFrame:
    """Cards (code, name, label, ret) with the state of their code (null without one) that pass all filters. direction is the
    sign of ret; search looks into code and name without case; focus keeps its codes alone. Unknown sort values come last."""
    rows = cards.join(states, "code", "left")
    if focus is not None:
        rows = rows.join(focus.select("code").distinct(), "code", "left_semi")
    tests = []
    if label is not None:
        tests.append(c("label") == label)
    if direction is not None:
        tests.append(F.signum("ret") == direction)
    if search.strip():
        word = search.strip().lower()
        tests.append(F.contains(F.lower(c("code").cast("string")), F.lit(word)) | F.contains(F.lower("name"), F.lit(word)))
    if change is not None:
        tests.append(c("change") == change)
    if known_streak is not None:
        tests.append(c("streak").isNotNull() if known_streak else c("streak").isNull())
    for test in tests:
        rows = rows.where(F.coalesce(test, F.lit(False)))
    return rows.orderBy(F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort), "code") if sort else rows


def pool_summary(members: DataFrame) -> DataFrame:
    """Codes by pool."""
    return members.groupBy("pool").agg(F.count("*").alias("n"))


def event_log(events: DataFrame, kinds: list[str] | None = None, statuses: list[str] | None = None) -> DataFrame:
    """Events of the kinds and statuses, the latest first, then by code."""
    rows = events if kinds is None else events.where(c("kind").isin(kinds))
    rows = rows if statuses is None else rows.where(c("status").isin(statuses))
    return rows.orderBy(c("i").desc(), "code")


def patterns(events: DataFrame, stocks: DataFrame, last: int, stage: str = "active", types: list[str] | None = None, every: bool = False, direction: int | None = None, age: int | None = None, distance: tuple = (None, None), amount: float | None = None, volume_ratio: float | None = None, above_average: bool | None = None, macd: int | None = None, flow: int | None = None) -> DataFrame:
    """Codes with events (code, pattern, stage, active, direction, detected, distance) that pass, and figures of the stock
    (code, amount, volume_ratio, close, average, macd, flow) that pass: code, hits, newest. ``every`` asks for all the types. A
    null figure fails its test."""
    lo, hi = distance
    if (age is not None and age < 0) or (amount is not None and amount < 0) or (volume_ratio is not None and volume_ratio < 0) or (lo is not None and hi is not None and lo > hi):
        raise ValueError("a bound is negative or the distance's bounds are crossed")
    tests = [c("active") & c("stage").isin("forming", "confirmed")] if stage == "active" else [] if stage == "all" else [c("stage") == stage]
    if types:
        tests.append(c("pattern").isin(types))
    if direction is not None:
        tests.append(c("direction") == direction)
    if age is not None:
        tests.append(last - c("detected") <= age)
    tests += [c("distance") >= lo] if lo is not None else []
    tests += [c("distance") <= hi] if hi is not None else []
    found = events
    for test in tests:
        found = found.where(F.coalesce(test, F.lit(False)))
    codes = found.groupBy("code").agg(F.count("*").alias("hits"), F.max("detected").alias("newest"), F.countDistinct("pattern").alias("k"))
    if types and every:
        codes = codes.where(c("k") == len(set(types)))
    figures = []
    if amount is not None:
        figures.append(c("amount") >= amount)
    if volume_ratio is not None:
        figures.append(c("volume_ratio") >= volume_ratio)
    if above_average is not None:
        figures.append(c("close") > c("average") if above_average else c("close") < c("average"))
    figures += [F.signum(name) == sign for name, sign in (("macd", macd), ("flow", flow)) if sign is not None]
    rows = codes.drop("k").join(stocks, "code")
    for test in figures:
        rows = rows.where(F.coalesce(test, F.lit(False)))
    return rows.select("code", "hits", "newest")


def find_codes(cards: DataFrame, queries: list[str]) -> DataFrame:
    """Of each query: the one code whose code or name equals it, without case; if none does, the one that contains it; no row
    where none or several do. One scan of the cards; the queries are arguments and travel in the plan."""
    asked = F.array(*(F.lit(q.strip().lower()) for q in queries if q.strip()))
    texts = F.array(F.lower(c("code").cast("string")), F.lower(F.coalesce("name", F.lit(""))))
    hits = cards.select("code", texts.alias("texts"), F.explode(asked).alias("query")).where(F.exists("texts", lambda t: F.contains(t, c("query"))))
    exact = F.when(F.array_contains("texts", c("query")), c("code"))
    sums = hits.groupBy("query").agg(F.countDistinct(exact).alias("n"), F.min(exact).alias("exact"), F.countDistinct("code").alias("m"), F.min("code").alias("near"))
    return sums.select("query", F.when(c("n") == 1, c("exact")).when((c("n") == 0) & (c("m") == 1), c("near")).alias("code")).where("code IS NOT NULL")


def neighbours(calendar: DataFrame) -> DataFrame:
    """Each open day with the ones before and after it (null at the ends); a calendar is some thousand rows."""
    by_place = calendar.select("day", "i")
    shifted = lambda step, name: by_place.select((c("i") + step).alias("i"), c("day").alias(name))
    return by_place.join(shifted(1, "before"), "i", "left").join(shifted(-1, "after"), "i", "left").select("day", "before", "after")


def quote_of(kind: Column) -> Column:
    return F.when(kind > 0, "up").when(kind < 0, "down").when(kind == 0, "flat").otherwise("unknown")


def narrative(level: Column, delta: Column, ret: Column) -> Column:
    """What a state says in words: the side and its change, then a price that goes the other way. Unknown stays unknown."""
    selling = F.when(delta > 0, "net selling, easing").when(delta < 0, "net selling, growing").otherwise("net selling, unchanged")
    buying = F.when(delta < 0, "net buying, fading").when(delta > 0, "net buying, growing").otherwise("net buying, unchanged")
    flow = F.when(level < 0, selling).when(level > 0, buying).otherwise("balanced")
    apart = F.when((ret > 0) & (level < 0), "; price rose").when((ret < 0) & (level > 0), "; price fell").otherwise("")
    return F.when(level.isNull() | delta.isNull(), "unknown").otherwise(F.concat(flow, apart))
