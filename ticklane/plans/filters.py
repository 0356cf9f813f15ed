"""Interactive filters and sorts over state rows; unknown values are last in either direction, ties by code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def presets() -> dict[str, Column]:
    return {
        "relief": (c("level") < 0) & (c("improve") >= 1), "buy_strong": (c("level") > 0) & (c("delta") > 0), "buy_weak": (c("level") > 0) & (c("delta") < 0),
        "sell_strong": (c("level") < 0) & (c("delta") < 0), "up_sell": (c("price_return") > 0) & (c("weighted") < 0), "down_buy": (c("price_return") < 0) & (c("weighted") > 0),
    }


SORTS = ("level", "delta", "weighted", "slope", "streak", "improve", "worsen", "amount_change", "amount_relative", "price_return", "drawdown", "positive_days", "valid", "code")


def select_states(states: DataFrame, preset: str | None = None, coverage: str | None = None, ranges: dict[str, tuple] | None = None, sort: str = "level", descending: bool = True, page: int = 0, size: int = 20) -> DataFrame:
    """One page of states. coverage: full, partial or unknown; ranges: column to (least, most), either may be None. A null
    value fails a range."""
    if sort not in SORTS:
        raise ValueError(f"unknown sort key: {sort}")
    rows = states
    if preset:
        rows = rows.where(F.coalesce(presets()[preset], F.lit(False)))
    if coverage:
        rows = rows.where({"full": c("status") == "AVAILABLE", "partial": (c("status") != "AVAILABLE") & (c("valid") > 0), "unknown": c("valid") == 0}[coverage])
    for name, (least, most) in (ranges or {}).items():
        rows = rows.where(c(name).isNotNull() & (F.lit(True) if least is None else c(name) >= least) & (F.lit(True) if most is None else c(name) <= most))
    order = F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort)
    return rows.orderBy(order, "code").offset(page * size).limit(size)


def by_event(events: DataFrame, kinds: list[str], every: bool = False) -> DataFrame:
    """Codes with any (or every) of the kinds."""
    hits = events.where(c("kind").isin(kinds)).groupBy("code").agg(F.countDistinct("kind").alias("k"))
    return hits.where(c("k") == len(set(kinds)) if every else c("k") > 0).select("code")
