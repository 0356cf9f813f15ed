"""Limits of what a request may ask for, and whether two results for the same security and day agree."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticklane.functions import exprs as X

#: Most event days, horizons, sessions of a horizon, sessions of a state window, codes of a detail lookup.
EVENT_DAYS, HORIZONS, LONGEST, WINDOW, DETAILS = 250, 6, 20, 60, 50


@dataclass(frozen=True)
class StudyRequest:
    """A study over event sessions first..last (calendar indices) at some horizons, with training up to ``split``."""

    first: int
    last: int
    split: int
    horizons: tuple[int, ...]

    def __post_init__(self):
        if not 0 <= self.first <= self.last or self.last - self.first + 1 > EVENT_DAYS:
            raise ValueError(f"1 to {EVENT_DAYS} event sessions, not {self.first}..{self.last}")
        if not 1 <= len(self.horizons) <= HORIZONS or len(set(self.horizons)) != len(self.horizons):
            raise ValueError(f"1 to {HORIZONS} different horizons, not {self.horizons}")
        if not all(isinstance(h, int) and 1 <= h <= LONGEST for h in self.horizons):
            raise ValueError(f"horizons of 1 to {LONGEST} sessions, not {self.horizons}")
        if not self.first <= self.split <= self.last:
            raise ValueError(f"a split inside {self.first}..{self.last}, not {self.split}")


def state_window(n: int) -> int:
    if not isinstance(n, int) or isinstance(n, bool) or not 1 <= n <= WINDOW:
        raise ValueError(f"a window of 1 to {WINDOW} sessions, not {n!r}")
    return n


def detail_codes(codes: list[str]) -> list[str]:
    """Codes of a lookup: at most DETAILS, all of the universe; repeated ones once, in order."""
    once = list(dict.fromkeys(codes))
    wrong = [c for c in once if not re.match(X.UNIVERSE, c)]
    if wrong or not 1 <= len(once) <= DETAILS:
        raise ValueError(f"1 to {DETAILS} codes of the universe; got {len(once)}, wrong: {wrong[:5]}")
    return once


def agrees(a, b) -> Column:
    """Within 2 or a billionth of a, whichever is more; null agrees with null only."""
    a, b = X.col(a), X.col(b)
    near = F.abs(a - b) <= F.greatest(F.lit(2.0), 1e-9 * F.abs(a))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(near)
