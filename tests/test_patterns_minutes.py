"""Patterns with a memory against a brute-force search, and minute paths against hand-computed cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticklane.plans import minutes, patterns

BARS = "code int, i long, o double, h double, l double, c double, volume double"


def random_bars(code, n, step, gaps=()):
    rng = np.random.default_rng(code)
    close = 100 * np.exp(np.cumsum(rng.normal(0, step, n)))
    rows, before = [], 100.0
    for i, c in enumerate(close.tolist()):
        high, low = max(before, c) * (1 + step * rng.random()), min(before, c) * (1 - step * rng.random())
        if i not in gaps:
            rows.append((code, i, before, high, low, c, float(rng.integers(50, 150))))
        before = c
    return rows


@pytest.fixture(scope="module")
def bars(spark):
    rows = [r for code in range(8) for r in random_bars(code, 260, 0.01 + 0.004 * (code % 3), {100} if code % 2 else ())]
    return rows, spark.createDataFrame(rows, BARS).cache()


def runs(rows):
    """Unbroken runs of bars of each code."""
    out = {}
    for r in rows:
        of = out.setdefault(r[0], [[]])
        if of[-1] and r[1] != of[-1][-1][1] + 1:
            of.append([])
        of[-1].append(r)
    return [run for of in out.values() for run in of]


def slow_turns(run, t, low):
    x = [r[4] if low else -r[3] for r in run[: t + 1]]
    return [i for i in range(2, t - 1) if x[i] < min(x[i - 1], x[i - 2]) and x[i] <= min(x[i + 1], x[i + 2])]


def slow_doubles_and_heads(run):
    found = {}
    for t in range(59, len(run)):
        for low in (True, False):
            v = lambda i: run[i][4 if low else 3]  # noqa: B023, E731
            turns = slow_turns(run, t, low)
            neck = lambda a, b: (max if low else min)(r[3 if low else 4] for r in run[a : b + 1])  # noqa: B023, E731
            outer = lambda *x: (min if low else max)(x)  # noqa: B023, E731
            if len(turns) > 1:
                p, q = turns[-2:]
                edge, k = outer(v(p), v(q)), neck(p, q)
                if 5 <= q - p <= 40 and t - q <= 15 and abs(v(p) / v(q) - 1) <= 0.04 and (k / edge if low else edge / k) - 1 >= 0.05:
                    found.setdefault(("double_bottom" if low else "double_top", run[p][1]), run[t][1])
            if len(turns) > 2 and t >= 89:
                p, q, r = turns[-3:]
                deep = v(q) < 0.97 * min(v(p), v(r)) if low else v(q) > 1.03 * max(v(p), v(r))
                if 5 <= q - p <= 30 and 5 <= r - q <= 30 and t - r <= 15 and abs(v(p) / v(r) - 1) <= 0.04 and deep:
                    found.setdefault(("head_bottom" if low else "head_top", run[p][1]), run[t][1])
    return {(run[0][0], kind, start, at) for (kind, start), at in found.items()}


def test_doubles_and_heads(bars):
    rows, df = bars
    expected = set().union(*map(slow_doubles_and_heads, runs(rows)))
    assert {(r.code, r.kind, r.start_i, r.i) for r in patterns.double_and_head(df).collect()} == expected
    assert {kind for _, kind, _, _ in expected} >= {"double_bottom", "double_top"}


def test_after_breakouts(spark):
    calm = [r for code in range(20, 60) for r in random_bars(code, 200, 0.006, {120} if code % 2 else ())]
    df = spark.createDataFrame(calm, BARS)
    vr = {(r.code, r.i): r.vr for r in patterns.prepared(df).collect()}
    expected = set()
    by_run = {(r[0], r[1]): (run, at) for run in runs(calm) for at, r in enumerate(run)}
    for e in patterns.detect(df, ["breakout"]).collect():
        run, d = by_run[e.code, e.i]
        lost, kinds = False, set()
        for t in range(d + 1, min(d + 11, len(run))):
            low, close = run[t][4], run[t][5]
            lost = lost or close < e.stop
            if not lost and abs(low / e.trigger - 1) <= 0.03 and close >= e.trigger and vr[e.code, run[t][1]] < 1 and "retest" not in kinds:
                kinds.add("retest")
                expected.add((e.code, "retest", e.start_i, run[t][1], e.stop))
            if close < 0.995 * e.trigger and "failed" not in kinds:
                kinds.add("failed")
                expected.add((e.code, "failed", e.start_i, run[t][1], max(r[3] for r in run[d : t + 1])))
    assert {(r.code, r.kind, r.start_i, r.i, r.stop) for r in patterns.after_breakouts(df).collect()} == expected
    assert {kind for _, kind, *_ in expected} == {"retest", "failed"}


def test_soldiers_are_invalidated_and_a_gap_ends_the_view(spark):
    falling = [(15 - i, 16 - i + 0.1, 14 - i - 0.1, 14.5 - i) for i in range(5)]
    shape = [*falling, (10, 11.1, 9.9, 11), (10.5, 12.1, 10.4, 12), (11.5, 13.1, 11.4, 13)]
    make = lambda rows: spark.createDataFrame([(1, i, *map(float, r), 1.0) for i, r in enumerate(rows) if r], BARS)
    only = lambda rows: [r for r in patterns.recent(make(rows), len(rows) - 1).collect() if r.kind == "soldiers"]
    (lost,) = only([*shape, (9, 9.5, 7.5, 8)])
    assert (lost.confirmed_i, lost.invalidated_i, lost.stage, lost.active, lost.distance) == (7, 8, "invalidated", True, None)
    (unseen,) = only([*shape, None, (9, 9.5, 7.5, 8)])
    assert (unseen.invalidated_i, unseen.stage, unseen.lifecycle_unknown, unseen.active) == (None, "confirmed", True, False)


def test_minute_window(spark):
    day = lambda d, *closes: [(1, d, 931 + k, float(c), 1.0) for k, c in enumerate(closes)]
    rows = spark.createDataFrame([*day("20260921", 11, 9), *day("20260922", 6, 4)], "code int, day string, time int, close double, volume double")
    factors = spark.createDataFrame([(1, "20260921", 1.0), (1, "20260922", 2.0)], "code int, day string, factor double")
    window = factors.select("day")
    base = spark.createDataFrame([(1, 10.0), (2, 10.0), (3, None)], "code int, baseline double")
    got = {r.code: r for r in minutes.over_window(minutes.day_paths(rows, factors), base, window).collect()}
    assert got[1].drawdown == pytest.approx(-100 / 3) and (got[1].peak, got[1].trough) == ("20260922 09:31", "20260922 09:32")
    assert (got[1].present, got[1].traded, got[1].expected, got[1].status) == (4, 4, 960 // 2, "OBSERVED")
    assert (got[2].status, got[2].drawdown, got[2].missing, got[3].status) == ("INCOMPLETE_MINUTES", None, 2, "MISSING_BASELINE")


def test_minute_statuses(spark):
    rows = [("slot", 1131, 1.0, 1.0), ("twice", 931, 1.0, 1.0), ("twice", 931, 1.0, 1.0), ("volume", 931, 1.0, -1.0), ("price", 931, None, 1.0), ("still", 931, None, 0.0), ("ok", 931, 9.0, 1.0), ("ok", 932, 12.0, 1.0), ("ok", 1301, 6.0, 2.0), ("factor", 931, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "code string, time int, close double, volume double").withColumn("day", F.lit("d"))
    codes = ["slot", "twice", "volume", "price", "still", "ok", "factor", "none"]
    factors = spark.createDataFrame([(c, "d", None if c == "factor" else 1.0) for c in codes], "code string, day string, factor double")
    days = minutes.day_paths(df, factors)
    got = {r.code: r.status for r in days.collect()}
    assert got == {**dict.fromkeys(("slot", "twice", "volume", "price"), "INVALID_MINUTE"), "still": "NO_TRADED_MINUTES", "ok": "OBSERVED", "factor": "MISSING_FACTOR", "none": "NO_MINUTE_ROWS"}
    closes = spark.createDataFrame([("ok", "d", 10.0)], "code string, day string, pre_close double")
    path = {r.code: r for r in minutes.against_close(days, closes).collect()}
    assert (path["ok"].drawdown, path["ok"].peak, path["ok"].trough) == (-50.0, "09:32", "13:01") and path["still"].drawdown is None
