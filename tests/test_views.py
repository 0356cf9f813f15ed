"""Views of the market at every session against a version in plain Python, on rows with gaps, unknown sides and zeros."""

import random

import pytest
from pyspark.sql import functions as F

from ticklane.plans import views

DENSE = "code string, i long, amount double, net double, unknown double, ratio double, close double"


def _rows(seed):
    rng, rows = random.Random(seed), []
    for code in range(9):
        for i in range(1, 8):
            amount = rng.choice([None, 0.0, 100.0, 200.0, 300.0, 100.0, 200.0])
            net = None if amount is None or rng.random() < 0.05 else rng.choice([-50.0, 0.0, 25.0, 40.0])
            ratio = 100 * net / amount if net is not None and amount else None
            rows.append((f"c{code}", i, amount, net, None if amount is None else rng.choice([0.0, 0.0, 0.0, 0.0, 5.0]), ratio, rng.choice([None, 1.0, 1.0, 1.25, 2.0, 2.0, 1.0, 1.0])))
    return rows


def _usable(r):
    return r is not None and r[5] is not None and r[2] is not None and r[2] > 0 and r[3] is not None and not (r[4] is not None and r[4] > 0)


def _by_hand(rows, n):
    by, codes, days = {(r[0], r[1]): r for r in rows}, sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    ret = {(c, d): 100 * (by[c, d][6] / by[c, d - 1][6] - 1) if (c, d - 1) in by and by[c, d][6] and by[c, d - 1][6] else None for c in codes for d in days}
    paths, ends = {}, {}
    for e in days:
        window = [d for d in days if e - n < d <= e]
        full = len(window) == n
        flow = [c for c in codes if full and all(_usable(by[c, d]) for d in window)]
        price = [c for c in codes if full and all(ret[c, d] is not None for d in window)]
        for d in window:
            amounts = [by[c, d][2] for c in codes if by[c, d][2] is not None and by[c, d][2] > 0]
            total, net = sum(by[c, d][2] for c in flow), sum(by[c, d][3] for c in flow)
            moved = [ret[c, d] for c in price]
            share = lambda test, of: 100 * sum(map(test, of)) / len(of) if of else None
            paths[e, d] = (
                len(window), sum(amounts) if amounts else None, len(amounts), sum(_usable(by[c, d]) for c in codes), sum(ret[c, d] is not None for c in codes), len(flow), total if flow else None, net if flow else None, 100 * net / total if flow else None,
                share(lambda r: r[5] > 0, [by[c, d] for c in flow]), len(price), share(lambda v: v > 0, moved), share(lambda v: v < 0, moved), share(lambda v: v == 0, moved),
            )
        ends[e] = ("INCOMPLETE_WINDOW" if not full else "AVAILABLE" if flow else "NO_COMMON_COHORT", "INCOMPLETE_WINDOW" if not full else "AVAILABLE" if price else "NO_COMMON_PRICE_COHORT")
    return paths, ends


def _near(a, b):
    return a == b or (a is not None and b is not None and abs(a - b) < 1e-9)


@pytest.mark.parametrize("seed, n", [(1, 1), (2, 2), (3, 3)])
def test_every_end_session(spark, seed, n):
    rows = _rows(seed)
    want, ends = _by_hand(rows, n)
    paths = views.trajectories(spark.createDataFrame(rows, DENSE), n)
    names = "length amount amount_coverage direction_coverage price_coverage common common_amount common_net ratio buy_share price_common up_share down_share level_share".split()
    got = {(r.end, r.i): r for r in paths.collect()}
    assert set(got) == set(want) and all(_near(got[k][c], v) for k, x in want.items() for c, v in zip(names, x, strict=True))
    assert any(x[5] for x in want.values()) and any(x[10] for x in want.values())
    for (e, d), r in got.items():
        before = got.get((e, d - 1))
        assert _near(r.ratio_delta, r.ratio - before.ratio if before and None not in (r.ratio, before.ratio) else None)
    told = {r.end: r for r in views.markets(paths, n).collect()}
    assert {e: (r.status, r.price_status) for e, r in told.items()} == ends
    for e, r in told.items():
        assert _near(r.latest_ratio, got[e, e].ratio if r.status == "AVAILABLE" else None) and (r.status == "AVAILABLE" or r.ratio_days is None)
        assert r.price_status == "AVAILABLE" or r.latest_up_share is None


def test_changes_of_all_codes(spark):
    rows = _rows(5)
    by = {(r[0], r[1]): r for r in rows}
    want = {}
    for d in range(2, 8):
        pairs = [(by[c, d - 1][5] if _usable(by[c, d - 1]) else None, by[c, d][5] if _usable(by[c, d]) else None) for c in {r[0] for r in rows}]
        known = [(a, b) for a, b in pairs if a is not None and b is not None]
        want[d] = (sum(b > a for a, b in known), sum(b < a for a, b in known), sum(b == a for a, b in known), len(pairs) - len(known), sum(a < 0 < b for a, b in known), sum(b < 0 < a for a, b in known))
    assert {r.i: tuple(r)[1:] for r in views.changes(spark.createDataFrame(rows, DENSE)).collect()} == want


@pytest.mark.parametrize("values, slope, run, rises", [
    ([1.0, 2.0, 4.0], 1.5, (1, 3, True), (2, True)), ([3.0, 2.0, 4.0], 0.5, (1, 3, True), (1, False)), ([-1.0, 0.0, 0.0], 0.5, (0, 2, False), (0, False)), ([1.0, None, 2.0], None, (1, 1, False), (None, False)),
    ([1.0, 2.0, None], None, (None, None, False), (None, False)), ([5.0], None, (1, 1, True), (None, False)), ([2.0, -1.0, -3.0], -2.5, (-1, 2, False), (0, False)),
])
def test_slopes_and_runs(spark, values, slope, run, rises):
    v = spark.createDataFrame([(values,)], "v array<double>").select(views.slope(F.col("v")).alias("s"), views.persistence(F.col("v")).alias("p"), views.improvement(F.col("v")).alias("r")).first()
    assert (v.s, tuple(v.p), tuple(v.r)) == (slope, run, rises)


def test_no_rows_no_views(spark):
    empty = spark.createDataFrame([], DENSE)
    assert views.trajectories(empty, 3).count() == 0 and views.markets(views.trajectories(empty, 3), 3).count() == 0 and views.changes(empty).count() == 0
