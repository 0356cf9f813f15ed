"""The limit-up study on hand-made rows: precedence of the statuses, benchmarks, horizons, cells."""

import pytest

from ticklane.plans import limitup
from ticklane.plans.limitup import Span

A, B, X, Y = "000001.SZ", "300001.SZ", "600001.SH", "600002.SH"


def _tables(spark, flow, listed, prices, bars, sources=None, lists=None):
    rows = [(c, i, float(a), None if r is None else a * r / 100, float(u), None if r is None else float(r)) for c, i, r, a, u in flow]
    known = sorted({i for _, i, *_ in flow})
    sources = sources or {i: "NATIVE" for i in known}
    lists = lists or sorted({i for _, i, *_ in listed})
    return (
        spark.createDataFrame(rows, "code string, i long, amount double, net double, unknown double, ratio double"), spark.createDataFrame(list(sources.items()), "i long, status string"),
        spark.createDataFrame([(i,) for i in lists], "i long"), spark.createDataFrame([(c, i, float(p), b) for c, i, p, b in listed], "code string, i long, close double, board string"),
        spark.createDataFrame([(c, i, None if p is None else float(p)) for c, i, p in prices], "code string, i long, close double"),
        spark.createDataFrame([(c, i, *map(lambda v: None if v is None else float(v), x)) for c, i, x in bars], "code string, i long, o double, h double, l double, c double, volume double"),
    )


def f(code, i, ratio, amount=100, unknown=0):
    return code, i, ratio, amount, unknown


BASE = [f(A, 1, -10), f(B, 1, 10), f(X, 1, -20), f(Y, 1, -20), f(A, 2, -5), f(B, 2, 5), f(X, 2, -10), f(Y, 2, -10)]
LISTED = [(A, 2, 10, "MAIN"), (B, 2, 10, "GEM")]
BARS = [(A, 2, (10, 10, 10, 10, 5)), (B, 2, (10, 10, 10, 10, 5))]


def test_outcomes_against_the_same_session_pool(spark):
    prices = [(A, 2, 10), (B, 2, 10), (A, 3, 11), (B, 3, 9)]
    days, events = limitup.study(*_tables(spark, BASE, LISTED, prices, BARS, lists=[1, 2]), Span(1, 2, 1, 3, (1,)))
    got = {d.i: d for d in days.collect()}
    assert got[1].study_status == "NO_ELIGIBLE_U" and got[1].common is None and got[1].matched is None
    d = got[2]
    assert (d.study_status, d.common, d.ratio_before, d.ratio_now, d.delta, d.matched, d.directed) == ("COMPARABLE", 2, -20, -10, 10, 2, 2)
    rows = {(r.cohort, r.horizon, r.market, r.stock): r for r in limitup.cells(events, Span(1, 2, 1, 3, (1,))).collect()}
    assert len(rows) == 12 and sum(r.events > 0 for r in rows.values()) == 2
    up, down = rows["OUT_OF_SAMPLE", 1, "IMPROVING", "IMPROVING"], rows["OUT_OF_SAMPLE", 1, "IMPROVING", "WEAKENING"]
    assert (round(up.mean_return, 9), round(up.mean_excess, 9), round(down.mean_return, 9), round(down.mean_excess, 9)) == (10, 10, -10, -10)
    # each board has one security, which is its own benchmark
    assert up.equal_day_board_excess == 0 and up.comparable_days == 1 and up.least_without_one is None and up.gates == {"MISSING_BAR": 1}
    assert [tuple(x)[:3] for x in up.daily] == [(2, 1, 1)]
    empty = rows["TRAIN", 1, "WEAKENING", "WEAKENING"]
    assert empty.events == 0 and empty.mean_return is None and empty.daily is None


@pytest.mark.parametrize("change, status", [
    (dict(lists=[1]), "MISSING_LIMIT_LIST"), (dict(listed=[(A, 1, 10, "MAIN")], lists=[1, 2]), "NO_ELIGIBLE_U"), (dict(flow=[r for r in BASE if r[1] == 2]), "MISSING_FLOW"), (dict(flow=[r for r in BASE if r[1] == 1]), "MISSING_FLOW"),
    (dict(sources={1: "NATIVE", 2: "LEGACY_CALIBRATED_ROW_GUARD"}), "SOURCE_NOT_COMPARABLE"), (dict(sources={1: "LEGACY_DIRECTION_UNKNOWN", 2: "LEGACY_DIRECTION_UNKNOWN"}), "SOURCE_NOT_COMPARABLE"), (dict(sources={2: "NATIVE"}), "SOURCE_NOT_COMPARABLE"),
    (dict(flow=[r for r in BASE if r[0] in (A, B)]), "MARKET_UNAVAILABLE_OR_FLAT"), (dict(flow=[*BASE[:6], f(X, 2, -20), f(Y, 2, -20)]), "MARKET_UNAVAILABLE_OR_FLAT"),
    (dict(bars=[(A, 2, (1, 1, 1, 10.02, 1)), (B, 2, (1, 1, 1, None, 1))]), "NO_VALID_U_PRICE"), (dict(prices=[(A, 2, None), (B, 3, 1)]), "NO_VALID_U_PRICE"),
    (dict(flow=[f(A, 1, -5), f(B, 1, 10, unknown=1), *BASE[2:]]), "NO_VALID_STOCK_DIRECTION"), (dict(bars=[(A, 2, (1, 1, 1, 10.01, 1)), BARS[1]]), "COMPARABLE"),
])
def test_the_first_thing_missing_is_the_status(spark, change, status):
    given = dict(flow=BASE, listed=LISTED, prices=[(A, 2, 10), (B, 2, 10)], bars=BARS) | change
    days, events = limitup.study(*_tables(spark, **given), Span(1, 2, 1, 3, (1,)))
    d = {r.i: r for r in days.collect()}[2]
    assert d.study_status == status
    looked_at = status in ("NO_VALID_U_PRICE", "NO_VALID_STOCK_DIRECTION", "COMPARABLE")
    assert (d.matched is not None) == looked_at and (d.common is not None) == (looked_at or status == "MARKET_UNAVAILABLE_OR_FLAT")
    if status == "NO_VALID_STOCK_DIRECTION":
        assert (d.matched, d.directed, d.undirected, d.flat) == (2, 0, 1, 1)
    if status != "COMPARABLE":
        assert events.count() == 0


def test_horizons_gates_and_open_references(spark):
    span = Span(2, 3, 2, 5, (1, 2, 3))
    flow = [f(c, i, r) for i, rs in {1: (-10, 10, -20), 2: (-5, 5, -10), 3: (-4, 4, -9)}.items() for c, r in zip((A, B, X), rs, strict=True)]
    listed = [(c, i, 10, "MAIN") for c in (A, B) for i in (2, 3)]
    bars = [(c, i, (10, 12, 9, 10, 5)) for c in (A, B) for i in (2, 3)] + [(A, 4, (11, 11, 11, 11, 5)), (B, 4, (11, 10, 9, 10, 5))]
    prices = [(c, i, 20) for c in (A, B) for i in (2, 3)] + [(A, 4, 22), (A, 5, 44), (B, 5, 10), (A, 6, 1), (B, 6, 1)]
    _, events = limitup.study(*_tables(spark, flow, listed, prices, bars), span)
    got = {(r.code, r.i, r.horizon): r for r in events.collect()}
    a, b = got[A, 3, 2], got[B, 3, 2]
    # a one-price session still gives a reference: 11 * 22 / 11 on the adjusted scale
    assert (a.gate, round(a.gap, 9), round(a.outcome, 9), round(a.after, 9), round(a.paired, 9)) == ("ONE_PRICE_SESSION", 10, 120, 100, 120)
    assert (b.gate, b.gap, b.after, round(b.outcome, 9)) == ("INVALID_OHLC", None, None, -50)
    assert got[A, 3, 1].after is None and round(got[A, 3, 1].gap, 9) == 10  # a horizon of one session has no later end
    assert got[B, 3, 1].mature and got[B, 3, 1].outcome is None  # no close: not filled from another session
    assert not got[A, 3, 3].mature and got[A, 3, 3].outcome is None and got[A, 3, 3].gate is None  # beyond asof, though prices exist
    assert {r.cohort for k, r in got.items() if k[1] == 2} == {"EMBARGO"} and {r.cohort for k, r in got.items() if k[1] == 3} == {"OUT_OF_SAMPLE"}
    cell = {(r.cohort, r.horizon, r.market, r.stock): r for r in limitup.cells(events, span).collect()}["OUT_OF_SAMPLE", 3, "IMPROVING", "IMPROVING"]
    assert (cell.events, cell.pending, cell.observed, cell.gates, cell.trigger_days, cell.comparable_days) == (1, 1, 0, None, 1, 0)


def test_spans_that_make_no_sense(spark):
    for wrong in ((2, 2, 2, 3, (1,)), (1, 3, 2, 2, (1,)), (1, 3, 2, 3, ()), (1, 3, 2, 3, (0,))):
        with pytest.raises(ValueError):
            Span(*wrong)
