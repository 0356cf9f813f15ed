"""The follow-up study on hand-made rows: sessions left out, pools, gates, paths and sums."""

import pytest

from ticklane.plans import followup

FACTS = "code string, i long, amount double, net double, unknown double, ratio double"
BARS = "code string, i long, o double, h double, l double, c double, volume double"


def facts(spark, ratios):
    """Ratios by code and session; an amount of unknown side where the ratio is None."""
    rows = [(c, i, 100.0, r, 0.0 if r is not None else 5.0, r) for c, by in ratios.items() for i, r in by.items()]
    return spark.createDataFrame(rows, FACTS)


def prices(spark, closes):
    return spark.createDataFrame([(c, i, v) for c, by in closes.items() for i, v in by.items()], "code string, i long, close double")


def days(spark, held, span, calendar=range(12)):
    return followup.signal_days(spark.createDataFrame([(i,) for i in calendar], "i long"), spark.createDataFrame(list(held.items()), "i long, source string"), span)


def test_sessions_that_are_not_studied(spark):
    held = {0: "NATIVE", 1: "NATIVE", 3: "NATIVE", 4: "LEGACY_CALIBRATED_ROW_GUARD", 5: "LEGACY_CALIBRATED_ROW_GUARD", 6: "LEGACY_DIRECTION_UNKNOWN", 7: "LEGACY_DIRECTION_UNKNOWN", 8: None, 9: None}
    got = {r.i: (r.status, r.missing) for r in days(spark, held, followup.Span(0, 9, 9, 3)).collect()}
    lack, cross, good = "MISSING_FLOW", ("CROSSING_SOURCES", []), ("STUDIED", [])
    assert got == {0: (lack, [-1]), 1: good, 2: (lack, [2]), 3: (lack, [2]), 4: cross, 5: good, 6: cross, 7: cross, 8: cross, 9: cross}
    assert days(spark, held, followup.Span(0, 9, 9, 3), []).count() == 0


@pytest.mark.parametrize("wrong", [(5, 4, 9, 5), (0, 9, 8, 3), (0, 9, 9, 9), (3, 9, 9, 2), (0, 9, 9, 3, ()), (0, 9, 9, 3, (1, 1)), (0, 9, 9, 3, (0,)), (0, 9, 9, 3, (1.5,)), (0, 9, 9, 3, (True,))])
def test_spans_that_make_no_sense(wrong):
    with pytest.raises(ValueError):
        followup.Span(*wrong)


def test_observations_and_sums(spark):
    span = followup.Span(1, 8, 9, 5, (1, 2))
    flow = facts(spark, {
        "a": {0: -1.0, 1: 2.0, 3: -3.0, 4: -2.0, 7: -1.0, 8: 1.0},  # events in 1, 4 and 8; no flow in 2, so none in 3
        "b": {0: 1.0, 1: 1.0, 3: 1.0, 4: 1.0, 7: 1.0, 8: 1.0},  # in the pool, never an event
        "c": {0: -1.0, 1: None, 7: None, 8: 4.0},  # never in the pool
    })
    close = prices(spark, {
        "a": {1: 10.0, 2: 8.0, 3: 12.0, 4: 10.0, 5: None, 6: 11.0, 8: 10.0, 9: 9.0, 10: 99.0}, "b": {1: 10.0, 2: 11.0, 3: 11.0, 4: 10.0, 5: 10.0, 6: -1.0, 8: 10.0, 9: float("nan")}, "c": {1: 10.0, 2: 99.0}})
    bars = spark.createDataFrame([("a", 2, 1.0, 2.0, 1.0, 2.0, 5.0), ("a", 5, 1.0, 1.0, 1.0, 1.0, 5.0), ("a", 10, 1.0, 1.0, 1.0, 1.0, 5.0)], BARS)
    held = dict.fromkeys(range(12), "NATIVE")
    rows = followup.observations(flow, close, bars, days(spark, held, span), span)
    got = {(r.code, r.i, r.horizon): r for r in rows.collect()}
    assert set(got) == {("a", i, h) for i in (1, 4, 8) for h in (1, 2)}
    first = got["a", 1, 1]
    assert (first.kind, first.cohort, first.status, first.gate, first.before, first.change) == ("SELL_TO_BUY", "TRAIN", "OBSERVED", "PRICE_REFERENCE_ONLY", -1.0, 3.0)
    assert first.outcome == pytest.approx(-20) and first.benchmark == pytest.approx(-5) and first.pool_n == 2 and first.excess == pytest.approx(-15)
    second = got["a", 1, 2]
    assert second.outcome == pytest.approx(20) and second.drawdown == pytest.approx(-20) and (second.peak_i, second.trough_i) == (1, 2)
    gap, over = got["a", 4, 1], got["a", 4, 2]  # no close on the way: an outcome, but no path
    assert (gap.status, gap.cohort, gap.gate, gap.benchmark, gap.pool_n) == ("MISSING_PRICE", "EMBARGO", "ONE_PRICE_SESSION", 0.0, 1)
    assert (over.status, over.path_status, over.drawdown) == ("OBSERVED", "MISSING_PRICE", None) and over.outcome == pytest.approx(10) and over.pool_n == 1
    last, beyond = got["a", 8, 1], got["a", 8, 2]  # nothing after asof is looked at
    assert (last.cohort, last.gate, last.pool_n) == ("OUT_OF_SAMPLE", "MISSING_BAR", 1) and last.excess == 0.0
    assert (beyond.status, beyond.path_status, beyond.later, beyond.outcome, beyond.benchmark, beyond.pool_n) == ("PENDING", "PENDING", None, None, None, 0)
    sums = {(r.cohort, r.kind, r.horizon): r for r in followup.summary(rows).collect()}
    train = sums["TRAIN", "SELL_TO_BUY", 1]
    assert (train.events, train.observed, train.signal_days, train.mean_pool_n, train.positive_share, train.least_without_one) == (1, 1, 1, 2.0, 0.0, None)
    assert train.gates == {"PRICE_REFERENCE_ONLY": 1} and [(d.i, d.events, d.pool_n) for d in train.days] == [(1, 1, 2)]
    lost, wait = sums["EMBARGO", "SELL_EASING", 1], sums["OUT_OF_SAMPLE", "SELL_TO_BUY", 2]
    assert (lost.missing_price, lost.observed, lost.mean_outcome, lost.mean_pool_n, lost.signal_days, lost.trigger_days) == (1, 0, None, None, 0, 1)
    assert (wait.pending, wait.median_outcome, wait.days[0].pool_n) == (1, None, None)
    empty = followup.observations(flow.limit(0), close, bars, days(spark, held, span), span)
    assert empty.count() == 0 and followup.summary(empty).count() == 0


def test_range_of_session_means(spark):
    span = followup.Span(1, 3, 9, 2, (1,))
    ratios = {c: {i: (-1.0) ** (i + 1) * (k + 1) for i in range(4)} for k, c in enumerate("ab")} | {"p": dict.fromkeys(range(4), 1.0)}
    close = prices(spark, {"a": {i: 10.0 + i for i in range(6)}, "b": {i: 10.0 + i * i for i in range(6)}, "p": dict.fromkeys(range(6), 10.0)})
    rows = followup.observations(facts(spark, ratios), close, spark.createDataFrame([], BARS), days(spark, dict.fromkeys(range(4), "NATIVE"), span), span)
    means = {}
    for r in rows.collect():
        means.setdefault((r.cohort, r.kind), {}).setdefault(r.i, []).append(r.excess)
    for r in followup.summary(rows).collect():
        by_day = [sum(v) / len(v) for v in means[r.cohort, r.kind].values()]
        assert r.equal_day_mean == pytest.approx(sum(by_day) / len(by_day))
        if len(by_day) > 1:
            without = [(sum(by_day) - d) / (len(by_day) - 1) for d in by_day]
            assert r.least_without_one == pytest.approx(min(without)) and r.most_without_one == pytest.approx(max(without))
