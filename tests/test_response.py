"""Quote response and displayed recovery by part of the session, on hand-made rows."""

import pytest

from ticklane.plans import response

TRADES, QUOTES = "code string, day long, t long, price double, qty double, side string", "code string, day long, trade_day string, t long, bid double, ask double"


def _run(spark, trades, quotes, longest=10_000):
    t = spark.createDataFrame([("A", 1, t, float(p), float(q), s) for t, p, q, s in trades], TRADES)
    q = spark.createDataFrame([("A", 1, d, t, b, a) for d, t, b, a in quotes], QUOTES)
    return {r.part: r for r in response.quote_response(t, q, longest).collect()}


def q(t, mid, day="1"):
    return day, t, None if mid is None else mid * 10000.0, None if mid is None else mid * 10000.0


def test_pairs_by_what_they_say(spark):
    quotes = [q(93000000, 10), q(93003000, 10.1), q(93006000, 10.1), q(93009000, 10), q(93012000, None), q(93015000, 10), q(93018000, 10), q(93040000, 11), q(100000000, 5), q(145659000, 5), q(145700000, 9)]
    trades = [
        (93001000, 10, 5, "B"), (93002000, 10, 1, "S"),  # net bought, the mid rises 1 %
        (93003000, 10, 999, "S"),  # at a quote's time: in no interval
        (93004000, 10, 1, "S"),  # net sold, the mid stands: a zero move
        (93007000, 10, 1, None),  # unknown side
        (93010000, 10, 1, "B"), (93013000, 10, 1, "B"),  # an end has no mid
        (93016000, 10, 1, "B"), (93017000, 10, 1, "S"),  # as much bought as sold
        (93030000, 10, 1, "B"), (113500000, 10, 1, "B"),
    ]
    got = _run(spark, trades, quotes)
    assert set(got) == {1, 2, 3, 4, 5} and {r.status for r in got.values()} == {"AVAILABLE"}
    a = got[1]
    assert (a.quotes, a.pairs, a.gap_pairs, a.invalid_pairs, a.unknown_pairs, a.zero_pairs, a.flow_pairs) == (8, 7, 1, 2, 1, 1, 2)
    assert (round(a.mean_bps, 6), round(a.median_bps, 6), a.positive_share, a.zero_moves) == (50, 50, 50, 1)
    # what follows the first: bought, then 10.1 to 10.1; what follows the second: sold, then 10.1 to 10
    assert a.next_pairs == 2 and round(a.next_mean_bps, 6) == round(10000 * (1 - 10 / 10.1) / 2, 6)
    assert (got[2].quotes, got[2].pairs, got[2].mean_bps) == (1, 0, None) and (got[5].quotes, got[3].quotes) == (1, 0)


def test_next_interval_under_the_gap_rule(spark):
    trades = [(93001000, 10, 1, "B")]
    near = _run(spark, trades, [q(93000000, 10), q(93002000, 11), q(93012000, 22)])[1]
    assert (near.next_pairs, round(near.next_mean_bps, 6)) == (1, 10000)
    far = _run(spark, trades, [q(93000000, 10), q(93002000, 11), q(93012001, 22)])[1]
    assert (far.flow_pairs, far.gap_pairs, far.next_pairs, far.next_mean_bps) == (1, 1, 0, None)
    no_mid = _run(spark, trades, [q(93000000, 10), q(93002000, 11), q(93004000, None), q(93005000, 12)])[1]
    assert (no_mid.flow_pairs, no_mid.next_pairs) == (1, 0)
    other_part = _run(spark, [(95959000, 10, 1, "B")], [q(95958000, 10), q(95959500, 11), q(100000000, 12)])
    assert (other_part[1].flow_pairs, other_part[1].next_pairs) == (1, 0)


GOOD_T, GOOD_Q = (93001000, 10, 1, "B"), q(93000000, 10)


@pytest.mark.parametrize("trades, quotes, status", [
    ([(126100000, 10, 1, "B"), (93000000, 0, 1, "B")], [GOOD_Q], "INVALID_TRADE_CLOCK"), ([(None, 10, 1, "B")], [GOOD_Q], "INVALID_TRADE_CLOCK"),
    ([(93000000, float("inf"), 1, "B")], [q(93000000, 10, "2")], "INVALID_TRADE_PRINT"), ([(93000000, 10, 0, "B")], [GOOD_Q], "INVALID_TRADE_PRINT"),
    ([GOOD_T], [q(160000000, 10, "2"), q(None, 10)], "INVALID_QUOTE_DATE"), ([GOOD_T], [q(None, 10)], "INVALID_QUOTE_CLOCK"), ([GOOD_T], [q(100061000, 10)], "INVALID_QUOTE_CLOCK"),
    ([GOOD_T], [GOOD_Q, GOOD_Q], "DUPLICATE_QUOTE_TIME"), ([GOOD_T], [q(93000000, 10), q(93000000, 11)], "DUPLICATE_QUOTE_TIME"),
])
def test_faults_by_precedence(spark, trades, quotes, status):
    got = _run(spark, trades, quotes)
    assert list(got) == [None] and got[None].status == status and got[None].quotes is None and got[None].flow_pairs is None


def test_quotes_outside_the_parts_count_for_nothing(spark):
    got = _run(spark, [GOOD_T], [q(91500000, 10), q(91500000, 11), q(126100000, 3), q(93000000, 10)])
    assert {r.status for r in got.values()} == {"NO_COMPARABLE_PAIRS"} and got[1].quotes == 1
    alone = _run(spark, [GOOD_T], [])
    assert len(alone) == 5 and alone[1].status == "NO_COMPARABLE_PAIRS" and alone[1].quotes == 0
    empty = spark.createDataFrame([], TRADES)
    assert response.quote_response(empty, spark.createDataFrame([], QUOTES)).count() == 0


def test_days_do_not_meet(spark):
    t = spark.createDataFrame([("A", 2, 93000500, 10.0, 1.0, "B")], TRADES)
    quotes = spark.createDataFrame([("A", 1, "1", 93000000, 1e5, 1e5), ("A", 2, "2", 93001000, 2e5, 2e5), ("B", 2, "2", 93000000, 1e5, 1e5)], QUOTES)
    got = response.quote_response(t, quotes).where("part = 1").collect()
    assert {(r.code, r.day): (r.quotes, r.flow_pairs) for r in got} == {("A", 1): (1, 0), ("A", 2): (1, 0), ("B", 2): (1, 0)}


def test_recovery_by_part_and_clock(spark):
    rows = [("A", 1, t, "bid", p, s) for t, p, s in [(93000000, 1.0, 10.0), (93001000, 1.0, 4.0), (93003000, 1.0, 12.0), (100000000, 1.0, 5.0), (100001000, 1.0, 4.0), (103000000, 1.0, 1.0), (103061000, 1.0, 1.0), (130000000, 1.0, 1.0), (113000001, 9.0, 9.0)]]
    got = {r.part: tuple(r)[4:] for r in response.recovery_by_part(spark.createDataFrame(rows, "code string, day long, t long, side string, price double, qty double")).collect()}
    assert got == {1: ("OBSERVED", 2, 1, 1, 0, 2000.0), 2: ("OBSERVED", 1, 1, 0, 1, None), 3: ("INVALID_CLOCK", None, None, None, None, None), 4: ("NO_COMPARABLE", 0, 0, 0, 0, None)}
