"""Snapshots, quote paths, report facts, studies and screens on small rows with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from ticklane import queries, report_queries, study_queries  # noqa: F401  they register
from ticklane.functions import exprs as X
from ticklane.plans import book, contrasts, screens
from ticklane.registry import QUERIES

SHAPE = "code string, i long, trade_day string, t long, event_id long, last double, pre_close double, volume double, amount double, bid array<double>, ask array<double>, bid_qty array<double>, ask_qty array<double>"
TABLES = "nation customer supplier part orders lineitem events".split()


def snap(spark, rows):
    """Rows (t, bid, ask, bid quantity, ask quantity[, day[, last]]) of one code."""
    full = []
    for n, r in enumerate(rows):
        t, b, a, p, q, day, last = (*r, *("d", 10.0)[len(r) - 5 :])
        full.append(("x", 1, day, t, n, last, 9.0, 100.0 + n, 50.0, *([None if v is None else float(v)] for v in (b, a, p, q))))
    return spark.createDataFrame(full, SHAPE)


def path(spark, rows):
    return {r.segment: r for r in book.quote_path(snap(spark, rows), ["code", "i"], F.lit("d")).collect()}


def test_quote_path_by_segment(spark):
    got = path(spark, [(92500000, 1, 2, 1, 1), (93500000, 20000, 20200, 10, 30), (93510000, 19000, 19200, 10, 10), (93520000, 20200, 20400, 30, 10), (100000000, 20000, 20100, 5, 5), (None, 1, 2, 3, 4)])
    one, two = got[1], got[2]
    assert (one.observed, one.valid, one.first_time, one.last_time, one.depth_valid) == (3, 3, 93500000, 93520000, 3)
    assert (one.first_mid, one.low, one.last_mid) == pytest.approx((2.01, 1.91, 2.03))
    assert (one.change, one.recovery) == pytest.approx((100 * (2.03 / 2.01 - 1), 100 * (2.03 / 1.91 - 1)))
    assert one.top_imbalance == pytest.approx(0) and one.microprice == pytest.approx(0) and one.ten_valid == 0
    assert (two.valid, two.change, two.low) == (1, None, None)


def test_any_other_row_breaks_the_chain_of_equal_bids(spark):
    base = [(93500000, 100, 101, 10, 10), (93600000, 100, 101, 20, 10)]
    rows = path(spark, [*base, (93700000, 100, 101, None, 10), (93800000, 100, 101, 30, 10), (93900000, 100, 101, 30, 10)])[1]
    assert (rows.valid, rows.depth_valid, rows.same_bid, rows.same_bid_rise) == (5, 4, 2, 1)
    crossed = path(spark, [base[0], (93550000, 102, 101, 10, 10), base[1]])[1]
    assert (crossed.valid, crossed.same_bid) == (2, 0)


def test_gate(spark):
    gate = lambda rows: book.quote_gate(snap(spark, rows), ["code", "i"], F.lit("d")).first().gate
    ok = (93500000, 100, 101, 10, 10)
    assert gate([ok, (93600000, 1, 2, 3, 4)]) == "OPEN"
    assert gate([ok, (93600000, 1, 2, 3, 4, "other")]) == "INVALID_DATE"
    assert gate([ok, (93600000, 1, 2, 3, 4, None)]) == "INVALID_DATE"
    assert gate([ok, ok]) == "DUPLICATE_TIME"
    assert gate([ok, (91500000, 1, 2, 3, 4), (91500000, 1, 2, 3, 4)]) == "OPEN"
    assert path(spark, [ok, ok]) == {}


def ladders(spark, bid, ask, p, q):
    rows = spark.createDataFrame([tuple([None if v is None else float(v) for v in x] for x in (bid, ask, p, q))], "b array<double>, a array<double>, p array<double>, q array<double>")
    return rows.select(X.ladder_imbalance("b", "a", "p", "q").alias("plain"), X.ladder_imbalance("b", "a", "p", "q", True).alias("weighted")).first()


def test_ladders(spark):
    got = ladders(spark, [100, 98], [102, 104], [30, 0], [5, 5])
    assert got.plain == pytest.approx(50) and got.weighted == pytest.approx(100 * (30 - 7.5) / 37.5)
    locked = ladders(spark, [100, 97], [100, 101], [10, 10], [10, 10])  # scale is the nearest step, 1
    assert locked.weighted == pytest.approx(100 * (12.5 - 15) / 27.5)
    for bad in (([100, 100], [102, 104], [1, 1], [1, 1]), ([100, 98], [102, 102], [1, 1], [1, 1]), ([100, 98], [102, 104], [1, None], [1, 1]), ([100, 98], [102, 104], [0, 0], [0, 0]), ([103, 98], [102, 104], [1, 1], [1, 1])):
        assert ladders(spark, *bad).plain is None


def test_closing_rows_go_by_the_number_of_the_clock(spark):
    rows = snap(spark, [(93000000, 1, 2, 7, 8, "d", 5.0), (145600000, 1, 2, 3, None, "d", 6.0), (145700000, 1, 2, 9, 9, "d", 7.0), (150500000, 1, 2, 9, 9, "d", 8.0), (151000000, 1, 2, 9, 9, "d", 0.0), (None, 1, 2, 9, 9, "d", 4.0)])
    last, depth = book.closing_snapshot(rows, ["code"], ["event_id"]).first(), book.closing_book(rows, ["code"], ["event_id"]).first()
    assert (last.close, last.close_time) == (8.0, 150500000)
    assert (depth.book_time, depth.bid_depth, depth.ask_depth) == (145600000, 3.0, 0.0)


def test_reconciled(spark):
    shape = "code string, amount double"
    mine, shown = spark.createDataFrame([("a", 10.0), ("b", 10.0), ("c", None), ("d", 1.0)], shape), spark.createDataFrame([("a", 12.0), ("b", 12.1), ("c", None)], shape)
    got = {r.code: r.amount_agrees for r in book.reconciled(mine, shown, ["code"], ["amount"]).collect()}
    assert got == {"a": True, "b": False, "c": True, "d": False}


def test_names_are_one_a_code(spark):
    rows = book.named(spark.createDataFrame([("a",), ("b",)], "code string"), spark.createDataFrame([("a", "x"), ("a", "x"), (None, "y")], "code string, name string"), "none")
    assert sorted((r.code, r.name) for r in rows.collect()) == [("a", "x"), ("b", "none")]


def test_open_references(spark):
    closes = spark.createDataFrame([("x", k, float(10 + k)) for k in range(4)], "code string, i long, close double")
    bars = spark.createDataFrame([("x", 1, 22.0, 24.0, 20.0, 22.0, 5.0)], "code string, i long, o double, h double, l double, c double, volume double")
    events = spark.createDataFrame([("x", 0, "k"), ("x", 2, "k")], "code string, i long, kind string")
    got = {r.horizon: r for r in contrasts.open_references(events, bars, closes, [1, 2]).collect()}
    assert (got[1].events, got[1].pending, got[1].observed, got[1].open_observed, got[1].after_observed) == (2, 0, 2, 1, 0)
    assert got[1].gates == {"MISSING_BAR": 1, "PRICE_REFERENCE_ONLY": 1} and got[1].mean_gap == pytest.approx(10)
    assert (got[2].pending, got[2].after_observed) == (1, 1)
    assert (got[2].mean_to_target, got[2].mean_after_open) == pytest.approx((20, 100 / 11))


def test_board_contrasts(spark):
    rows = [(1, "M", s, v) for s, v in (("improving", 3.0), ("improving", 1.0), ("improving", 8.0), ("weakening", 1.0), ("weakening", 1.0), ("weakening", 1.0))] + [(1, "G", "improving", 5.0), (1, "G", "weakening", 1.0), (2, "G", "improving", 9.0)]
    got = {r.board: r for r in contrasts.board_contrasts(spark.createDataFrame([("up", *r) for r in rows], "market string, i long, board string, stock string, outcome double")).collect()}
    assert (got["ALL"].days, got["ALL"].board_days, got["ALL"].mean, got["ALL"].three_days, got["ALL"].three_spread) == (1, 2, 3.5, 1, 3.0)
    assert (got["M"].mean_median_spread, got["G"].three_days, got["G"].three_spread, got["G"].least_without_one) == (2.0, 0, None, None)


def test_pattern_screen(spark):
    events = spark.createDataFrame([("a", "p", "confirmed", True, 1, 9, 0.5), ("a", "q", "forming", True, 1, 7, None), ("b", "p", "failed", False, 1, 9, 0.1), ("c", "p", "confirmed", True, -1, 2, 2.0)], "code string, pattern string, stage string, active boolean, direction int, detected long, distance double")
    stocks = spark.createDataFrame([("a", 5.0, 1.0, 10.0, 9.0, None, 1.0), ("b", 5.0, 1.0, 10.0, 9.0, 1.0, 1.0), ("c", None, 1.0, 8.0, 9.0, 1.0, -1.0)], "code string, amount double, volume_ratio double, close double, average double, macd double, flow double")
    codes = lambda **k: sorted((r.code, r.hits) for r in screens.patterns(events, stocks, 10, **k).collect())
    assert codes() == [("a", 2), ("c", 1)]
    assert codes(types=["p", "q"], every=True) == [("a", 2)]
    assert codes(stage="failed") == [("b", 1)] and codes(age=1) == [("a", 1)] and codes(distance=(1, None)) == [("c", 1)]
    assert codes(amount=1) == [("a", 2)] and codes(macd=1) == [("c", 1)] and codes(above_average=False, flow=-1) == [("c", 1)]
    with pytest.raises(ValueError):
        screens.patterns(events, stocks, 10, distance=(2, 1))


def test_event_ids_are_those_of_a_json_list(spark):
    import hashlib

    row = spark.createDataFrame([("600000.SH", "gap", "20260901")], "a string, b string, c string").select(X.event_id("a", "b", "c").alias("x")).first()
    assert row.x == hashlib.sha256(b'["600000.SH","gap","20260901"]').hexdigest()[:20]


@pytest.mark.parametrize("name", sorted(n for n, f in QUERIES.items() if f.__module__ in ("ticklane.report_queries", "ticklane.study_queries")))
def test_empty_tables(spark, tmp_path_factory, name):
    folder = tmp_path_factory.getbasetemp() / "empty"
    if not folder.exists():
        for table in TABLES:
            spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").limit(0).write.parquet(f"{folder}/{table}.parquet")
    assert QUERIES[name](spark, str(folder)).count() == 0
