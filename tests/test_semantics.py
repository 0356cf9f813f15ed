"""Hand-computed cases of the rules: unknown never becomes zero, gaps are not bridged, earliest ties win."""

import pytest
from pyspark.sql import functions as F

from ticklane.functions import exprs as X
from ticklane.operators import timeline as T
from ticklane.plans import micro, patterns, quality, state
from ticklane.sources import readers


def test_complete_net_is_null_with_unknown_side(spark):
    rows = spark.createDataFrame([("a", "B", 100.0), ("a", "B", 100.0), ("a", "?", 100.0), ("b", "S", 5.0), ("b", None, 0.0)], "code string, side string, amount double")
    got = {r.code: r for r in rows.groupBy("code").agg(X.known_net().alias("k"), X.unknown_amount().alias("u")).withColumn("net", X.complete_net("k", "u")).collect()}
    assert (got["a"].k, got["a"].u, got["a"].net) == (200.0, 100.0, None)
    assert got["b"].net == -5.0


@pytest.mark.parametrize("values, expected", [([100, 110, 100, 100], (-100 / 11, "1", "2")), ([100, 90, 95, 120], (-10, "0", "1")), ([1, 2, 3], (0, None, None)), ([1, None, 3], None)])
def test_drawdown(spark, values, expected):
    rows = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "at int, v double")
    path = rows.agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("p")).select(F.transform("p", lambda x: F.struct(x["v"].alias("v"), x["at"].alias("at"))).alias("p"))
    got = path.select(T.drawdown(F.col("p")).alias("d")).first()["d"]
    assert (got is None) if expected is None else (got.dd == pytest.approx(expected[0]) and (got.peak, got.trough) == expected[1:])


def facts(spark, ratios):
    rows = [(1, i, r, 100.0, None if r is None else r, 0.0, 10.0) for i, r in enumerate(ratios)]
    return spark.createDataFrame(rows, "code int, i long, ratio double, amount double, net double, unknown double, close double")


def test_streak_and_gap(spark):
    got = {r.i: r for r in state.states(state.panel(facts(spark, [-8.0, -6.0, -2.0])), 3).collect()}[2]
    assert (got.streak, got.improve, got.left_censored, got.status) == (3, 2, True, "AVAILABLE")
    got = {r.i: r for r in state.states(state.panel(facts(spark, [-8.0, None, -2.0])), 3).collect()}[2]
    assert (got.streak, got.improve, got.weighted, got.delta) == (1, 0, None, None)


@pytest.mark.parametrize("ratios, expected", [
    ([-8.0, -6.0, -4.0, 2.0], {(1, "SELL_EASING", "RESOLVED", 3), (2, "SELL_EASING", "RESOLVED", 3), (3, "SELL_TO_BUY", "ACTIVE", None)}),
    ([-8.0, -6.0, None, -4.0], {(1, "SELL_EASING", "UNKNOWN", 2)}), ([-1.0, 0.0, 1.0], set()), ([2.0, -1.0, -2.0, 0.0], {(1, "BUY_TO_SELL", "INVALIDATED", 3), (2, "SELL_WORSENING", "RESOLVED", 3)}),
])
def test_lifecycle(spark, ratios, expected):
    assert {tuple(r[1:]) for r in state.lifecycles(facts(spark, ratios)).collect()} == expected


def test_future_rows_change_nothing_before(spark):
    short, longer = facts(spark, [1.0, 2.0, -1.0]), facts(spark, [1.0, 2.0, -1.0, 9.0])
    a, b = (sorted(map(tuple, state.states(state.panel(x), 2).where("i < 3").collect()), key=repr) for x in (short, longer))
    assert a == b


def test_asof_is_strict(spark):
    trades = spark.createDataFrame([(1, 5, "x"), (1, 7, "y")], "code int, t int, id string")
    quotes = spark.createDataFrame([(1, 5, 1.0), (1, 3, 2.0)], "code int, t int, quote double")
    got = {r.id: r.quote for r in T.asof_before(trades, quotes, ["code"], "t", ["quote"]).collect()}
    assert got == {"x": 2.0, "y": 1.0}


def test_midrank_and_groups(spark):
    rows = spark.createDataFrame([(i, 5.0) for i in range(20)], "code int, v double")
    assert {r.p for r in T.midrank_percentile(rows, [], "v", "p").collect()} == {50.0}
    groups = spark.range(205).withColumn("k", F.lit(1))
    got = sorted((r.id, r.g) for r in T.equal_count_group(groups, ["k"], ["id"], "g").collect())
    assert [g for _, g in got] == [min(9, i * 10 // 205) + 1 for i in range(205)]


def test_displayed_recovery(spark):
    book = spark.createDataFrame([(1, t, p, q) for t, p, q in [(0, 1.0, 100.0), (2, 1.0, 50.0), (4, 1.0, 100.0), (6, 1.0, 80.0), (8, 0.9, 200.0)]], "k int, t long, price double, qty double")
    assert tuple(micro.displayed_recovery(book, ["k"], "t").first())[1:] == (3, 2, 1, 1, 2.0)


def test_print_status_first_violation(spark):
    rows = spark.createDataFrame([("ok", 1, 93000000, 12.0), ("ok", 2, 93000000, 10.0), ("ok", 3, 100001000, 9.0), ("seq", 1, 93000000, 1.0), ("seq", 1, 93000001, 1.0), ("clock", 1, 93000001, 1.0), ("clock", 2, 93000000, 1.0), ("bad", 1, 93000000, 0.0)], "k string, n long, t long, price double").withColumn("qty", F.lit(1.0))
    got = {r.k: r for r in micro.print_paths(rows, ["k"]).collect()}
    assert got["ok"].drawdown == pytest.approx(-25) and (got["ok"].peak, got["ok"].trough) == ("09:30:00.000", "10:00:01.000")
    assert {k: got[k].status for k in ("seq", "clock", "bad")} == {"seq": "INVALID_SEQUENCE", "clock": "INVALID_TIME_ORDER", "bad": "INVALID_PRINT"}


def test_soldiers_scale_and_gap(spark):
    falling = [(15 - i, 16 - i + 0.1, 14 - i - 0.1, 14.5 - i) for i in range(5)]
    bars = [*falling, (10, 11.1, 9.9, 11), (10.5, 12.1, 10.4, 12), (11.5, 13.1, 11.4, 13)]
    make = lambda rows: spark.createDataFrame([(1, i, *map(float, r), 1.0) for i, r in enumerate(rows) if r], "code int, i long, o double, h double, l double, c double, volume double")
    assert [(r.kind, r.i) for r in patterns.detect(make(bars), ["soldiers"]).collect()] == [("soldiers", 7)]
    assert [(r.kind, r.i) for r in patterns.detect(make([tuple(2 * x for x in r) for r in bars]), ["soldiers"]).collect()] == [("soldiers", 7)]
    assert patterns.detect(make([*bars[:3], None, *bars[4:]]), ["soldiers"]).count() == 0


def test_legacy_sides(spark):
    rows = spark.createDataFrame([(1, 20260922, 1000, 100, 0, 20, 10), (1, 20260922, 1000, 40, 1, 10, 30), (1, 20260922, 1000, 900, -1, 50, 0), (2, 20260922, 1000, 100, 0, 10, 20)], "SecuCode int, TradingDay int, Price int, Volume int, Side int, BuyID long, SellID long")
    got = {r.code: r for r in readers.legacy_trades(rows).groupBy("code").agg(F.sum("amount").alias("a"), X.known_net().alias("k"), X.unknown_amount().alias("u")).collect()}
    assert tuple(got["000001.SZ"])[1:] == (1400.0, 600.0, 0.0) and got["000002.SZ"].u == 1000.0


def test_calendar_gaps(spark):
    make = lambda rows: spark.createDataFrame(rows, "cal_date string, is_open int")
    days = readers.open_days(make([("20260918", 1), ("20260919", 0), ("20260920", 0), ("20260921", 1)]))
    assert [str(d) for d in readers.window_days(days, "2026-09-21", 2)] == ["2026-09-18", "2026-09-21"]
    with pytest.raises(ValueError):
        readers.open_days(make([("20260918", 1), ("20260920", 1)]))


def test_duplicates_with_nulls(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 1, None), ("a", 1, "x"), ("b", 2, "x")], "code string, t int, other string")
    assert tuple(quality.exact_duplicates(rows, ["code", "t"], "code").first()) == (1, 2, 1, 1)


def test_stream_of_flow(spark, tmp_path):
    from ticklane.streaming.flow import windowed_flow

    schema = "code string, time timestamp, side string, amount double"
    rows = spark.sql("SELECT * FROM VALUES ('a', timestamp'2026-01-01 09:10:00', 'B', 5D), ('a', timestamp'2026-01-01 09:50:00', '?', 1D), ('a', timestamp'2026-01-01 11:30:00', 'S', 2D) AS t(code, time, side, amount)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windowed_flow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "time")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("flow_test").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.known_net, r.unknown, r.net, r.trades) for r in spark.table("flow_test").collect())
    assert got == [(-2.0, 0.0, -2.0, 1), (5.0, 1.0, None, 2)]


def test_native_trades(spark, tmp_path):
    c = readers.TRADE_COLUMNS
    names = [c[k] for k in ("code", "trade_day", "t", "trade_id", "price", "qty", "side", "bid_id", "ask_id")]
    rows = [("000001.SZ", "20260922", "93000000", "1", "100000", "10", "B", "0", "9"), ("000001.SZ", "20260922", "126000000", "2", "100000", "10", None, "3", "4"), ("000001.SZ", "20260922", "93000003", "3", "100000", "999", "C", "3", "4"), ("000001.SZ", "20260921", "93000000", "4", "100000", "999", "B", "3", "4")]
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "d"))
    got = readers.native_trades(spark, str(tmp_path / "d"), "20260922")
    assert sorted((r.side or "", r.amount, r.pid) for r in got.collect()) == [("", 100.0, None), ("B", 100.0, 0)]
    assert len(readers.fingerprint(spark.read.parquet(str(tmp_path / "d")))) == 64


def test_an_event_is_settled_however_late(spark):
    ratios = [5.0, -4.0] + [-3.0] * 39 + [2.0]
    rows = [("a", i, 100.0, r, 0.0, r) for i, r in enumerate(ratios)]
    facts = spark.createDataFrame(rows, "code string, i long, amount double, net double, unknown double, ratio double")
    from ticklane.plans.state import lifecycles

    got = {(r.i, r.kind): (r.status, r.settled_i) for r in lifecycles(facts).collect()}
    assert got[1, "BUY_TO_SELL"] == ("INVALIDATED", 41) and got[41, "SELL_TO_BUY"] == ("ACTIVE", None)
    assert lifecycles(facts.limit(0)).count() == 0


def test_limit_list_names_codes_and_repeats(spark):
    import pytest

    from ticklane.sources.readers import limit_list

    rows = [("000001.SZ", "plain", 1.0, "U"), ("000002.SZ", " st abc", 1.0, "U"), ("000004.SZ", "*st x", 1.0, "U"), (None, "x", 1.0, "U"), ("600000.SH", "  ", 1.0, "U"), ("600004.SH", "y", None, "U"), ("000001.SZ", "down", 1.0, "D")]
    df = spark.createDataFrame(rows, "ts_code string, name string, close double, limit string")
    got = {r.ts_code: r.reason for r in limit_list(df).collect()}
    assert got == {"000001.SZ": None, "000002.SZ": "special", "000004.SZ": "special", None: "outside", "600000.SH": "no name", "600004.SH": "bad close"}
    with pytest.raises(ValueError):
        limit_list(df.unionByName(df))
