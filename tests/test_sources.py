"""Trade files of several roots, price files and candle bundles, on files written by hand."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from ticklane.plans import state
from ticklane.sources import adapter, factors, files
from ticklane.sources.readers import TRADE_COLUMNS

DAY = "20260922"


def _legacy(path, rows, day=DAY, ids=True):
    names = ["SecuCode", "TradingDay", "Price", "Volume", "Side", *(["BuyID", "SellID"] if ids else [])]
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table({n: [(r[0], int(day), *r[1:])[k] for r in rows] for k, n in enumerate(names)}), path)


def _native(path, rows, day=DAY):
    """(code, price in ten-thousandths, quantity, side) as text, as the files have it."""
    made = {"code": [r[0] for r in rows], "trade_day": [day] * len(rows), "price": [r[1] for r in rows], "qty": [r[2] for r in rows], "side": [r[3] for r in rows]}
    made |= {c: ["7"] * len(rows) for c in ("t", "trade_id", "bid_id", "ask_id")}
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table({TRADE_COLUMNS[c]: pa.array(v, pa.string()) for c, v in made.items()}), path)


def _commit(root, day=DAY, marker=True, state="COMMITTED"):
    at = root / "_conversion_audit" / day
    at.mkdir(parents=True)
    if marker:
        (at / "COMMITTED").touch()
    if state is not None:
        (at / "manifest.json").write_text(state if state.startswith("{") else json.dumps({"commit_state": state}))


def test_calibrated_sides_and_conflicts(spark, tmp_path):
    rows = [(1, 1000, 100, 0, 20, 10), (1, 1000, 40, 1, 10, 30), (1, 1000, 900, -1, 50, 0), (2, 1000, 100, 0, 10, 20), (3, 1000, 100, 1, 0, 20), (4, 1000, 100, 0, 20, 20), (5, 1000, 100, 9, 20, 10)]
    _legacy(tmp_path / "a" / f"deal_{DAY}.parquet", rows)
    read = lambda calibrated: {r.code: r for r in adapter.daily_facts(spark, [adapter.Root("a", str(tmp_path / "a"), calibrated)], [DAY]).collect()}
    got = read(True)
    a = got["000001.SZ"]
    assert (a.amount, a.net, a.unknown, a.trades, a.status, a.reason) == (1400, 600, 0, 2, "LEGACY_CALIBRATED_ROW_GUARD", None)
    for code in ("000002.SZ", "000003.SZ", "000004.SZ", "000005.SZ"):
        assert got[code].unknown == 1000 and got[code].reason == "SIDE_AND_IDS_DISAGREE"
    # the same columns from a supplier that isn't calibrated have amounts and no sides
    b = read(False)["000001.SZ"]
    assert (b.amount, b.net, b.ratio, b.unknown, b.status, b.reason) == (1400, None, None, 1400, "LEGACY_DIRECTION_UNKNOWN", "SOURCE_NOT_CALIBRATED")


def test_calibrated_root_without_ids_has_no_sides(spark, tmp_path):
    _legacy(tmp_path / f"deal_{DAY}.parquet", [(600000, 1000, 100, 0)], ids=False)
    (r,) = adapter.daily_facts(spark, [adapter.Root("a", str(tmp_path), True)], [DAY]).collect()
    assert (r.code, r.status, r.net) == ("600000.SH", "LEGACY_DIRECTION_UNKNOWN", None)


def test_first_root_that_has_the_day_and_no_other(spark, tmp_path):
    new, old = tmp_path / "new", tmp_path / "old"
    native = [("000001.SZ", "100000", "100", "B"), ("000001.SZ", "100000", "50", None), ("000001.SZ", "100000", "30", "C"), ("900001.SZ", "100000", "1", "B"), ("000002.SZ", "x", "1", "B"), ("000002.SZ", "100000", "2", "S")]
    _native(new / f"deal_{DAY}.parquet", native)
    _commit(new)
    _legacy(old / f"deal_{DAY}.parquet", [(1, 1000, 999, 0, 20, 10)])
    _legacy(old / "deal_20260921.parquet", [(1, 1000, 10, 0, 20, 10), (1, 1000, 10, 0, 20, 10)], "20260921")
    roots = [adapter.Root("new", str(new)), adapter.Root("gone", str(tmp_path / "gone")), adapter.Root("old", str(old), True)]
    got = {(r.day, r.code): r for r in adapter.daily_facts(spark, roots, ["20260920", "20260921", DAY]).collect()}
    a = got[DAY, "000001.SZ"]
    assert (a.amount, a.net, a.unknown, a.trades, a.root, a.reason) == (1500, 1000, 500, 2, "new", "UNKNOWN_SIDE")
    assert got[DAY, "000002.SZ"].net == -20 and got["20260921", "000001.SZ"].root == "old" and got["20260921", "000001.SZ"].net == 200
    assert (got["20260920", None].status, got["20260920", None].root) == ("MISSING", None) and len(got) == 4


@pytest.mark.parametrize("marker, manifest, status", [(True, "COMMITTED", "NATIVE"), (False, "COMMITTED", "UNCOMMITTED"), (True, "PENDING", "UNCOMMITTED"), (True, None, "UNCOMMITTED"), (True, "{not json", "UNCOMMITTED")])
def test_native_files_count_once_committed(spark, tmp_path, marker, manifest, status):
    _native(tmp_path / f"deal_{DAY}.parquet", [("000001.SZ", "100000", "100", "B")])
    _commit(tmp_path, marker=marker, state=manifest)
    (r,) = adapter.daily_facts(spark, [adapter.Root("a", str(tmp_path))], [DAY]).collect()
    assert r.status == status and r.amount == (1000 if status == "NATIVE" else None)


def test_other_columns_wrong_days_and_mixed_types(spark, tmp_path):
    pq.write_table(pa.table({"SecuCode": [1], "Price": [2]}), tmp_path / f"deal_{DAY}.parquet")
    _legacy(tmp_path / "deal_20260918.parquet", [(1, 1000, 10, 0, 20, 10)], "20260917")
    # the same columns as text in one day and numbers in another
    pq.write_table(pa.table({c: ["1" if c == "SecuCode" else "20260921" if c == "TradingDay" else "10"] for c in ("SecuCode", "TradingDay", "Price", "Volume", "Side")}), tmp_path / "deal_20260921.parquet")
    _legacy(tmp_path / "deal_20260919.parquet", [(1, 1000, 10, 0, 20, 10)], "20260919")
    got = {r.day: r for r in adapter.daily_facts(spark, [adapter.Root("a", str(tmp_path))], ["20260918", "20260919", "20260921", DAY]).collect()}
    assert got[DAY].status == "UNKNOWN_SCHEMA" and got["20260918"].status == "LEGACY_DIRECTION_UNKNOWN" and got["20260918"].code is None
    assert got["20260919"].amount == 100 and got["20260921"].amount == 1
    told = adapter.lineage(spark.createDataFrame([("20260919",), ("19990101",)], "day string"), adapter.daily_facts(spark, [adapter.Root("a", str(tmp_path))], ["20260919"]))
    assert {r.day: (r.source_status, r.source) for r in told.collect()} == {"20260919": ("LEGACY_DIRECTION_UNKNOWN", "a"), "19990101": ("MISSING", None)}
    assert adapter.daily_facts(spark, [], ["20260919"]).collect()[0].status == "MISSING" and adapter.daily_facts(spark, [], []).count() == 0


HEAD = "ts_code,trade_date,open_qfq,high_qfq,low_qfq,close_qfq,vol,amount"


def _csv(path, head, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([head, *rows]) + "\n")


def _dates(spark, *days):
    return spark.createDataFrame([(d,) for d in days], "trade_date string")


def test_candles_by_code_end_at_the_target(spark, tmp_path):
    _csv(tmp_path / "600001_SH_stk_factor_pro.csv", HEAD, "600001.SH,20260921,50,60,45,55,7,3", "600001.SH,20260922,55,60,50,58,-1,", "600001.SH,20260923,20,30,10,25,1,1", "600001.SH,20260921,50,60,45,55,7,3")
    # other order of columns and more of them
    _csv(tmp_path / "000002_SZ_stk_factor_pro.csv", "trade_date,extra,ts_code,close_qfq,low_qfq,high_qfq,open_qfq", "20260918,z,000002.SZ,4,3,4,5", "20260922,z,000002.SZ,4,3,inf,5")
    root = str(tmp_path)
    assert set(files.listed(spark, root, factors.BY_CODE)) == {"600001_SH", "000002_SZ"}
    rows = factors.factor_rows(spark, root, factors.BY_CODE, ["600001_SH", "000002_SZ", "000003_SZ"], "ts_code")
    got = [tuple(r) for r in factors.candles(rows, _dates(spark, "20260917", "20260920"), DAY).orderBy("code", "position").collect()]
    assert got == [("000002.SZ", *[None] * 8, 2), ("600001.SH", 3, "20260921", 50.0, 60.0, 45.0, 55.0, 7.0, 3000.0, 0), ("600001.SH", 4, "20260922", 55.0, 60.0, 50.0, 58.0, None, None, 0)]
    few = [tuple(r)[:3] for r in factors.candles(rows, _dates(spark, "20260920"), DAY, 2).orderBy("code", "position").collect()]
    assert few == [("000002.SZ", None, None), ("600001.SH", 0, "20260921"), ("600001.SH", 1, "20260922")]


def test_two_bars_of_a_date_and_foreign_rows_raise(spark, tmp_path):
    _csv(tmp_path / "a" / "600001_SH_stk_factor_pro.csv", HEAD, "600001.SH,20260922,5,6,3,4,1,1", "600001.SH,20260922,5,6,3,5,1,1")
    rows = factors.factor_rows(spark, str(tmp_path / "a"), factors.BY_CODE, ["600001_SH"], "ts_code")
    with pytest.raises(ValueError, match="two different bars"):
        factors.candles(rows, _dates(spark), DAY)
    _csv(tmp_path / "b" / "600001_SH_stk_factor_pro.csv", HEAD, "600002.SH,20260922,5,6,3,4,1,1")
    with pytest.raises(ValueError, match="another key"):
        factors.factor_rows(spark, str(tmp_path / "b"), factors.BY_CODE, ["600001_SH"], "ts_code")
    _csv(tmp_path / "c" / "20260922_stk_factor_pro.csv", HEAD, "600002.SH,20260921,5,6,3,4,1,1")
    with pytest.raises(ValueError, match="another key"):
        factors.factor_rows(spark, str(tmp_path / "c"), factors.BY_DAY, [DAY], "trade_date")
    assert factors.candles(factors.factor_rows(spark, str(tmp_path / "none"), factors.BY_DAY, [DAY], "trade_date"), _dates(spark), DAY).count() == 0


PRICES = "ts_code,trade_date,open,high,low,close,vol,adj_factor"


def test_adjusted_closes(spark, tmp_path):
    _csv(tmp_path / f"{DAY}_stk_factor_pro.csv", "﻿" + PRICES, f"A,{DAY},1,2,1,2,5,1.5", f"B,{DAY},1,2,1,,5,1.5", f"C,{DAY},1,2,1,nan,5,1", f"D,{DAY},1,2,1,-2,5,1", f"E,20260101,1,2,1,2,5,1", f"F,{DAY},1,x,1,2,,")
    got = {r.code: (r.close, r.c, r.h, r.volume) for r in factors.adjusted_closes(spark, str(tmp_path), [DAY, "20260923"]).collect()}
    assert got == {"A": (3.0, 2.0, 2.0, 5.0), "B": (None, None, 2.0, 5.0), "C": (None, None, 2.0, 5.0), "D": (None, -2.0, 2.0, 5.0), "F": (None, 2.0, None, None)}
    _csv(tmp_path / "20260923_stk_factor_pro.csv", PRICES, "A,20260923,1,2,1,2,5,1", "A,20260923,1,2,1,3,5,1")
    with pytest.raises(ValueError, match="twice"):
        factors.adjusted_closes(spark, str(tmp_path), ["20260923"])


def test_merged_facts_fill_no_gaps(spark):
    flow = spark.createDataFrame([("a", 1, 10.0, 1.0, 0.0, 10.0), ("a", 3, 10.0, 2.0, 0.0, 20.0), ("b", 1, 10.0, 1.0, 0.0, 10.0), ("b", 2, 5.0, 1.0, 0.0, 20.0), ("x", 1, 1.0, 1.0, 0.0, 1.0)], "code string, i long, amount double, net double, unknown double, ratio double")
    prices = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 6.0), ("a", 3, None), ("c", 1, 1.0), ("c", 2, 2.0), ("c", 3, 3.0)], "code string, i long, close double")
    facts = state.merged(flow, prices)
    assert {(r.code, r.i): r.evidence for r in facts.collect()} == {("a", 1): "BOTH", ("a", 2): "PRICE", ("a", 3): "FLOW", ("b", 1): "FLOW", ("b", 2): "FLOW", ("x", 1): "FLOW", ("c", 1): "PRICE", ("c", 2): "PRICE", ("c", 3): "PRICE"}
    dense = state.universe_panel(spark.createDataFrame([("a",), ("b",), ("c",), ("none",)], "code string"), spark.range(1, 4).withColumnRenamed("id", "i"), facts)
    got = {(r.code, r.i): r for r in state.states(dense, 2).collect()}
    assert len(got) == 12
    assert got["a", 2].level is None and got["a", 3].level == 20 and got["a", 3].delta is None and got["a", 3].price_return is None
    assert (got["b", 2].status, got["b", 2].delta, got["b", 3].status) == ("AVAILABLE", 10, "PARTIAL")
    assert got["c", 3].level is None and got["c", 3].price_return == 200 and got["none", 3].valid == 0 and got["none", 3].level is None
