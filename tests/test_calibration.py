"""Audits of candidate ids and sides against hand-computed cases."""

from pyspark.sql import functions as F

from ticklane.plans import calibration

TRADES = "code int, side string, pid long, t long"
ORDERS = "code int, side string, t long, order_no long, exchange_no long"


def test_key_audit(spark):
    trades = spark.createDataFrame([(1, "B", 11, 93000000), (1, "S", 14, 100001000), (1, "?", 11, 93000000), (2, "B", 7, 93000000)], TRADES)
    orders = spark.createDataFrame([(1, "B", 93000000, 0, 11), (1, "B", 93000010, 0, 11), (1, "S", 93000000, 0, 14)], ORDERS)
    got = {r.code: r.asDict() for r in calibration.key_audit(trades, orders, "exchange_no").collect()}
    expected = {"status": "AVAILABLE", "order_rows": 3, "eligible": 2, "valid_rows": 3, "keys": 2, "repeated": 1, "multi_side": 0, "matched": 2, "same_side": 2, "single_same_side": 1,
                "repeated_matched": 1, "single_matched": 1, "comparable": 1, "earlier": 1, "same_time": 0, "later": 0}
    assert got[1] == {"code": 1, **expected}
    assert (got[2]["status"], got[2]["order_rows"], got[2]["eligible"], got[2]["matched"]) == ("NO_VALID_KEYS", 0, 1, 0)
    none = {r.code: r for r in calibration.key_audit(trades, orders, "order_no").collect()}
    assert (none[1].status, none[1].matched, none[1].keys) == ("NO_VALID_KEYS", 0, 0)
    missing = {r.code: r for r in calibration.key_audit(trades, orders.drop("order_no"), "order_no").collect()}
    assert (missing[1].status, missing[1].order_rows, missing[1].matched) == ("MISSING_FIELD", 3, None)
    untimed = {r.code: r for r in calibration.key_audit(trades, orders.drop("t"), "exchange_no").collect()}
    assert (untimed[1].matched, untimed[1].comparable, untimed[1].single_matched) == (2, None, None)


def test_id_agreement(spark):
    rows = [(1, 1000, 100, 0, 20, 10), (1, 1000, 100, 1, 20, 10), (600000, 1000, 50, 1, 10, 20), (600000, 1000, 50, -1, 10, 20), (1, 0, 50, 0, 10, 20), (400001, 1000, 50, 0, 20, 10), (1, 1000, 100, 9, 0, 10)]
    df = spark.createDataFrame(rows, "SecuCode int, Price int, Volume int, Side int, BuyID long, SellID long")
    got = {r.exchange: tuple(r)[1:] for r in calibration.id_agreement(df).collect()}
    assert got == {"SZ": (3, 2, 2, 1, 3000.0), "SH": (1, 1, 1, 1, 500.0)}


def test_quote_agreement(spark):
    quotes = spark.createDataFrame([(1, 1000, 9.0, 10.0), (1, 9000, 10.0, 10.0)], "code int, ms long, bid double, ask double")
    trades = [(1, 1000, 10.0, "B"), (1, 1500, 10.0, "B"), (1, 1600, 9.0, "B"), (1, 1700, 9.5, "S"), (1, 1800, 9.0, "S"), (1, 5000, 9.0, "S"), (1, 9100, 10.0, "S"), (1, 1500, 10.0, "?")]
    df = spark.createDataFrame(trades, "code int, ms long, price double, side string")
    assert {(r.side, r.eligible, r.agreement) for r in calibration.quote_agreement(df, quotes).collect()} == {("B", 2, 1), ("S", 1, 1)}


def test_empty_tables(spark):
    trades, orders = spark.createDataFrame([], TRADES), spark.createDataFrame([], ORDERS)
    assert calibration.key_audit(trades, orders, "order_no").count() == 0
    quotes = trades.select("code", F.col("t").alias("ms"), F.lit(1.0).alias("bid"), F.lit(2.0).alias("ask"))
    assert calibration.quote_agreement(trades.select("code", F.col("t").alias("ms"), F.lit(1.0).alias("price"), "side"), quotes).count() == 0
