"""The checks of a deep look and the nested cards, on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from ticklane.functions import exprs as X
from ticklane.plans import cards

TRADES = "code string, i long, trade_day string, t long, amount double, qty double, side string, pid long"
BOUNDS = (100, 300, 600)


def _trades(spark, *rows):
    return spark.createDataFrame([("A", 1, d, t, float(a), float(q), s, p) for d, t, a, q, s, p in rows], TRADES)


TWO = [("1", 93000000, 250, 10, "B", 7), ("1", 93000500, 150.4, 5, "B", 7), ("1", 91500000, 50, 5, "S", 0)]


def _dive(spark, trades, orders=(("1", 5.0),), amount=450.4, net=350.4):
    orders = spark.createDataFrame([("A", 1, *o) for o in orders], "code string, i long, trade_day string, qty double")
    reported = spark.createDataFrame([("A", 1, amount, net)], "code string, i long, amount double, net double")
    return cards.deep_dive(_trades(spark, *trades), orders, reported, ["code", "i"], F.col("i").cast("string"), BOUNDS).first()


def test_a_deep_look_that_holds(spark):
    r = _dive(spark, TWO)
    assert (r.status, r.trade_rows, r.parents, r.parents_net, r.order_rows, r.bad_orders) == ("PUBLISHED", 3, 2, 350, 1, 0)
    assert round(r.coverage, 6) == round(100 * 400.4 / 450.4, 6) and r.net_mine == r.known_net == 350.4


@pytest.mark.parametrize("change, status", [
    (dict(trades=[]), "NO_TRADES"), (dict(trades=[*TWO, ("2", 93000000, 1, 1, "B", 1)], amount=1.0), "BAD_DAY"), (dict(trades=[*TWO, (None, 93000000, 1, 1, "B", 1)]), "BAD_DAY"), (dict(amount=452.5), "AMOUNT_DIFFERS"), (dict(amount=None), "AMOUNT_DIFFERS"),
    (dict(net=None), "NET_STATUS_DIFFERS"), (dict(trades=[*TWO, ("1", 93000000, 1, 1, "?", 1)]), "NET_STATUS_DIFFERS"), (dict(net=348.0), "NET_DIFFERS"), (dict(orders=[]), "NO_ORDERS"), (dict(orders=[("1", 1.0), ("1", None)]), "BAD_ORDERS"), (dict(orders=[("3", 1.0)]), "BAD_ORDERS"),
    (dict(amount=452.0, net=352.0), "PUBLISHED"), (dict(trades=[*TWO, ("1", 93000000, 1, 1, "?", 1)], net=None), "PUBLISHED"),
])
def test_what_is_wrong_first(spark, change, status):
    assert _dive(spark, **(dict(trades=TWO) | change)).status == status


def test_parents_must_add_up(spark, monkeypatch):
    off = cards.counted_parents
    monkeypatch.setattr(cards, "counted_parents", lambda *a: off(*a).withColumn("net", F.col("net") + 3))
    assert _dive(spark, TWO).status == "PARENTS_UNBALANCED"


def test_cards_are_nested_and_in_order(spark):
    trades = _trades(spark, ("1", 140000000, 700, 7, "B", 9), ("1", 93000000, 250, 10, "B", 7), ("1", 93000500, 50, 5, "?", 0), ("1", 103000000, 50, 4, "S", None), ("1", 126000000, 5, 1, "S", 3))
    facts = spark.createDataFrame([("A", 1, "unknown", None, 10.0, 1055.0, None), ("A", -7, "push", 1.0, 9.0, 1.0, 1.0), ("A", -5, "push", 1.5, 9.0, 2.5, 0.5), ("B", 1, "push", 2.0, 8.0, 3.0, 4.0)], "code string, i long, label string, ret double, close double, amount double, net double")
    orders = spark.createDataFrame([("A", 1, "U", "S", 1.0), ("A", 1, None, "B", 2.0), ("A", 1, "U", "B", 3.0), ("A", 1, "U", "B", None)], "code string, i long, kind string, side string, qty double")
    got = {(r.code, r.i): r for r in cards.cards(facts, trades, orders, BOUNDS).collect()}
    a = json.loads(got["A", 1].card)
    assert (a["net"], a["ret"], a["direction"], a["amount"]) == (None, None, "UNKNOWN", 1055)
    assert [(s["s"], s["a"], s["n"]) for s in a["segments"]] == [(1, 300, None), (3, 50, -50), (5, 700, 700)] and a["segments"][0]["v"] == 20
    assert [(p["b"], p["n"], p["c"]) for p in a["parents"]] == [("small", -5, 1), ("medium", 250, 1), ("huge", 700, 1), ("no id", -50, 1)]
    assert [(o["t"], o["s"], o["r"], o["q"]) for o in a["orders"]] == [("U", "B", 2, 3), ("U", "S", 1, 1), ("none", "B", 1, 2)]
    assert [(h["i"], h["net"]) for h in a["history"]] == [(-5, 1), (1, None)]  # seven sessions back, no more
    b = json.loads(got["B", 1].card)
    assert b["segments"] == b["parents"] == b["orders"] == [] and list(b) == ["code", "i", "label", "ret", "close", "amount", "net", "direction", "segments", "parents", "orders", "history"]
    text = spark.createDataFrame([(got["A", 1].card,)], "card string").select(F.sha2("card", 256).alias("x")).first().x
    assert got["A", 1].card_id == text and spark.range(1).select(X.content_id(F.struct(F.lit(None).cast("int").alias("a"))).alias("x")).first().x != text
