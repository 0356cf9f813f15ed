"""Queries over files: trade files of several roots, price files by day, candle bundles. Each writes files of the given tables'
rows to a shared folder, in the layouts the readers know, and reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklane.functions import exprs as X
from ticklane.plans import state
from ticklane.queries import states_sql
from ticklane.registry import R, query, rounded
from ticklane.sources import adapter, factors, files
from ticklane.sources import domain as D
from ticklane.sources.readers import TRADE_COLUMNS
from ticklane.study_queries import _BARS, _bars

LAYOUT = "day={key}"


def _day(i) -> F.Column:
    """A session's first day as YYYYMMDD; i counts months."""
    month = (i - 1) % 12 + 1
    return ((i - month) / 12 * 10000 + month * 100 + 1).cast("long").cast("string")


_DAY = "CAST((i - ((i - 1) % 12 + 1)) // 12 * 10000 + ((i - 1) % 12 + 1) * 100 + 1 AS VARCHAR)"
_CODE = """CASE WHEN code % 50 = 49 THEN 900000 + code % 1000 WHEN code % 2 = 0 THEN code % 1000 ELSE 600000 + code % 1000 END"""


def _trades(spark: SparkSession, sf: str) -> DataFrame:
    """Trades with their day, what becomes of that day (0 to 7) and the number of their security."""
    number = F.when(F.col("code") % 50 == 49, 900000 + F.col("code") % 1000).when(F.col("code") % 2 == 0, F.col("code") % 1000).otherwise(600000 + F.col("code") % 1000)
    x = D.deals(spark, sf).withColumn("day", _day(F.col("i"))).withColumn("kind", F.col("i") % 8).withColumn("number", number)
    return x.withColumn("trade_day", F.when(F.col("pid") % 97 == 0, "19700101").otherwise(F.col("day")))


def _native(x: DataFrame) -> DataFrame:
    made = {
        "code": F.concat(F.lpad(F.col("number").cast("string"), 6, "0"), F.when(F.col("number") >= 600000, ".SH").otherwise(".SZ")), "trade_day": F.col("trade_day"), "t": F.lit("93000000"),
        "trade_id": F.col("trade_id").cast("string"), "price": F.floor(F.col("price") * 10000 + 0.5).cast("string"), "qty": F.col("qty").cast("string"),
        "side": F.when((F.col("side") == "?") & (F.col("pid") % 2 == 1), None).otherwise(F.col("side")), "bid_id": F.col("pid").cast("string"), "ask_id": F.col("pid").cast("string"),
    }
    return x.select("day", *(c.alias(TRADE_COLUMNS[name]) for name, c in made.items()))


def _legacy(x: DataFrame) -> DataFrame:
    side = F.when(F.col("side") == "B", 0).when(F.col("side") == "S", 1).when(F.col("side") == "C", F.when(F.col("pid") % 2 == 0, -11).otherwise(-1)).otherwise(9)
    own, other = F.when(F.col("trade_id") % 5 == 0, 0).otherwise(F.col("pid") * 10 + 5), F.col("pid") * 10 + 1
    bid, ask = F.when(F.col("side") == "B", own).otherwise(other), F.when(F.col("side") == "B", other).otherwise(own)
    return x.select("day", F.col("number").alias("SecuCode"), F.col("trade_day").cast("long").alias("TradingDay"), F.lit(93000000).alias("DealTime"), F.floor(F.col("price") * 100 + 0.5).alias("Price"), F.col("qty").alias("Volume"), side.alias("Side"), bid.alias("BuyID"), ask.alias("SellID"))


def trade_roots(spark: SparkSession, sf: str) -> tuple[list[adapter.Root], list[str]]:
    """Three roots of daily files, and all days. By the session's number modulo 8: committed native files (0), without a marker
    (1), with a manifest that says no (2), calibrated legacy (3), other legacy (4), other columns (5), none (6), and committed
    native files beside legacy ones of the same day (7)."""
    folder, x = files.shared_folder(spark), files.stored(_trades(spark, sf))
    roots = [adapter.Root("primary", f"{folder}/primary"), adapter.Root("calibrated", f"{folder}/calibrated", True), adapter.Root("older", f"{folder}/older")]
    write = lambda rows, root, how="overwrite": rows.write.mode(how).partitionBy("day").parquet(root.path)
    write(_native(x.where("kind IN (0, 1, 2, 7)")), roots[0])
    write(x.where("kind = 5").select("day", "code", "price"), roots[0], "append")
    write(_legacy(x.where("kind IN (3, 7)")), roots[1])
    write(_legacy(x.where("kind = 4")), roots[2])
    days = [(r["day"], r["kind"]) for r in x.select("day", "kind").distinct().collect()]  # a row a session
    for day, kind in days:
        at = f"{roots[0].path}/_conversion_audit/{day}"
        if kind in (0, 2, 7):
            files.put(spark, f"{at}/COMMITTED")
        if kind in (0, 1, 7):
            files.put(spark, f"{at}/manifest.json", '{"commit_state": "COMMITTED"}')
        if kind == 2:
            files.put(spark, f"{at}/manifest.json", '{"commit_state": "PENDING"}')
    return roots, sorted(d for d, _ in days)


@query(f"""WITH x AS (SELECT *, {_DAY} AS day, i % 8 AS k, {_CODE} AS number FROM ({D.DEALS})),
t AS (SELECT day, k, number, CASE WHEN k IN (3, 4) THEN floor(price * 100 + 0.5) / 100 ELSE floor(price * 10000 + 0.5) / 10000 END * qty AS amount,
  CASE WHEN k IN (0, 7) THEN side WHEN k = 3 AND side IN ('B', 'S') AND trade_id % 5 <> 0 THEN side END AS side FROM x WHERE price > 0 AND qty > 0 AND side <> 'C' AND pid % 97 <> 0 AND number < 900000 AND k IN (0, 3, 4, 7)),
f AS (SELECT day, k, number, sum(amount) AS amount, sum(CASE side WHEN 'B' THEN amount WHEN 'S' THEN -amount ELSE 0.0 END) AS net, sum(CASE WHEN side IN ('B', 'S') THEN 0.0 ELSE amount END) AS unknown, count(*) AS trades FROM t GROUP BY ALL),
d AS (SELECT DISTINCT day, k FROM x)
SELECT day, CASE k WHEN 0 THEN 'NATIVE' WHEN 7 THEN 'NATIVE' WHEN 3 THEN 'LEGACY_CALIBRATED_ROW_GUARD' WHEN 4 THEN 'LEGACY_DIRECTION_UNKNOWN' WHEN 5 THEN 'UNKNOWN_SCHEMA' WHEN 6 THEN 'MISSING' ELSE 'UNCOMMITTED' END AS status,
 CASE k WHEN 3 THEN 'calibrated' WHEN 4 THEN 'older' WHEN 6 THEN NULL ELSE 'primary' END AS root,
 lpad(CAST(number AS VARCHAR), 6, '0') || CASE WHEN number >= 600000 THEN '.SH' ELSE '.SZ' END AS code, {R("amount", 2)} AS amount, CASE WHEN k <> 4 THEN {R("net", 2)} END AS net, {R("unknown", 2)} AS unknown,
 CASE WHEN k <> 4 THEN {R("100 * net / amount")} END AS ratio, trades, CASE WHEN k = 4 AND number IS NOT NULL THEN 'SOURCE_NOT_CALIBRATED' WHEN NOT unknown > 0 THEN NULL WHEN k IN (0, 7) AND number IS NOT NULL THEN 'UNKNOWN_SIDE' WHEN number IS NOT NULL THEN 'SIDE_AND_IDS_DISAGREE' END AS reason
FROM d LEFT JOIN f USING (day, k)""")
def source_facts(spark: SparkSession, sf: str) -> DataFrame:
    roots, days = trade_roots(spark, sf)
    return rounded(adapter.daily_facts(spark, roots, days, LAYOUT), amount=2, net=2, unknown=2, ratio=4)


@query(f"""WITH d AS (SELECT DISTINCT i, {_DAY} AS day, i % 8 AS k FROM ({D.DEALS})), m AS (SELECT i, count(*) AS codes, {R("sum(amount)", 2)} AS amount FROM ({D.FACTS}) GROUP BY i)
SELECT day, codes, amount, CASE k WHEN 0 THEN 'NATIVE' WHEN 7 THEN 'NATIVE' WHEN 3 THEN 'LEGACY_CALIBRATED_ROW_GUARD' WHEN 4 THEN 'LEGACY_DIRECTION_UNKNOWN' WHEN 5 THEN 'UNKNOWN_SCHEMA' WHEN 6 THEN 'MISSING' ELSE 'UNCOMMITTED' END AS source_status,
 CASE k WHEN 3 THEN 'calibrated' WHEN 4 THEN 'older' WHEN 6 THEN NULL ELSE 'primary' END AS source FROM m JOIN d USING (i)""")
def source_lineage(spark: SparkSession, sf: str) -> DataFrame:
    """The market's sessions with the source each of them is from."""
    roots, days = trade_roots(spark, sf)
    by_day = D.facts(spark, sf).groupBy("i").agg(F.count("*").alias("codes"), F.sum("amount").alias("amount")).select(_day(F.col("i")).alias("day"), "codes", X.rounded("amount", 2).alias("amount"))
    return adapter.lineage(by_day, adapter.daily_facts(spark, roots, days, LAYOUT))


_PRICED = f"SELECT code, i, {R('1 + i % 5 / 10.0', 1)} AS f, o, h, l, CASE WHEN (code * 3 + i) % 29 <> 0 THEN c END AS c, volume FROM ({_BARS}) WHERE (code * 3 + i) % 13 <> 0"


def _price_files(spark: SparkSession, sf: str) -> tuple[str, list[str]]:
    """Price files by day, some securities of a day left out and some without a close; all days."""
    folder = files.shared_folder(spark)
    bars = files.stored(_bars(spark, sf).withColumn("day", _day(F.col("i"))))
    kept = bars.where((F.col("code") * 3 + F.col("i")) % 13 != 0)
    close = F.when((F.col("code") * 3 + F.col("i")) % 29 != 0, F.col("c"))
    rows = kept.select("day", F.col("code").cast("string").alias("ts_code"), F.col("day").alias("trade_date"), F.col("o").alias("open"), F.col("h").alias("high"), F.col("l").alias("low"), close.alias("close"), F.col("volume").alias("vol"), X.rounded(1 + F.col("i") % 5 / 10.0, 1).alias("adj_factor"))
    stray = kept.where("code % 10 = 3").select("day", F.col("code").cast("string").alias("ts_code"), F.lit("19700101").alias("trade_date"), *(F.lit(1.0).alias(c) for c in ("open", "high", "low", "close", "vol", "adj_factor")))
    rows.unionByName(stray).write.partitionBy("day").option("header", True).csv(folder)
    return folder, sorted(r["day"] for r in bars.select("day").distinct().collect())  # a row a session


@query(f"SELECT {_DAY} AS day, CAST(code AS VARCHAR) AS code, {R('c * f')} AS close, o, h, l, c, volume FROM ({_PRICED})")
def adjusted_prices(spark: SparkSession, sf: str) -> DataFrame:
    folder, days = _price_files(spark, sf)
    return rounded(factors.adjusted_closes(spark, folder, days, LAYOUT), close=4)


_FLOW = f"SELECT * FROM ({D.FACTS}) WHERE (code + i) % 11 <> 0 AND code % 17 <> 5"
_PRICES = f"SELECT code, i, {R('c * f')} AS close FROM ({_PRICED}) WHERE c IS NOT NULL AND code % 17 <> 6"
_MERGED = f"""SELECT coalesce(a.code, p.code) AS code, coalesce(a.i, p.i) AS i, amount, net, unknown, ratio, p.close, CASE WHEN a.code IS NULL THEN 'PRICE' WHEN p.code IS NULL THEN 'FLOW' ELSE 'BOTH' END AS evidence
 FROM ({_FLOW}) a FULL JOIN ({_PRICES}) p ON p.code = a.code AND p.i = a.i"""
_UNIVERSE = "SELECT s_suppkey + CASE WHEN s_suppkey % 10 = 7 THEN 1000000000 ELSE 0 END AS code FROM supplier"
_UNIVERSE_GRID = f"SELECT c.code, s.i, f.* EXCLUDE (code, i) FROM ({_UNIVERSE}) c CROSS JOIN (SELECT DISTINCT i FROM ({D.FACTS})) s LEFT JOIN ({_MERGED}) f ON f.code = c.code AND f.i = s.i"


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    """Flow facts and adjusted closes of files, each with gaps of its own."""
    folder, days = _price_files(spark, sf)
    month = F.col("day").cast("long")
    i = (F.floor(month / 10000) * 12 + F.floor(month / 100) % 100).cast("long")
    prices = factors.adjusted_closes(spark, folder, days, LAYOUT).select(F.col("code").cast("long").alias("code"), i.alias("i"), X.rounded("close").alias("close")).where("code % 17 <> 6")
    flow = D.facts(spark, sf).where("(code + i) % 11 <> 0 AND code % 17 <> 5")
    return files.stored(state.merged(flow, prices))


@query(f"WITH base AS ({states_sql(_UNIVERSE_GRID)}) SELECT b.*, coalesce(m.evidence, 'NEITHER') AS evidence FROM base b LEFT JOIN ({_MERGED}) m ON m.code = b.code AND m.i = b.i")
def merged_states(spark: SparkSession, sf: str) -> DataFrame:
    """States of a universe over flow facts and prices that are each incomplete: codes with both, one or neither of them."""
    facts = _merged(spark, sf)
    universe = D.table(spark, sf, "supplier").select((F.col("s_suppkey") + F.when(F.col("s_suppkey") % 10 == 7, 1000000000).otherwise(0)).alias("code"))
    dense = state.universe_panel(universe, D.facts(spark, sf).select("i"), facts)
    told = state.states(dense, 5).join(facts.select("code", "i", "evidence"), ["code", "i"], "left")
    return told.withColumn("evidence", F.coalesce("evidence", F.lit("NEITHER")))


#: The bundle's last day at most; it is no trading day, so the last one before it counts.
TARGET = "19980115"
_CANDLE = f"""SELECT CAST(code AS VARCHAR) AS code, {_DAY} AS d, o, CASE WHEN (code + i) % 17 = 0 OR code % 33 = 0 THEN l - 1 ELSE h END AS h, l, c, CASE WHEN (code + i) % 7 = 0 THEN -1.0 ELSE volume END AS volume, CASE WHEN code % 5 <> 1 THEN volume * c / 1000 END AS amount
 FROM ({_BARS}) WHERE (code + i) % 5 <> 0"""


@query(f"""WITH x AS ({_CANDLE}), days AS (SELECT DISTINCT {_DAY} AS d FROM ({D.DEALS})), p AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS position FROM (SELECT d FROM days WHERE d <= '{TARGET}' ORDER BY d DESC LIMIT 60)),
k AS (SELECT x.*, position, coalesce(least(o, h, l, c) > 0 AND l <= least(o, c) AND h >= greatest(o, c), false) AS good FROM x JOIN p USING (d)),
r AS (SELECT *, count(*) FILTER (NOT good) OVER w AS rejected, count(*) OVER w AS n, row_number() OVER (PARTITION BY code ORDER BY position) AS place FROM k WINDOW w AS (PARTITION BY code))
SELECT code, CASE WHEN good THEN CAST(position AS BIGINT) END AS position, CASE WHEN good THEN d END AS trade_date, CASE WHEN good THEN {R("o")} END AS o, CASE WHEN good THEN {R("h")} END AS h, CASE WHEN good THEN {R("l")} END AS l, CASE WHEN good THEN {R("c")} END AS c,
 CASE WHEN good AND volume >= 0 THEN volume END AS volume, CASE WHEN good AND amount >= 0 THEN {R("amount * 1000", 2)} END AS amount, rejected FROM r WHERE good OR (rejected = n AND place = 1)""")
def candle_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """Candles of the last 60 sessions up to TARGET from price files by day: gaps, bad bars, rows that stand twice."""
    folder = files.shared_folder(spark)
    bars = files.stored(_bars(spark, sf).withColumn("day", _day(F.col("i"))))
    high = F.when(((F.col("code") + F.col("i")) % 17 == 0) | (F.col("code") % 33 == 0), F.col("l") - 1).otherwise(F.col("h"))
    rows = bars.where((F.col("code") + F.col("i")) % 5 != 0).select(
        "day", F.col("code").cast("string").alias("ts_code"), F.col("day").alias("trade_date"), F.col("o").alias("open_qfq"), high.alias("high_qfq"), F.col("l").alias("low_qfq"), F.col("c").alias("close_qfq"),
        F.when((F.col("code") + F.col("i")) % 7 == 0, -1.0).otherwise(F.col("volume")).alias("vol"), F.when(F.col("code") % 5 != 1, F.col("volume") * F.col("c") / 1000).alias("amount"),
    )
    rows.unionByName(rows.where("ts_code % 4 = 0")).write.partitionBy("day").option("header", True).csv(f"{folder}/factors")
    bars.select("day", "code").write.partitionBy("day").option("header", True).csv(f"{folder}/daily")
    held = files.listed(spark, f"{folder}/factors", LAYOUT)
    dates = spark.createDataFrame([(d,) for d in files.listed(spark, f"{folder}/daily", LAYOUT)], "trade_date string")
    got = factors.candles(factors.factor_rows(spark, f"{folder}/factors", LAYOUT, sorted(held), "trade_date"), dates, TARGET, 60)
    return rounded(got.withColumn("position", F.col("position").cast("long")), o=4, h=4, l=4, c=4, amount=2)
