"""Queries of the studies: references at the next session's open, paths of closes, contrasts, strata; screens and look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklane.functions import exprs as X
from ticklane.plans import contrasts, flow, screens, state
from ticklane.queries import _CELLS, EVENTS, LABELLED, _cells
from ticklane.registry import R, query, rounded
from ticklane.sources import domain as D

HORIZONS = [1, 2, 5]
_HORIZONS = "(SELECT unnest([1, 2, 5]) AS horizon)"
_BARS = f"""SELECT code, i, arg_min(price, (pid, trade_id, price)) AS o, max(price) AS h, min(price) AS l, arg_max(price, (pid, trade_id, price)) AS c, CASE WHEN code % 9 <> 4 THEN sum(qty) END AS volume
 FROM ({D.DEALS}) WHERE price > 0 AND qty > 0 AND side <> 'C' GROUP BY code, i"""


def _bars(spark: SparkSession, sf: str) -> DataFrame:
    kept, at = D.deals(spark, sf).where(X.traded("price", "qty") & X.not_cancelled("side")), F.struct("pid", "trade_id", "price")
    return kept.groupBy("code", "i").agg(F.min_by("price", at).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", at).alias("c"), F.when(F.col("code") % 9 != 4, F.sum("qty")).alias("volume"))


_REFERENCES = f"""WITH e AS ({EVENTS}), f AS ({D.FACTS}), b AS ({_BARS}), m AS (SELECT max(i) AS m FROM f),
g AS (SELECT e.code, e.i, kind, f.close AS now, CASE WHEN b.code IS NULL THEN 'MISSING_BAR' WHEN NOT coalesce(least(o, h, l, c) > 0, false) THEN 'MISSING_PRICE' WHEN l > least(o, c) OR h < greatest(o, c) THEN 'INVALID_OHLC' WHEN volume IS NULL THEN 'UNKNOWN_VOLUME'
  WHEN volume <= 0 THEN 'NO_VOLUME' WHEN h = l THEN 'ONE_PRICE_SESSION' ELSE 'PRICE_REFERENCE_ONLY' END AS gate, o * n.close / c AS adjusted
 FROM e LEFT JOIN f USING (code, i) LEFT JOIN b ON b.code = e.code AND b.i = e.i + 1 LEFT JOIN (SELECT code, i, close FROM f) n ON n.code = e.code AND n.i = e.i + 1),
x AS (SELECT g.kind, horizon, g.i + horizon <= m AS mature, gate, now, CASE WHEN gate IN ('ONE_PRICE_SESSION', 'PRICE_REFERENCE_ONLY') THEN adjusted END AS reference, t.close AS later FROM g CROSS JOIN {_HORIZONS} CROSS JOIN m LEFT JOIN (SELECT code, i, close FROM f) t ON t.code = g.code AND t.i = g.i + horizon),
y AS (SELECT *, CASE WHEN mature THEN 100 * (later / now - 1) END AS outcome, CASE WHEN mature THEN 100 * (reference / now - 1) END AS gap FROM x),
z AS (SELECT *, CASE WHEN horizon >= 2 AND outcome IS NOT NULL THEN 100 * (later / reference - 1) END AS after FROM y)"""


@query(f"""{_REFERENCES} SELECT kind, horizon, count(*) AS events, count(*) FILTER (NOT mature) AS pending, count(*) FILTER (mature AND outcome IS NULL) AS missing_price, count(outcome) AS observed, count(gap) AS open_observed, {R("avg(gap)")} AS mean_gap,
 count(after) AS after_observed, {R("avg(outcome) FILTER (after IS NOT NULL)")} AS mean_to_target, {R("avg(after)")} AS mean_after_open, (SELECT string_agg(gate || ':' || n, ',' ORDER BY gate) FROM (SELECT kind AS k, horizon AS h, gate, count(*) AS n FROM z WHERE mature GROUP BY ALL) WHERE k = kind AND h = horizon) AS gates
 FROM z GROUP BY kind, horizon""")
def open_references(spark: SparkSession, sf: str) -> DataFrame:
    facts = D.facts(spark, sf)
    rows = contrasts.open_references(state.flow_events(facts).select("code", "i", "kind"), _bars(spark, sf), facts, HORIZONS)
    text = F.array_join(F.transform(F.map_entries("gates"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return rounded(rows.withColumn("gates", text), mean_gap=4, mean_to_target=4, mean_after_open=4)


@query(f"""WITH e AS ({EVENTS}), f AS ({D.FACTS}), s AS (SELECT e.code, e.i, kind, horizon, k, f.close AS v FROM e CROSS JOIN {_HORIZONS} CROSS JOIN (SELECT unnest(range(6)) AS k) LEFT JOIN f ON f.code = e.code AND f.i = e.i + k WHERE k <= horizon),
p AS (SELECT *, max(v) OVER (PARTITION BY code, i, kind, horizon ORDER BY k) AS top FROM s), d AS (SELECT *, 100 * (v / top - 1) AS fall FROM p),
g AS (SELECT code, i, kind, horizon, CASE WHEN count(v) = count(*) THEN min(fall) END AS dd FROM d GROUP BY ALL), t AS (SELECT g.*, (SELECT min(i + k) FROM d WHERE d.code = g.code AND d.i = g.i AND d.kind = g.kind AND d.horizon = g.horizon AND d.fall = g.dd AND g.dd < 0) AS trough_i FROM g),
b AS (SELECT d.code, d.i, d.kind, d.horizon, top FROM d JOIN t ON t.code = d.code AND t.i = d.i AND t.kind = d.kind AND t.horizon = d.horizon AND d.i + k = trough_i),
h AS (SELECT d.code, d.i, d.kind, d.horizon, min(d.i + k) AS peak_i FROM d JOIN b ON b.code = d.code AND b.i = d.i AND b.kind = d.kind AND b.horizon = d.horizon AND d.v = b.top GROUP BY ALL)
SELECT code, i, kind, horizon, {R("dd")} AS drawdown, peak_i, trough_i FROM t LEFT JOIN h USING (code, i, kind, horizon)""")
def close_paths(spark: SparkSession, sf: str) -> DataFrame:
    facts = D.facts(spark, sf)
    return rounded(contrasts.close_paths(state.flow_events(facts), facts, HORIZONS), drawdown=4)


@query(_CELLS + f""", d AS (SELECT market, i, avg(x) FILTER (stock = 'improving') - avg(x) FILTER (stock = 'weakening') AS s FROM c GROUP BY ALL)
 SELECT market, count(s) AS days, {R("avg(s)")} AS mean, CASE WHEN count(s) >= 2 THEN {R("(sum(s) - max(s)) / (count(s) - 1)")} END AS least_without_one, CASE WHEN count(s) >= 2 THEN {R("(sum(s) - min(s)) / (count(s) - 1)")} END AS most_without_one FROM d WHERE s IS NOT NULL GROUP BY market""")
def day_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(contrasts.day_pairs(_cells(spark, sf)), mean=4, least_without_one=4, most_without_one=4)


@query(_CELLS + f""", p AS (SELECT market, i, board, count(x) FILTER (stock = 'improving') AS a, count(x) FILTER (stock = 'weakening') AS b, avg(x) FILTER (stock = 'improving') - avg(x) FILTER (stock = 'weakening') AS s,
  median(x) FILTER (stock = 'improving') - median(x) FILTER (stock = 'weakening') AS ms FROM c GROUP BY ALL),
 q AS (SELECT * FROM p WHERE s IS NOT NULL UNION ALL SELECT * REPLACE ('ALL' AS board) FROM p WHERE s IS NOT NULL),
 d AS (SELECT market, board, i, count(*) AS n, sum(a) AS a, sum(b) AS b, avg(s) AS s, avg(ms) AS ms, avg(s) FILTER (a >= 3 AND b >= 3) AS s3 FROM q GROUP BY ALL)
 SELECT market, board, CAST(sum(n) AS BIGINT) AS board_days, CAST(sum(a) AS BIGINT) AS improving, CAST(sum(b) AS BIGINT) AS weakening, {R("median(s)")} AS median_day, {R("avg(ms)")} AS mean_median_spread, count(s3) AS three_days, {R("avg(s3)")} AS three_spread,
 count(*) AS days, {R("avg(s)")} AS mean, CASE WHEN count(*) >= 2 THEN {R("(sum(s) - max(s)) / (count(*) - 1)")} END AS least_without_one, CASE WHEN count(*) >= 2 THEN {R("(sum(s) - min(s)) / (count(*) - 1)")} END AS most_without_one FROM d GROUP BY ALL""")
def board_contrasts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(contrasts.board_contrasts(_cells(spark, sf)), median_day=4, mean_median_spread=4, three_spread=4, mean=4, least_without_one=4, most_without_one=4)


_SOURCE = "CASE i % 5 WHEN 0 THEN 'LEGACY' WHEN 3 THEN NULL ELSE 'NATIVE' END"


@query(f"""WITH l AS ({LABELLED}), d AS (SELECT i, count(ret) AS observed, avg(ret) AS excess FROM l WHERE label = 'push' OR net IS NULL GROUP BY i), s AS (SELECT DISTINCT i, {_SOURCE} AS source FROM l)
SELECT coalesce(p.source, 'unknown') || ' > ' || coalesce(s.source, 'unknown') AS pair, count(*) AS trigger_days, count(excess) AS comparable_days, CAST(coalesce(sum(observed) FILTER (excess IS NOT NULL), 0) AS BIGINT) AS comparable_events, {R("avg(excess)")} AS mean_excess
FROM d LEFT JOIN s USING (i) LEFT JOIN (SELECT i + 1 AS i, source FROM s) p USING (i) GROUP BY 1""")
def source_strata(spark: SparkSession, sf: str) -> DataFrame:
    rows = flow.labelled(D.facts(spark, sf))
    days = rows.where("label = 'push' OR net IS NULL").groupBy("i").agg(F.count("ret").alias("observed"), F.avg("ret").alias("excess"))
    sources = rows.select("i", F.expr(_SOURCE).alias("source")).distinct()
    return rounded(contrasts.source_strata(days, sources), mean_excess=4)


@query(f"""WITH l AS ({LABELLED}), p AS (SELECT code, i + 1 AS i, ratio AS was FROM ({D.FACTS})),
x AS (SELECT l.code, l.i, ret, ratio AS level, ratio - was AS delta FROM l LEFT JOIN p USING (code, i))
SELECT code, i, CASE WHEN level IS NULL OR delta IS NULL THEN 'unknown' ELSE CASE WHEN level < 0 THEN CASE WHEN delta > 0 THEN 'net selling, easing' WHEN delta < 0 THEN 'net selling, growing' ELSE 'net selling, unchanged' END
 WHEN level > 0 THEN CASE WHEN delta < 0 THEN 'net buying, fading' WHEN delta > 0 THEN 'net buying, growing' ELSE 'net buying, unchanged' END ELSE 'balanced' END
 || CASE WHEN ret > 0 AND level < 0 THEN '; price rose' WHEN ret < 0 AND level > 0 THEN '; price fell' ELSE '' END END AS text, CASE WHEN ret > 0 THEN 'up' WHEN ret < 0 THEN 'down' WHEN ret = 0 THEN 'flat' ELSE 'unknown' END AS price FROM x""")
def narratives(spark: SparkSession, sf: str) -> DataFrame:
    rows = flow.labelled(D.facts(spark, sf))
    was = rows.select("code", (F.col("i") + 1).alias("i"), F.col("ratio").alias("was"))
    rows = rows.join(was, ["code", "i"], "left").withColumn("delta", F.col("ratio") - F.col("was"))
    return rows.select("code", "i", screens.narrative(F.col("ratio"), F.col("delta"), F.col("ret")).alias("text"), screens.quote_of(F.col("ret")).alias("price"))


@query(f"""WITH l AS ({LABELLED}), m AS (SELECT max(i) - 12 AS m FROM l), s AS (SELECT l.code, CASE WHEN l.ratio > p.ratio THEN 'improve' WHEN l.ratio < p.ratio THEN 'worsen' END AS change FROM l JOIN l p ON p.code = l.code AND p.i = l.i - 1, m WHERE l.i = m)
SELECT l.code, s_name AS name, label, ret, change FROM l JOIN supplier ON s_suppkey = code LEFT JOIN s USING (code), m WHERE i = m AND ret > 0 AND contains(lower(s_name), 'supplier#0000000') AND change = 'improve'""")
def candidate_search(spark: SparkSession, sf: str) -> DataFrame:
    rows = flow.labelled(D.facts(spark, sf))
    last = F.broadcast(rows.agg((F.max("i") - 12).alias("m")))
    day = rows.join(last, F.col("i") == F.col("m")).select("code", "label", "ret", "ratio")
    before = rows.join(last, F.col("i") == F.col("m") - 1).select("code", F.col("ratio").alias("was"))
    states = day.join(before, "code").select("code", F.when(F.col("ratio") > F.col("was"), "improve").when(F.col("ratio") < F.col("was"), "worsen").alias("change"))
    cards = day.join(D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name")), "code").select("code", "name", "label", "ret")
    return screens.candidates(cards, states, direction=1, search=" Supplier#0000000", change="improve", sort="ret")


@query("""WITH q AS (SELECT unnest(['supplier#000000003', '7', '#00000000', '0000012']) AS query), c AS (SELECT s_suppkey AS code, lower(s_name) AS a, lower(CAST(s_suppkey AS VARCHAR)) AS b FROM supplier),
g AS (SELECT query, count(DISTINCT code) FILTER (a = query OR b = query) AS n, min(code) FILTER (a = query OR b = query) AS x, count(DISTINCT code) AS m, min(code) AS y FROM q JOIN c ON contains(a, query) OR contains(b, query) GROUP BY query)
SELECT query, CASE WHEN n = 1 THEN x ELSE y END AS code FROM g WHERE n = 1 OR (n = 0 AND m = 1)""")
def code_lookup(spark: SparkSession, sf: str) -> DataFrame:
    cards = D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"))
    return screens.find_codes(cards, ["Supplier#000000003", " 7", "#00000000", "0000012"])


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) SELECT day, lag(day) OVER (ORDER BY day) AS before, lead(day) OVER (ORDER BY day) AS after FROM d""")
def neighbour_days(spark: SparkSession, sf: str) -> DataFrame:
    from ticklane.sources.readers import numbered_days

    return screens.neighbours(numbered_days(D.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"))))


@query(f"""SELECT code, i, kind, left(sha256('["' || code || '","' || kind || '","' || i || '"]'), 20) AS event_id FROM ({EVENTS})""")
def event_ids(spark: SparkSession, sf: str) -> DataFrame:
    return state.flow_events(D.facts(spark, sf)).select("code", "i", "kind", X.event_id("code", "kind", "i").alias("event_id"))
