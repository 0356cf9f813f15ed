"""Queries of the market's views at every session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklane.plans import state, views
from ticklane.registry import R, query, rounded
from ticklane.source_queries import _UNIVERSE_GRID, _merged
from ticklane.sources import domain as D
from ticklane.sources import files

N = 4


def _dense(spark: SparkSession, sf: str) -> DataFrame:
    universe = D.table(spark, sf, "supplier").select((F.col("s_suppkey") + F.when(F.col("s_suppkey") % 10 == 7, 1000000000).otherwise(0)).alias("code"))
    return files.stored(state.universe_panel(universe, D.facts(spark, sf).select("i"), _merged(spark, sf)))


# cohorts by counting, trajectories by joining each end to its sessions
_PATHS = f"""WITH g AS MATERIALIZED (SELECT *, coalesce(amount > 0 AND ratio IS NOT NULL AND net IS NOT NULL AND NOT coalesce(unknown > 0, false), false) AS u FROM ({_UNIVERSE_GRID})),
d AS (SELECT i, row_number() OVER (ORDER BY i) AS at FROM (SELECT DISTINCT i FROM g)), x AS (SELECT g.*, d.at FROM g JOIN d USING (i)),
r AS MATERIALIZED (SELECT a.*, 100 * (a.close / b.close - 1) AS ret, CASE WHEN a.u THEN a.ratio END AS now, CASE WHEN b.u THEN b.ratio END AS before FROM x a LEFT JOIN x b ON b.code = a.code AND b.at = a.at - 1),
fr AS (SELECT e.i AS "end", s.i, s.at, e.at AS e_at, least(e.at, {N}) AS length FROM d e JOIN d s ON s.at BETWEEN e.at - {N - 1} AND e.at),
co AS (SELECT f."end", r.code, count(*) FILTER (u) = {N} AS flow, count(ret) = {N} AS price FROM fr f JOIN r ON r.i = f.i GROUP BY ALL),
mk AS (SELECT i, count(*) AS total, sum(amount) FILTER (amount > 0) AS amount, count(*) FILTER (amount > 0) AS amount_coverage, count(*) FILTER (u) AS direction_coverage, count(ret) AS price_coverage FROM r GROUP BY i),
su AS (SELECT f."end", f.i, count(*) FILTER (flow) AS common, sum(r.amount) FILTER (flow) AS common_amount, sum(r.net) FILTER (flow) AS common_net, count(*) FILTER (flow AND r.ratio > 0) AS buyers, count(*) FILTER (price) AS price_common,
  count(*) FILTER (price AND ret > 0) AS up, count(*) FILTER (price AND ret < 0) AS down, count(*) FILTER (price AND ret = 0) AS level FROM fr f JOIN r ON r.i = f.i JOIN co c ON c."end" = f."end" AND c.code = r.code GROUP BY ALL),
p AS (SELECT f."end", f.i, length, total, amount, amount_coverage, direction_coverage, price_coverage, common, common_amount, common_net, 100 * common_net / nullif(common_amount, 0) AS ratio, 100.0 * buyers / nullif(common, 0) AS buy_share, price_common,
  100.0 * up / nullif(price_common, 0) AS up_share, 100.0 * down / nullif(price_common, 0) AS down_share, 100.0 * level / nullif(price_common, 0) AS level_share FROM fr f JOIN mk USING (i) JOIN su ON su."end" = f."end" AND su.i = f.i)"""
_SHARES = ["ratio", "buy_share", "up_share", "down_share", "level_share"]
_DELTAS = ["ratio", "buy_share", "up_share"]


@query(f"""{_PATHS} SELECT "end", i, length, total, {R("amount", 2)} AS amount, amount_coverage, direction_coverage, price_coverage, common, {R("common_amount", 2)} AS common_amount, {R("common_net", 2)} AS common_net, price_common, {", ".join(f"{R(c)} AS {c}" for c in _SHARES)},
 {", ".join(f'{R(f"{c} - lag({c}) OVER w")} AS {c}_delta' for c in _DELTAS)} FROM p WINDOW w AS (PARTITION BY "end" ORDER BY i)""")
def view_trajectories(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.trajectories(_dense(spark, sf), N)
    return rounded(rows, amount=2, common_amount=2, common_net=2, **dict.fromkeys([*_SHARES, *(f"{c}_delta" for c in _DELTAS)], 4)).withColumn("length", F.col("length").cast("long"))


_LAST = 'i = max(i) OVER (PARTITION BY "end")'


def _run(value: str, boundary: str) -> str:
    """Sessions at the end of the window on the last one's side."""
    return f"""SELECT p."end", any_value(CAST(sign(l.v - {boundary}) AS INT)) AS side, CAST(count(*) FILTER (p.i > coalesce(b.i, -1)) AS INT) AS days FROM p JOIN (SELECT "end", arg_max({value}, i) AS v FROM p GROUP BY "end") l ON l."end" = p."end"
  LEFT JOIN (SELECT q."end", max(q.i) AS i FROM p q JOIN (SELECT "end", last_v FROM (SELECT "end", arg_max({value}, i) AS last_v FROM p GROUP BY "end")) z ON z."end" = q."end" WHERE q.{value} IS NULL OR sign(q.{value} - {boundary}) <> sign(last_v - {boundary}) GROUP BY q."end") b ON b."end" = p."end" GROUP BY p."end\""""


@query(f"""{_PATHS}, q AS (SELECT *, row_number() OVER (PARTITION BY "end" ORDER BY i) - 1 AS k, ratio - lag(ratio) OVER w AS step FROM p WINDOW w AS (PARTITION BY "end" ORDER BY i)),
one AS ({_run("ratio", "0")}), two AS ({_run("buy_share", "50")}), fell AS (SELECT "end", max(k) AS k FROM q WHERE k > 0 AND NOT coalesce(step > 0, false) GROUP BY "end"),
s AS (SELECT "end", max(length) AS length, max(total) AS total, max(common) AS common, max(price_common) AS price_common, arg_max(ratio, i) AS lr, arg_max(buy_share, i) AS lb, arg_max(up_share, i) AS lu,
  {", ".join(f"CASE WHEN count({c}) = {N} THEN regr_slope({c}, k) END AS {c}_slope" for c in _DELTAS)}, {", ".join(f"max({c}) FILTER (k = {N - 1}) - max({c}) FILTER (k = {N - 2}) AS {c}_delta" for c in _DELTAS)}, count(ratio) AS whole FROM q GROUP BY "end"),
t AS (SELECT s.*, CASE WHEN length < {N} THEN 'INCOMPLETE_WINDOW' WHEN common = 0 THEN 'NO_COMMON_COHORT' ELSE 'AVAILABLE' END AS status, CASE WHEN length < {N} THEN 'INCOMPLETE_WINDOW' WHEN price_common = 0 THEN 'NO_COMMON_PRICE_COHORT' ELSE 'AVAILABLE' END AS price_status FROM s)
SELECT t."end", total, common, price_common, status, price_status, {", ".join(f"CASE WHEN status = 'AVAILABLE' THEN {x} END AS {name}" for name, x in {
    "latest_ratio": R("lr"), "latest_buy_share": R("lb"), "ratio_delta": R("ratio_delta"), "buy_share_delta": R("buy_share_delta"), "ratio_slope": R("ratio_slope"), "buy_share_slope": R("buy_share_slope"), "ratio_side": "one.side", "ratio_days": "one.days", "ratio_left_censored": f"one.days = {N}",
    "breadth_side": "two.side", "breadth_days": "two.days", "rises": f"CASE WHEN whole = {N} THEN CAST({N - 1} - coalesce(fell.k, 0) AS INT) END", "rises_left_censored": f"whole = {N} AND fell.k IS NULL"}.items())},
 {", ".join(f"CASE WHEN price_status = 'AVAILABLE' THEN {R(x)} END AS {name}" for name, x in {"latest_up_share": "lu", "up_share_delta": "up_share_delta", "up_share_slope": "up_share_slope"}.items())} FROM t LEFT JOIN one USING ("end") LEFT JOIN two USING ("end") LEFT JOIN fell USING ("end")""")
def market_views(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.markets(views.trajectories(_dense(spark, sf), N), N)
    return rounded(rows, **dict.fromkeys(["latest_ratio", "latest_buy_share", "latest_up_share", *(f"{c}_{x}" for c in _DELTAS for x in ("delta", "slope"))], 4))


@query(f"""{_PATHS} SELECT i, count(*) FILTER (now > before) AS improve, count(*) FILTER (now < before) AS worsen, count(*) FILTER (now = before) AS flat, count(*) FILTER (now IS NULL OR before IS NULL) AS unknown, count(*) FILTER (before < 0 AND now > 0) AS to_buy,
 count(*) FILTER (before > 0 AND now < 0) AS to_sell FROM r WHERE i > (SELECT min(i) FROM r) GROUP BY i""")
def view_changes(spark: SparkSession, sf: str) -> DataFrame:
    return views.changes(_dense(spark, sf))
