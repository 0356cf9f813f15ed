"""Candlestick and range patterns as window frames over each security's bars, and what becomes of them.

A bar that is missing breaks the run: all frames a pattern looks at must lie in one run of neighbouring sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bars of an unbroken run that a pattern needs, its direction, and whether it is only forming.
PATTERNS = {
    "soldiers": (8, 1, False), "crows": (8, -1, False), "morning": (8, 1, False), "evening": (8, -1, False), "bull_engulf": (8, 1, False), "bear_engulf": (8, -1, False),
    "hammer": (8, 1, False), "shooting": (8, -1, False), "breakout": (21, 1, False), "breakdown": (21, -1, False), "box_support": (21, 1, True),
    "pullback": (40, 1, True), "triangle": (40, 0, True), "flag": (40, 1, True), "round": (60, 1, True), "cup": (90, 1, True),
    "retest": (21, 1, False), "failed": (21, -1, False), "double_bottom": (60, 1, True), "double_top": (60, -1, True), "head_bottom": (90, 1, True), "head_top": (90, -1, True),
}


def prepared(bars: DataFrame) -> DataFrame:
    """Bars (code, i, o, h, l, c, volume) with run length, volume ratio and the frames that the rules use; bars whose prices
    are missing or out of order count as missing."""
    good = (F.least("o", "h", "l", "c") > 0) & (F.col("l") <= F.least("o", "c")) & (F.greatest("o", "c") <= F.col("h"))
    w = Window.partitionBy("code").orderBy("i")
    rows = bars.where(F.coalesce(good, F.lit(False)))
    rows = rows.withColumn("start", F.when(F.col("i") - F.lag("i").over(w) == 1, F.lit(None)).otherwise(F.col("i")))
    rows = rows.withColumn("run", F.col("i") - F.last("start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1)
    before = w.rowsBetween(-20, -1)
    mean = F.when(F.count("volume").over(before) == 20, F.avg("volume").over(before))
    return rows.withColumn("vr", F.when(F.col("run") > 20, F.col("volume") / F.nullif(mean, F.lit(0.0)))).drop("start")


def rules() -> dict[str, tuple[Column, Column, Column | None, Column]]:
    """By pattern: condition, bars back to its start, trigger level and stop level."""
    w = Window.partitionBy("code").orderBy("i")
    o, h, l, c = (F.col(x) for x in "ohlc")  # noqa: E741
    back = lambda x, k: F.lag(x, k).over(w)
    o1, h1, l1, c1 = (back(x, 1) for x in "ohlc")
    o2, h2, l2, c2 = (back(x, 2) for x in "ohlc")
    frame = lambda a, b: w.rowsBetween(a, b)
    high, low, mean = (lambda x, a, b: F.max(x).over(frame(a, b))), (lambda x, a, b: F.min(x).over(frame(a, b))), (lambda x, a, b: F.avg(x).over(frame(a, b)))
    body, rng = F.abs(c - o), h - l
    down, up = back("c", 3) < back("c", 7), back("c", 3) > back("c", 7)
    solid = lambda x: F.abs(x[3] - x[0]) >= 0.5 * (x[1] - x[2])
    three = [(o, h, l, c), (o1, h1, l1, c1), (o2, h2, l2, c2)]
    strong = reduce(lambda a, b: a & b, (solid(x) & (x[1] > x[2]) for x in three))
    rise = reduce(lambda a, b: a & b, (x[3] > x[0] for x in three))
    fall = reduce(lambda a, b: a & b, (x[3] < x[0] for x in three))
    small = (body > 0) & (rng > 0) & (body <= 0.35 * rng)
    above, below = h - F.greatest(o, c), F.least(o, c) - l
    low3, high3 = low("l", -2, 0), high("h", -2, 0)
    hi20, lo20, vr = high("h", -20, -1), low("l", -20, -1), F.col("vr")
    box = hi20 / lo20 - 1 <= 0.15
    lows = F.collect_list("l").over(frame(-20, -1))
    touches = F.size(F.filter(lows, lambda x: x <= 1.03 * F.array_min(lows)))
    ma20 = mean("c", -19, 0)
    hi1, lo1_, hi2, lo2_ = high("h", -19, -10), low("l", -19, -10), high("h", -9, 0), low("l", -9, 0)
    none = None
    closes60, closes70 = F.collect_list("c").over(frame(-59, 0)), F.collect_list("c").over(frame(-69, 0))
    part = lambda x, a, n: F.aggregate(F.slice(x, a + 1, n), F.lit(0.0), lambda s, v: s + v) / n
    cup = F.slice(closes70, 1, 60)
    handle_low, handle_last = F.array_min(F.slice(closes70, 61, 10)), F.get(closes70, F.lit(69))

    def bowl(x: Column, least: float, rim) -> Column:
        m = [part(x, 10 * i, 10) for i in range(6)]
        at = F.array_position(x, F.array_min(x)) - 1
        depth = 1 - F.array_min(x) / rim
        return at.between(18, 42) & depth.between(least, 0.35) & (F.abs(m[0] / m[5] - 1) <= 0.05) & (m[0] > m[1]) & (m[1] > m[2]) & (m[3] < m[4]) & (m[4] < m[5])

    rim60, rim70 = F.greatest(part(closes60, 0, 10), part(closes60, 50, 10)), F.greatest(part(cup, 0, 10), part(cup, 50, 10))
    depth70 = 1 - F.array_min(cup) / rim70
    n = F.lit
    return {
        "soldiers": (strong & rise & down & (c2 < c1) & (c1 < c) & o1.between(o2, c2) & o.between(o1, c1), n(2), none, low3),
        "crows": (strong & fall & up & (c2 > c1) & (c1 > c) & o1.between(c2, o2) & o.between(c1, o1), n(2), none, high3),
        "morning": (down & (c2 < o2) & (F.abs(c1 - o1) <= 0.35 * F.abs(c2 - o2)) & (c > o) & (c > (o2 + c2) / 2) & (F.greatest(o1, c1) <= c2), n(2), none, low3),
        "evening": (up & (c2 > o2) & (F.abs(c1 - o1) <= 0.35 * F.abs(c2 - o2)) & (c < o) & (c < (o2 + c2) / 2) & (F.least(o1, c1) >= c2), n(2), none, high3),
        "bull_engulf": ((c1 < o1) & (c > o) & (o <= c1) & (c >= o1) & (body > F.abs(c1 - o1)) & down, n(1), none, F.least(l, l1)),
        "bear_engulf": ((c1 > o1) & (c < o) & (o >= c1) & (c <= o1) & (body > F.abs(c1 - o1)) & up, n(1), none, F.greatest(h, h1)),
        "hammer": (small & (below >= 2 * body) & (above <= 0.5 * body) & down, n(0), none, l),
        "shooting": (small & (above >= 2 * body) & (below <= 0.5 * body) & up, n(0), none, h),
        "breakout": (box & (c > 1.005 * hi20) & (vr >= 1.2), n(20), hi20, lo20),
        "breakdown": (box & (c < 0.995 * lo20), n(20), lo20, hi20),
        "box_support": (box & (touches >= 2) & (l <= 1.03 * lo20) & (c >= lo20) & (c > o), n(20), hi20, 0.995 * lo20),
        "pullback": ((ma20 > 1.02 * mean("c", -39, -20)) & (c > ma20) & (c < 0.97 * high("c", -9, 0)) & (vr < 1), n(39), high("c", -9, 0), low("l", -19, 0)),
        "triangle": ((hi2 < 0.99 * hi1) & (lo2_ > 1.01 * lo1_) & (hi2 - lo2_ < 0.8 * (hi1 - lo1_)), n(19), hi2, lo2_),
        "flag": ((back("c", 10) / back("c", 20) - 1 >= 0.15) & (c / back("c", 10) - 1).between(-0.1, 0) & (vr < 1), n(20), high("h", -9, 0), low("l", -9, 0)),
        "round": (bowl(closes60, 0.08, rim60), n(59), rim60, 0.995 * F.array_min(closes60)),
        "cup": (bowl(cup, 0.12, rim70) & (handle_low >= 0.9 * rim70) & (handle_low > rim70 * (1 - depth70 / 2)) & (handle_last < rim70) & (vr < 1), n(69), rim70, 0.995 * handle_low),
    }


def detect(bars: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Detections: code, i, kind, start_i, trigger, stop; one pass over the bars whatever the number of patterns."""
    found = []
    for name, (rule, back, trigger, stop) in rules().items():
        if names is None or name in names:
            hit = F.coalesce(rule, F.lit(False)) & (F.col("run") >= PATTERNS[name][0])
            found.append(F.when(hit, F.struct(F.lit(name).alias("kind"), (F.col("i") - back).alias("start_i"), (F.lit(None) if trigger is None else trigger).cast("double").alias("trigger"), stop.cast("double").alias("stop"))))
    rows = prepared(bars).withColumn("found", F.array_compact(F.array(*found)))
    return rows.select("code", "i", F.explode("found").alias("f")).select("code", "i", "f.*")


def after_breakouts(bars: DataFrame) -> DataFrame:
    """Retests and failures of breakouts in the ten sessions after them, each breakout's first; columns as of detect."""
    rows = prepared(bars).withColumn("since", F.col("i") - F.col("run"))
    broke = detect(bars, ["breakout"]).select("code", F.col("i").alias("d"), "start_i", "trigger", "stop")
    days = broke.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(10)))).withColumn("i", F.col("d") + F.col("k"))
    ahead = days.join(rows.select("code", "i", "since", "h", "l", "c", "vr"), ["code", "i"])
    upto = Window.partitionBy("code", "d").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    ahead = ahead.withColumn("unbroken", F.first("since").over(upto) == F.col("since")).withColumn("high", F.max("h").over(upto))
    ahead = ahead.withColumn("lost", F.max(F.when(F.col("k") > 0, F.col("c") < F.col("stop")).otherwise(F.lit(False))).over(upto)).where("unbroken AND k > 0")
    held = ~F.col("lost") & (F.abs(F.col("l") / F.col("trigger") - 1) <= 0.03) & (F.col("c") >= F.col("trigger")) & (F.col("vr") < 1)
    out = []
    for kind, rule, stop in (("retest", held, F.col("stop")), ("failed", F.col("c") < 0.995 * F.col("trigger"), F.col("high"))):
        first = ahead.where(rule).groupBy("code", "d").agg(F.min(F.struct("i", "start_i", "trigger", stop.alias("stop"))).alias("f"))
        out.append(first.select("code", "f.i", F.lit(kind).alias("kind"), "f.start_i", "f.trigger", "f.stop"))
    return out[0].unionByName(out[1])


def turning_points(bars: DataFrame) -> DataFrame:
    """Local extremes (code, since, side: 1 low, -1 high; i, v) that two bars on either side confirm; since names the run."""
    w = Window.partitionBy("code", "since").orderBy("i")
    rows = prepared(bars).withColumn("since", F.col("i") - F.col("run")).withColumn("last", F.max("i").over(Window.partitionBy("code", "since")))
    sides = []
    for side, x in ((1, F.col("l")), (-1, -F.col("h"))):
        turn = (x < F.least(F.lag(x, 1).over(w), F.lag(x, 2).over(w))) & (x <= F.least(F.lead(x, 1).over(w), F.lead(x, 2).over(w)))
        inner = (F.col("run") > 2) & (F.col("i") + 2 <= F.col("last"))  # least() passes over nulls
        sides.append(rows.withColumn("turn", turn).where(inner & F.col("turn")).select("code", "since", "last", F.lit(side).alias("side"), "i", F.abs(x).alias("v")))
    return sides[0].unionByName(sides[1])


def double_and_head(bars: DataFrame) -> DataFrame:
    """Double bottoms and tops from the last two turning points, head and shoulders from the last three, each at the first
    session that shows it; columns as of detect. A pair stays the last one until two bars after the next turning point."""
    w = Window.partitionBy("code", "since", "side").orderBy("i")
    points = turning_points(bars)
    points = points.withColumn("next", F.lead("i").over(w))
    for k in (1, 2):
        points = points.withColumn(f"i{k}", F.lag("i", k).over(w)).withColumn(f"v{k}", F.lag("v", k).over(w))
    bars_at = prepared(bars).select("code", F.col("i").alias("at"), "h", "l")
    found = []
    v, v1, v2, low = F.col("v"), F.col("v1"), F.col("v2"), F.col("side") == 1
    for k, names, least in ((1, ("double_bottom", "double_top"), 60), (2, ("head_bottom", "head_top"), 90)):
        start = F.col(f"i{k}")
        if k == 1:
            shape = (F.col("i") - F.col("i1")).between(5, 40) & (F.abs(v1 / v - 1) <= 0.04)
            edge = F.when(low, F.least(v1, v)).otherwise(F.greatest(v1, v))
        else:
            shape = (F.col("i") - F.col("i1")).between(5, 30) & (F.col("i1") - F.col("i2")).between(5, 30) & (F.abs(v2 / v - 1) <= 0.04)
            shape = shape & F.when(low, v1 < 0.97 * F.least(v2, v)).otherwise(v1 > 1.03 * F.greatest(v2, v))
            edge = v1
        seen = F.greatest(F.col("i") + 2, F.col("since") + least)
        until = F.least(F.col("i") + 15, F.coalesce(F.col("next") + 1, F.col("last")), F.col("last"))
        pairs = points.where(shape & (seen <= until)).select("code", "side", "i", start.alias("start_i"), seen.alias("seen"), edge.alias("edge"))
        between = pairs.withColumn("at", F.explode(F.sequence("start_i", "i"))).join(bars_at, ["code", "at"])
        necks = between.groupBy("code", "side", "i", "start_i", "seen", "edge").agg(F.max("h").alias("top"), F.min("l").alias("floor"))
        rows = necks.withColumn("trigger", F.when(low, F.col("top")).otherwise(F.col("floor")))
        if k == 1:
            rows = rows.where(F.when(low, F.col("trigger") / F.col("edge") - 1).otherwise(F.col("edge") / F.col("trigger") - 1) >= 0.05)
        stop = F.col("edge") * F.when(low, 0.995).otherwise(1.005)
        found.append(rows.select("code", F.col("seen").alias("i"), F.when(low, names[0]).otherwise(names[1]).alias("kind"), "start_i", "trigger", stop.alias("stop")))
    return found[0].unionByName(found[1])


def detections(bars: DataFrame) -> DataFrame:
    """All 22 patterns: those of window frames, of earlier breakouts and of turning points."""
    return detect(bars).unionByName(after_breakouts(bars)).unionByName(double_and_head(bars))


def followed(bars: DataFrame, horizon: int = 20) -> DataFrame:
    """Detections with their stage after at most ``horizon`` sessions: confirmed_i, invalidated_i and stage. A later gap stops
    the following (unknown)."""
    events = detections(bars)
    later = prepared(bars).select("code", F.col("i").alias("later"), F.col("c").alias("close"), F.col("vr").alias("vr_then"), "run")
    ahead = events.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(horizon)))).withColumn("later", F.col("i") + F.col("h")).join(later, ["code", "later"])
    way = reduce(lambda a, kv: a.when(F.col("kind") == kv[0], kv[1][1]), PATTERNS.items(), F.when(F.lit(False), 0))
    forming = F.col("kind").isin([k for k, v in PATTERNS.items() if v[2]])
    out = (F.col("h") > 0) & (((way > 0) & (F.col("close") < F.col("stop"))) | ((way < 0) & (F.col("close") > F.col("stop"))))
    through = forming & (F.col("vr_then") >= 1.2) & (((way > 0) & (F.col("close") > 1.005 * F.col("trigger"))) | ((way < 0) & (F.col("close") < 0.995 * F.col("trigger"))))
    whole = (F.col("h") == 0) | (F.col("run") > F.col("h"))  # no gap since the detection
    at = lambda x: F.min(F.when(whole & x, F.col("later")))
    ends = ahead.groupBy("code", "i", "kind", "start_i").agg(at(out).alias("invalidated_i"), at(through).alias("through"), F.max(F.when(whole, F.col("later"))).alias("seen"), F.max("later").alias("reach"))
    joined = events.join(ends, ["code", "i", "kind", "start_i"])
    confirmed = F.when(forming, F.when(F.col("invalidated_i").isNull() | (F.col("through") < F.col("invalidated_i")), F.col("through"))).otherwise(F.col("i"))
    rows = joined.withColumn("confirmed_i", confirmed)
    stage = F.when(F.col("invalidated_i").isNotNull(), "invalidated").when(F.col("confirmed_i").isNotNull(), "confirmed").otherwise("forming")
    unknown = F.col("invalidated_i").isNull() & (F.col("reach") > F.col("seen"))
    return rows.select("code", "i", "kind", "start_i", "confirmed_i", "invalidated_i", stage.alias("stage"), "trigger", "stop", unknown.alias("lifecycle_unknown"))


def recent(bars: DataFrame, last: int, scan: int = 60, active: int = 20) -> DataFrame:
    """Events that were detected, confirmed or invalidated in the last ``scan`` sessions up to ``last``, with whether they are
    still followed, and how far (percent) the last close is from the trigger; null where that session has no bar."""
    now = prepared(bars).where(F.col("i") == last).select("code", F.col("c").alias("close"))
    rows = followed(bars.where(F.col("i") <= last), active)
    rows = rows.where(F.greatest("i", "confirmed_i", "invalidated_i") > last - scan).join(now, "code", "left")
    is_active = (F.lit(last) - F.col("i") <= active) & ~F.col("lifecycle_unknown")
    return rows.withColumn("active", is_active).withColumn("distance", 100 * (F.col("close") / F.nullif(F.col("trigger"), F.lit(0.0)) - 1)).drop("close")
