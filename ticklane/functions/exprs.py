"""Column expressions of the flow vocabulary. Unknown never becomes zero: an expression over incomplete input is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of the traded universe, and boards by the code's first three digits.
UNIVERSE = r"^(000|001|002|003|300|301|302|600|601|603|605|688|689)[0-9]{3}\.(SZ|SH)$"
BOARDS = {"GEM": ("300", "301", "302"), "STAR": ("688", "689")}
INFINITY = float("inf")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c) -> Column:
    """NaN and infinities are not; NaN > x is true in Spark, so the upper bound is needed. Null is null."""
    return ~F.isnan(col(c)) & (F.abs(col(c)) < F.lit(INFINITY))


def traded(price, qty) -> Column:
    return finite(price) & (col(price) > 0) & finite(qty) & (col(qty) > 0)


def not_cancelled(side) -> Column:
    """Cancellations are out; a null side stays in."""
    return F.coalesce(col(side), F.lit("")) != "C"


def known_net(amount="amount", side="side") -> Column:
    return F.sum(F.when(col(side) == "B", col(amount)).when(col(side) == "S", -col(amount)).otherwise(F.lit(0.0)))


def unknown_amount(amount="amount", side="side") -> Column:
    return F.sum(F.when(col(side).isin("B", "S"), F.lit(0.0)).otherwise(col(amount)))


def complete_net(net, unknown) -> Column:
    return F.when(col(unknown) == 0, col(net))


def rounded(c, digits: int = 4) -> Column:
    """Half up on the binary value, the same in any engine with IEEE doubles; NaN and infinity give null."""
    scale = float(10**digits)
    return F.when(finite(c), F.floor(col(c) * scale + 0.5) / scale)


def ratio(a, b) -> Column:
    return col(a) / F.nullif(col(b), F.lit(0.0))


def ieee_ratio(a, b) -> Column:
    """a / b of doubles as IEEE has it: over 0 an infinity of a's sign, and NaN for 0 over 0. Null stays."""
    return F.when(col(b) == 0, col(a) * F.lit(INFINITY)).otherwise(col(a) / col(b))


def percent_return(now, then) -> Column:
    return F.when((col(then) > 0) & (col(now) > 0), 100 * (col(now) / col(then) - 1))


def label(ret="ret", net="net") -> Column:
    """First rule that holds: unknown, up with inflow, held by inflow, passive, up with outflow, other."""
    r, n = col(ret), col(net)
    return (
        F.when(r.isNull() | n.isNull(), "unknown").when((r > 0) & (n > 0), "push").when(r.between(-3, 0) & (n > 0), "support")
        .when(r.between(-1, 3) & (n < 0), "passive").when((r > 0) & (n < 0), "diverge").otherwise("other")
    )


def size_bucket(amount, bounds=(50_000, 200_000, 1_000_000)) -> Column:
    a, (small, mid, large) = F.abs(col(amount)), bounds
    return F.when(a < small, "small").when(a < mid, "medium").when(a < large, "large").otherwise("huge")


def clock_valid(t) -> Column:
    """HHMMSSmmm as a number."""
    return F.expr(f"{t} >= 0 AND {t} div 10000000 < 24 AND {t} div 100000 % 100 < 60 AND {t} div 1000 % 100 < 60")


def ms_of_day(t: str) -> Column:
    value = F.expr(f"(({t} div 10000000 * 60 + {t} div 100000 % 100) * 60 + {t} div 1000 % 100) * 1000 + {t} % 1000")
    return F.when(clock_valid(t), value)


def clock_label(t: str) -> Column:
    digits = F.lpad(F.col(t).cast("string"), 9, "0")
    return F.concat_ws(":", F.substring(digits, 1, 2), F.substring(digits, 3, 2), F.concat(F.substring(digits, 5, 2), F.lit("."), F.substring(digits, 7, 3)))


def regular_session(t) -> Column:
    return col(t).between(93000000, 113000000) | col(t).between(130000000, 150000000)


def segment(t) -> Column:
    """Five stretches of the session; the ones before a break include their end."""
    t = col(t)
    return (
        F.when((t >= 93000000) & (t < 100000000), 1).when((t >= 100000000) & (t < 103000000), 2).when((t >= 103000000) & (t <= 113000000), 3)
        .when((t >= 130000000) & (t < 140000000), 4).when((t >= 140000000) & (t <= 150000000), 5)
    )


def board(code) -> Column:
    first = F.substring(col(code), 1, 3)
    return F.when(first.isin(*BOARDS["GEM"]), "GEM").when(first.isin(*BOARDS["STAR"]), "STAR").otherwise("MAIN")


def usable_event(amount="amount", net="net", unknown="unknown") -> Column:
    return F.coalesce(finite(amount) & finite(net) & (col(amount) > 0) & (col(unknown) == 0), F.lit(False))


def usable_state(ratio_="ratio", unknown="unknown") -> Column:
    return F.coalesce(col(ratio_).isNotNull() & (col(unknown) == 0), F.lit(False))


def usable_view(ratio_="ratio", amount="amount", unknown="unknown") -> Column:
    return F.coalesce(finite(ratio_) & finite(amount) & (col(amount) > 0), F.lit(False)) & ~F.coalesce(finite(unknown) & (col(unknown) > 0), F.lit(False))


def event_kind(previous, now) -> Column:
    """Strict crossings and moves of a negative ratio; zero never crosses."""
    p, c = col(previous), col(now)
    return (
        F.when((p < 0) & (c > 0), "SELL_TO_BUY").when((p > 0) & (c < 0), "BUY_TO_SELL")
        .when((p < 0) & (c < 0) & (c > p), "SELL_EASING").when((p < 0) & (c < 0) & (c < p), "SELL_WORSENING")
    )


def lifecycle_step(kind, before, now, usable) -> Column:
    """What a later row does to an event: before and now are ratios of neighbouring sessions."""
    k, p, c = col(kind), col(before), col(now)
    return (
        F.when(~col(usable), "UNKNOWN")
        .when((k == "SELL_EASING") & (c >= 0), "RESOLVED").when((k == "SELL_EASING") & (c <= p), "INVALIDATED")
        .when((k == "SELL_WORSENING") & (c >= 0), "RESOLVED").when((k == "SELL_WORSENING") & (c >= p), "INVALIDATED")
        .when((k == "SELL_TO_BUY") & (c <= 0), "INVALIDATED").when((k == "BUY_TO_SELL") & (c >= 0), "INVALIDATED")
        .otherwise("ACTIVE")
    )


def entry_gate(o, h, l, c, volume, present) -> Column:  # noqa: E741
    """Whether a next session's open may serve as a price reference."""
    o, h, l, c = map(col, (o, h, l, c))  # noqa: E741
    priced = finite(o) & finite(h) & finite(l) & finite(c) & (F.least(o, h, l, c) > 0)
    return (
        F.when(~col(present), "MISSING_BAR").when(~F.coalesce(priced, F.lit(False)), "MISSING_PRICE")
        .when((l > F.least(o, c)) | (h < F.greatest(o, c)), "INVALID_OHLC").when(~F.coalesce(finite(volume), F.lit(False)), "UNKNOWN_VOLUME")
        .when(col(volume) <= 0, "NO_VOLUME").when(h == l, "ONE_PRICE_SESSION").otherwise("PRICE_REFERENCE_ONLY")
    )


def cohort(i, split: int, longest: int) -> Column:
    return F.when(col(i) + longest <= split, "TRAIN").when(col(i) <= split, "EMBARGO").otherwise("OUT_OF_SAMPLE")


def imbalance(bid, ask) -> Column:
    return 100 * (col(bid) - col(ask)) / F.nullif(col(bid) + col(ask), F.lit(0.0))


def spread_bps(bid, ask) -> Column:
    return F.when((col(bid) > 0) & (col(ask) >= col(bid)), 20000 * (col(ask) - col(bid)) / (col(ask) + col(bid)))


def microprice_bps(bid, ask, bid_qty, ask_qty) -> Column:
    b, a, p, q = map(col, (bid, ask, bid_qty, ask_qty))
    return F.when((b > 0) & (a >= b) & (p >= 0) & (q >= 0) & (p + q > 0), 10000 * (a - b) * (p - q) / ((a + b) * (p + q)))


def ladder_imbalance(bid_px, ask_px, bid_qty, ask_qty, weighted: bool = False) -> Column:
    """Imbalance over all levels of a strictly monotone ladder (array columns, best first); with ``weighted`` each level
    counts 1 / (1 + distance / scale), scale being the spread, or the nearest step in a locked book."""
    bp, ap, bq, aq = map(col, (bid_px, ask_px, bid_qty, ask_qty))
    n = F.size(bp)
    steps = lambda x, down: F.forall(F.sequence(F.lit(2), n), lambda i: (F.get(x, i - 2) > F.get(x, i - 1)) if down else (F.get(x, i - 2) < F.get(x, i - 1)))
    positive = lambda x: F.forall(x, lambda v: F.coalesce(v > 0, F.lit(False)))
    counted = lambda x: (F.size(x) == n) & F.forall(x, lambda v: F.coalesce(v >= 0, F.lit(False)))
    valid = (n > 1) & (F.size(ap) == n) & positive(bp) & positive(ap) & counted(bq) & counted(aq) & steps(bp, True) & steps(ap, False) & (F.get(ap, F.lit(0)) >= F.get(bp, F.lit(0)))
    best_b, best_a = F.get(bp, F.lit(0)), F.get(ap, F.lit(0))
    scale = F.when(best_a > best_b, best_a - best_b).otherwise(F.least(best_b - F.get(bp, F.lit(1)), F.get(ap, F.lit(1)) - best_a))
    weigh = (lambda best: lambda p, q: q / (1 + F.abs(p - best) / scale)) if weighted else (lambda best: lambda p, q: q.cast("double"))
    total = lambda p, q, best: F.aggregate(F.zip_with(p, q, weigh(best)), F.lit(0.0), lambda acc, x: acc + x)
    bids, asks = total(bp, bq, best_b), total(ap, aq, best_a)
    return F.when(valid & (bids + asks > 0), 100 * (bids - asks) / (bids + asks))


def content_id(record) -> Column:
    """sha256 of a record's JSON: a struct's fields in their order, without spaces, nulls as null."""
    return F.sha2(F.to_json(col(record), {"ignoreNullFields": "false"}), 256)


def event_id(*parts: str) -> Column:
    """The first 20 hex digits of the sha256 of the parts as a JSON list of texts; null if one is null."""
    texts = F.array(*(F.col(p).cast("string") for p in parts))
    return F.when(F.forall(texts, lambda x: x.isNotNull()), F.substring(F.sha2(F.to_json(texts), 256), 1, 20))
