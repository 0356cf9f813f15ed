"""Raw files as typed rows. Names of columns are those of the files; equalities on raw columns reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticklane.functions import exprs as X

#: Column names of the native trade files.
TRADE_COLUMNS = {"code": "万得代码", "trade_day": "自然日", "t": "时间", "trade_id": "成交编号", "price": "成交价格", "qty": "成交数量", "side": "BS标志", "bid_id": "叫买序号", "ask_id": "叫卖序号"}


def whole(c: Column) -> Column:
    """A number from text; a fraction rounds half away from zero, anything else is null."""
    return F.round(c.cast("string").try_cast("double"), 0).cast("long")


def native_trades(spark: SparkSession, path: str, day: str, codes: list[str] | None = None) -> DataFrame:
    """Trades of one day: universe, day, positive finite price and quantity, no cancellations (a null side stays)."""
    raw = spark.read.parquet(path)
    get = lambda name: F.col(f"`{TRADE_COLUMNS[name]}`")
    raw = raw.where((get("trade_day").cast("string") == day) & get("code").rlike(X.UNIVERSE))
    if codes is not None:
        raw = raw.where(get("code").isin(codes))
    typed = raw.select(
        get("code").alias("code"), get("trade_day").cast("string").alias("trade_day"), whole(get("t")).alias("t"), (get("price").cast("string").try_cast("double") / 10000).alias("price"),
        get("qty").cast("string").try_cast("double").alias("qty"), get("side").alias("side"), whole(get("bid_id")).alias("bid_id"), whole(get("ask_id")).alias("ask_id"),
    )
    pid = F.when(F.col("side") == "B", F.col("bid_id")).when(F.col("side") == "S", F.col("ask_id"))
    return typed.where(X.traded("price", "qty") & X.not_cancelled("side")).withColumn("pid", pid).withColumn("amount", F.col("price") * F.col("qty"))


def legacy_trades(rows: DataFrame) -> DataFrame:
    """Legacy trades (SecuCode, TradingDay, DealTime, Price in hundredths, Volume, Side, BuyID, SellID) in the same shape; the
    side counts only where the later order's id is the greater one."""
    n = lambda c: whole(F.col(c))
    side = F.when((n("Side") == 0) & (n("SellID") > 0) & (n("BuyID") > n("SellID")), "B").when((n("Side") == 1) & (n("BuyID") > 0) & (n("SellID") > n("BuyID")), "S").when(n("Side") < 0, "C").otherwise("?")
    code = F.concat(F.lpad(n("SecuCode").cast("string"), 6, "0"), F.when(n("SecuCode") >= 600000, ".SH").otherwise(".SZ"))
    typed = rows.select(code.alias("code"), F.col("TradingDay").cast("string").alias("trade_day"), (F.col("Price").cast("double") / 100).alias("price"), F.col("Volume").cast("double").alias("qty"), side.alias("side"), F.when(side == "B", n("BuyID")).when(side == "S", n("SellID")).alias("pid"))
    return typed.where(X.traded("price", "qty") & X.not_cancelled("side")).withColumn("amount", F.col("price") * F.col("qty"))


def open_days(rows: DataFrame) -> DataFrame:
    """Open days of one exchange's calendar (cal_date, is_open), numbered from 0. Raises on repeated days, on natural days
    left out and on marks other than 0 and 1."""
    days = rows.select(F.to_date(F.col("cal_date").cast("string"), "yyyyMMdd").alias("day"), F.col("is_open").cast("int").alias("is_open"))
    n, distinct, span, bad = days.agg(F.count("*"), F.countDistinct("day"), F.datediff(F.max("day"), F.min("day")) + 1, F.count_if(~F.coalesce(F.col("is_open").isin(0, 1), F.lit(False)))).first()
    if n != distinct or (n and n != span) or bad:
        raise ValueError(f"calendar: {n} rows, {distinct} days, {span} days from first to last, {bad} bad marks")
    return numbered_days(days.where("is_open = 1").select("day"))


def numbered_days(days: DataFrame) -> DataFrame:
    """Distinct days numbered from 0; days of a market are some hundreds a year, so one task may order them."""
    return days.distinct().withColumn("i", F.row_number().over(Window.orderBy("day")) - 1)


def window_days(calendar: DataFrame, day: str, length: int) -> list:
    """The last ``length`` open days up to an open day."""
    row = calendar.where(F.col("day") == F.lit(day).cast("date")).first()
    if row is None or row["i"] + 1 < length:
        raise ValueError(f"no window of {length} open days ends on {day}")
    return [r["day"] for r in calendar.where(F.col("i").between(row["i"] - length + 1, row["i"])).orderBy("i").collect()]


def limit_list(rows: DataFrame) -> DataFrame:
    """Rows (ts_code, name, close, limit) at the upper limit with the first reason to leave them out (null: eligible). Names
    are trimmed and upper-cased before they are looked at; a code that stands there twice raises."""
    upper = rows.where(F.col("limit") == "U")
    twice = upper.groupBy("ts_code").count().where("count > 1").first()
    if twice is not None:
        raise ValueError(f"limit list: {twice['ts_code']} stands there {twice['count']} times")
    name = F.upper(F.trim(F.coalesce("name", F.lit(""))))
    inside = F.coalesce(F.col("ts_code").rlike(X.UNIVERSE), F.lit(False))
    priced = F.coalesce(X.finite(F.col("close").cast("double")) & (F.col("close").cast("double") > 0), F.lit(False))
    reason = F.when(~inside, "outside").when(name == "", "no name").when(name.rlike(r"^(?:S\*?ST|\*?ST)"), "special").when(~priced, "bad close")
    return upper.withColumn("reason", reason)


def one_value(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, value and status: a key with several rows is DUPLICATE and has no value, a value not above 0 is INVALID."""
    sums = rows.groupBy(key).agg(F.count("*").alias("n"), F.first(value).try_cast("double").alias("v"))
    good = F.coalesce(X.finite("v") & (F.col("v") > 0), F.lit(False))
    return sums.select(key, F.when((F.col("n") == 1) & good, F.col("v")).alias(value), F.when(F.col("n") > 1, "DUPLICATE").when(good, "AVAILABLE").otherwise("INVALID").alias("status"))


def benchmark_return(rows: DataFrame, days: list[str]) -> tuple[float | None, str]:
    """Percent from the first to the last of ``days`` (trade_date, close), and a status; every day must have one close."""
    wanted = rows.where(F.col("trade_date").cast("string").isin(days)).groupBy(F.col("trade_date").cast("string").alias("d")).agg(F.count("*").alias("n"), F.first(F.col("close").try_cast("double")).alias("v"))
    found = {r["d"]: (r["n"], r["v"]) for r in wanted.collect()}
    if any(n > 1 for n, _ in found.values()):
        return None, "DUPLICATE_DATE"
    if set(found) != set(days):
        return None, "INCOMPLETE_WINDOW"
    if any(v is None or not v > 0 for _, v in found.values()):
        return None, "INCOMPLETE_PRICES"
    return 100 * (found[days[-1]][1] / found[days[0]][1] - 1), "AVAILABLE"


def fingerprint(df: DataFrame) -> str:
    """sha256 over path, size and time of the files behind a DataFrame: recheck it after a job to know its input stood."""
    m = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    text = F.concat_ws("|", "file_path", F.col("file_size").cast("string"), F.col("file_modification_time").cast("string"))
    return m.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(text)), "\n"), 256)).first()[0]
