"""Data-layer transforms: sessions, resampling, calendars, gaps, splits, ticker identity, low-volume periods."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.operators.joins import asof_join, connected

#: Session -> first minute of the day and minute after the last.
SESSIONS = {"premarket": (240, 570), "regular": (570, 960), "afterhours": (960, 1200)}


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def session(ts: Column) -> Column:
    """premarket, regular, afterhours or other, by the session time zone's wall clock."""
    m = minute_of_day(ts)
    out = F.lit("other")
    for name, (low, high) in reversed(list(SESSIONS.items())):
        out = F.when((m >= low) & (m < high), name).otherwise(out)
    return out


def session_start(name: Column) -> Column:
    out = F.lit(0)
    for key, (low, _) in SESSIONS.items():
        out = F.when(name == key, low).otherwise(out)
    return out


def bar_start(ts: Column, timeframe: str) -> Column:
    """Start of the bar of a timeframe: ``5m`` and ``1h`` count from the session's start; d, w, mo, q and y from the calendar."""
    found = re.fullmatch(r"(\d+)(m|h|d|w|mo|q|y)", timeframe)
    if not found or int(found[1]) < 1:
        raise ValueError(f"unknown timeframe {timeframe!r}")
    n, unit = int(found[1]), found[2]
    if unit in ("m", "h"):
        width = n * (60 if unit == "h" else 1)
        base = session_start(session(ts))
        minutes = base + F.floor((minute_of_day(ts) - base) / F.lit(width)) * width
        return F.timestamp_seconds(F.unix_seconds(F.date_trunc("day", ts).cast("timestamp")) + minutes * 60)
    if unit == "d":
        days = F.datediff(ts, F.lit("1970-01-01").cast("date"))
        return F.date_add(F.lit("1970-01-01").cast("date"), (days - days % n).cast("int")).cast("timestamp")
    if unit == "w":
        days = F.datediff(F.date_trunc("week", ts), F.lit("1970-01-05").cast("date"))
        return F.date_add(F.lit("1970-01-05").cast("date"), (days - days % (7 * n)).cast("int")).cast("timestamp")
    months = (F.year(ts) * 12 + F.month(ts) - 1).cast("int")
    width = n * {"mo": 1, "q": 3, "y": 12}[unit]
    first = months - months % width
    return F.make_date(F.floor(first / F.lit(12)).cast("int"), first % 12 + 1, F.lit(1)).cast("timestamp")


def resample(bars: DataFrame, timeframe: str, keep_sessions: tuple[str, ...] | None = None) -> DataFrame:
    """(ticker, timestamps, open, high, low, close, volume, transactions) in wider bars that never cross sessions."""
    ts = F.col("timestamps")
    if keep_sessions:
        bars = bars.where(session(ts).isin(*keep_sessions))
    return bars.groupBy("ticker", bar_start(ts, timeframe).alias("bar")).agg(
        F.min_by("open", "timestamps").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "timestamps").alias("close"), F.sum("volume").alias("volume"), F.sum("transactions").alias("transactions"),
    ).withColumnRenamed("bar", "timestamps")


def weekday_calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    days = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return spark.range(1).select(days.alias("date")).where(F.dayofweek("date").between(2, 6))


def calendar_minutes(calendar: DataFrame, extended: bool = True) -> DataFrame:
    """Minutes of each session of a calendar (date, half_day): 04:00-20:00, on half days 04:00-13:00 and 16:00-17:00."""
    full = F.sequence(F.lit(240 if extended else 570), F.lit(1199 if extended else 959))
    half = F.concat(F.sequence(F.lit(240 if extended else 570), F.lit(779)), F.sequence(F.lit(960), F.lit(1019)) if extended else F.array().cast("array<int>"))
    minutes = calendar.select("date", F.explode(F.when(F.col("half_day"), half).otherwise(full)).alias("m"))
    return minutes.select("date", F.timestamp_seconds(F.unix_seconds(F.col("date").cast("timestamp")) + F.col("m") * 60).alias("timestamps"))


def fill_gaps(bars: DataFrame, calendar: DataFrame, at: str = "date") -> DataFrame:
    """Each ticker's bars from its first to its last calendar entry: prices carry the last close, volumes are 0."""
    spans = bars.groupBy("ticker").agg(F.min(at).alias("_a"), F.max(at).alias("_b"))
    times = F.broadcast(calendar.agg(F.sort_array(F.collect_set(at)).alias("_all")))  # one row: the calendar
    grid = spans.crossJoin(times).select("ticker", F.explode(F.filter("_all", lambda t: (t >= F.col("_a")) & (t <= F.col("_b")))).alias(at))
    full = grid.join(bars, ["ticker", at], "left")
    w = Window.partitionBy("ticker").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    close = F.last("close", ignorenulls=True).over(w)
    out = full.withColumn("_c", close)
    prices = {c: F.coalesce(c, "_c") for c in ("open", "high", "low", "close") if c in bars.columns}
    counts = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("volume", "transactions") if c in bars.columns}
    return out.withColumns(prices | counts).drop("_c").select(*bars.columns)


def split_factors(splits: DataFrame) -> DataFrame:
    """(ticker, split_date, factor): price factor for bars up to the day before each execution."""
    w = Window.partitionBy("ticker").orderBy(F.desc("execution_date")).rowsBetween(Window.unboundedPreceding, 0)
    ratio = F.col("split_from") / F.nullif(F.col("split_to").cast("double"), F.lit(0.0))
    return splits.select("ticker", F.date_sub(F.col("execution_date").cast("date"), 1).alias("split_date"), F.product(ratio).over(w).alias("factor"))


def adjust_splits(bars: DataFrame, splits: DataFrame) -> DataFrame:
    """Prices times, volumes over the factor of the next split on or after each bar; splits outside a ticker's range do not count."""
    spans = bars.groupBy("ticker").agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    day = F.col("execution_date").cast("date")
    own = splits.join(spans, "ticker").where((day >= F.date_sub("_a", 1)) & (day <= F.date_add("_b", 1))).drop("_a", "_b")
    found = asof_join(bars, split_factors(own), "ticker", "date", "split_date")
    f = F.coalesce("factor", F.lit(1.0))
    prices = {c: F.round(F.col(c) * f, 4) for c in ("open", "high", "low", "close") if c in bars.columns}
    return found.withColumns(prices | {"volume": F.round(F.col("volume") / f, 0).cast("bigint")}).select(*bars.columns)


def mapped_tickers(overview: DataFrame) -> DataFrame:
    """(ticker, group_id, tickers, latest_ticker): tickers joined by a shared composite or share-class identifier.

    ``group_id`` is the least ticker of the group; its tickers come in order of
    their last update.
    """
    latest = overview.groupBy("ticker", "type", "composite_figi", "share_class_figi", "delisted_utc", "active").agg(F.max("last_updated_utc").alias("last_updated_utc"))
    ids = latest.unpivot(["ticker"], ["composite_figi", "share_class_figi"], "kind", "figi").where("figi is not null")
    node = F.concat(F.lit("t:"), F.col("ticker"))
    label = connected(ids.select(node.alias("a"), F.concat(F.lit("~f:"), F.col("figi")).alias("b")))
    grouped = latest.join(label.select(F.expr("substring(node, 3)").alias("ticker"), F.expr("substring(component, 3)").alias("g")).where("ticker is not null"), "ticker", "left")
    grouped = grouped.withColumn("group_id", F.coalesce("g", "ticker"))
    order = F.array_sort(F.collect_set(F.struct("last_updated_utc", "ticker")))
    groups = grouped.groupBy("group_id").agg(order.alias("o")).select("group_id", F.transform("o", lambda x: x["ticker"]).alias("tickers"))
    groups = groups.withColumn("latest_ticker", F.element_at("tickers", -1))
    return grouped.select("ticker", "group_id").distinct().join(groups, "group_id").select("ticker", "group_id", "tickers", "latest_ticker")


def align_tickers(bars: DataFrame, mapped: DataFrame, ends: DataFrame) -> DataFrame:
    """Bars under the latest ticker of their group; of overlapping tickers the earlier-updated keeps its days.

    ``ends`` has (ticker, last_date): the day of the last update or delisting.
    A ticker counts after the last day of those before it.  Bars of unmapped
    tickers stay as they are.
    """
    places = mapped.select("group_id", "latest_ticker", F.posexplode("tickers").alias("place", "ticker")).distinct().join(ends, "ticker", "left")
    before = Window.partitionBy("group_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    cuts = places.withColumn("after", F.max("last_date").over(before)).select("ticker", "latest_ticker", "last_date", "after")
    joined = bars.join(cuts, "ticker", "left")
    keep = (F.col("after").isNull() | (F.col("date") > F.col("after"))) & (F.col("last_date").isNull() | (F.col("date") <= F.col("last_date")) | F.col("latest_ticker").isNull())
    out = joined.where(keep).withColumn("ticker", F.coalesce("latest_ticker", "ticker"))
    return out.select(*bars.columns)


def common_stocks(overview: DataFrame, on: str, types: tuple[str, ...] = ("CS", "ADRC")) -> DataFrame:
    """Tickers of common stock that are not delisted by a date."""
    gone = F.to_date(F.try_to_timestamp("delisted_utc"))
    return overview.where(F.col("type").isin(*types) & (gone.isNull() | (gone > F.lit(on).cast("date")))).select("ticker").distinct()


def low_volume_periods(bars: DataFrame, threshold: float, min_days: int = 1) -> DataFrame:
    """Runs of rows with volume at most the threshold: (ticker, period_start, period_end, duration_days, status)."""
    w = Window.partitionBy("ticker").orderBy("date")
    low = F.col("volume") <= F.lit(threshold)
    marked = bars.select("ticker", "date", low.alias("low"), F.row_number().over(w).alias("i"), F.max("date").over(Window.partitionBy("ticker")).alias("last"))
    runs = marked.where("low").withColumn("run", F.col("i") - F.row_number().over(w))
    periods = runs.groupBy("ticker", "run").agg(
        F.min("date").alias("period_start"), F.max("date").alias("period_end"), F.count(F.lit(1)).alias("duration_days"),
        F.when(F.max("date") == F.max("last"), "ongoing").otherwise("closed").alias("status"),
    )
    return periods.where(F.col("duration_days") >= min_days).drop("run")


def merge_history(history: DataFrame, fresh: DataFrame, start: str) -> DataFrame:
    """Earlier periods that end before the restart, and the periods found since."""
    return history.where(F.col("period_end") < F.lit(start).cast("date")).unionByName(fresh)


def restart_date(history: DataFrame, default: str) -> DataFrame:
    """The earliest start of an ongoing period, from which an update must begin (the default if there is none)."""
    return history.where("status = 'ongoing'").agg(F.coalesce(F.min("period_start"), F.lit(default).cast("date")).alias("start"))


def low_volume_summary(periods: DataFrame, bars: DataFrame, threshold: float) -> DataFrame:
    """Each ticker's longest low-volume run (the latest of equal ones) and its mean turnover, whole, on its other bars."""
    longest = F.max_by(F.struct("duration_days", "period_start", "period_end"), F.struct("duration_days", "period_end"))
    runs = periods.groupBy("ticker").agg(longest.alias("m"))
    traded = bars.where(F.col("volume") > F.lit(threshold)).groupBy("ticker").agg(F.avg(F.col("close") * F.col("volume")).cast("bigint").alias("avg_turnover"))
    return runs.join(traded, "ticker", "left").select(
        "ticker", F.col("m.duration_days").alias("max_duration_days"), F.col("m.period_start").alias("max_duration_start_date"), F.col("m.period_end").alias("max_duration_end_date"), "avg_turnover",
    )


def exclude_low_volume(bars: DataFrame, periods: DataFrame, max_days: int = 50, min_turnover: float = 60_000.0) -> DataFrame:
    """Bars without tickers that had a longer low-volume run or a lower mean turnover."""
    long = periods.where(F.col("duration_days") > max_days).select("ticker")
    thin = bars.groupBy("ticker").agg(F.avg(F.col("close") * F.col("volume")).alias("t")).where(F.col("t") < min_turnover).select("ticker")
    return bars.join(long.unionByName(thin).distinct(), "ticker", "left_anti")


def sessions_from(calendar: DataFrame, start: str, n: int) -> DataFrame:
    """The range (start_date, end_date) of ``n`` sessions forward, or backward if negative."""
    if n >= 0:
        own = calendar.where(F.col("date") >= F.lit(start).cast("date")).orderBy("date").limit(max(1, n))
    else:
        own = calendar.where(F.col("date") <= F.lit(start).cast("date")).orderBy(F.desc("date")).limit(-n)
    day = F.lit(start).cast("date")
    return own.agg(F.coalesce(F.min("date"), day).alias("start_date"), F.coalesce(F.max("date"), day).alias("end_date"))


def backtest_dates(spark: SparkSession, start: str, end: str, frequency: str = "daily") -> DataFrame:
    steps = {"daily": "interval 1 day", "weekly": "interval 7 day", "monthly": "interval 1 month"}
    if frequency not in steps:
        raise ValueError(f"unknown frequency {frequency!r}")
    return spark.sql(f"select explode(sequence(date'{start}', date'{end}', {steps[frequency]})) as date")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
