"""Returns and the evaluation of factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators.cross_section import average_rank, finite, ratio
from tidepanel.operators.time_series import by_ticker

HORIZONS = (1, 5, 10, 20)


def forward_returns(prices: DataFrame, horizons: tuple[int, ...] = HORIZONS, price: str = "close") -> DataFrame:
    """forward_return_{h}d for each horizon; the last rows of a ticker are NULL."""
    w = by_ticker()
    return prices.select("date", "ticker", *[(ratio(F.lead(price, h).over(w), F.col(price)) - 1).alias(f"forward_return_{h}d") for h in horizons])


def log_forward_returns(prices: DataFrame, horizons: tuple[int, ...] = HORIZONS, price: str = "close") -> DataFrame:
    w = by_ticker()

    def one(h: int) -> Column:
        ahead = F.lead(price, h).over(w)
        return F.when((ahead > 0) & (F.col(price) > 0), F.ln(ahead / F.col(price))).alias(f"log_forward_return_{h}d")

    return prices.select("date", "ticker", *map(one, horizons))


def daily_returns(prices: DataFrame, price: str = "close") -> DataFrame:
    r = finite(ratio(F.col(price), F.lag(price).over(by_ticker())) - 1)
    return prices.select("date", "ticker", r.alias("daily_return")).where("daily_return is not null")


def next_day_returns(returns: DataFrame) -> DataFrame:
    ahead = F.lead("daily_return").over(by_ticker())
    return returns.select("date", "ticker", ahead.alias("next_day_return")).where("next_day_return is not null")


def safe_corr(x: str, y: str) -> Column:
    """Aggregate correlation, NULL where a side is constant."""
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def ic_series(signal: DataFrame, forward: DataFrame, target: str, least: int = 30) -> DataFrame:
    """Spearman correlation per date of the signal with what follows, for dates of ``least`` names."""
    joined = signal.select("date", "ticker", finite("value").alias("value")).join(
        forward.select("date", "ticker", finite(target).alias("y")), ["date", "ticker"]
    ).where("value is not null and y is not null")
    ranked = joined.select("date", average_rank("value", "date").alias("rx"), average_rank("y", "date").alias("ry"))
    grouped = ranked.groupBy("date").agg(safe_corr("rx", "ry").alias("ic"), F.count(F.lit(1)).alias("n"))
    return grouped.where((F.col("n") >= least) & F.col("ic").isNotNull()).select("date", "ic")


def ic_stats(ic: DataFrame, *by: str) -> DataFrame:
    """mean, std, ir, t_stat, hit_rate (percent) and n of an IC series; zeros if it is empty."""
    n, mean, std = F.count("ic"), F.coalesce(F.avg("ic"), F.lit(0.0)), F.coalesce(F.stddev_samp("ic"), F.lit(0.0))
    ir = F.coalesce(ratio(mean, std), F.lit(0.0))
    hits = F.coalesce(F.avg(F.when(F.col("ic") > 0, 100.0).otherwise(0.0)), F.lit(0.0))
    return ic.groupBy(*by).agg(
        mean.alias("mean_ic"), std.alias("std_ic"), ir.alias("ir"),
        (ir * F.sqrt(n.cast("double"))).alias("t_stat"), hits.alias("hit_rate"), n.alias("n"),
    )


def ic_decay(signal: DataFrame, forward: DataFrame, horizons: tuple[int, ...] = HORIZONS, least: int = 30) -> DataFrame:
    """IC statistics per horizon in one plan; horizons without a column are skipped."""
    names = {f"forward_return_{h}d": h for h in horizons if f"forward_return_{h}d" in forward.columns}
    long = forward.unpivot(["date", "ticker"], list(names), "name", "y")
    joined = signal.select("date", "ticker", finite("value").alias("value")).join(long, ["date", "ticker"])
    joined = joined.withColumn("y", finite("y")).where("value is not null and y is not null")
    ranked = joined.select("date", "name", average_rank("value", "date", "name").alias("rx"), average_rank("y", "date", "name").alias("ry"))
    ic = ranked.groupBy("name", "date").agg(safe_corr("rx", "ry").alias("ic"), F.count(F.lit(1)).alias("n"))
    ic = ic.where((F.col("n") >= least) & F.col("ic").isNotNull())
    horizon = F.regexp_extract("name", r"(\d+)d$", 1).cast("int")
    return ic_stats(ic.withColumn("horizon", horizon), "horizon")


def rank_turnover(signal: DataFrame) -> DataFrame:
    """Mean change of the rank weight (-1..1) over each name's previous observation, per date."""
    n = F.count("value").over(Window.partitionBy("date"))
    weighted = signal.withColumn("_n", n).withColumn("w", ratio(average_rank("value", "date") - 1, (F.col("_n") - 1).cast("double")) * 2 - 1)
    change = weighted.withColumn("change", F.abs(F.col("w") - F.lag("w").over(by_ticker())))
    return change.groupBy("date").agg(F.avg("change").alias("turnover"), F.count("change").alias("n_stocks")).where("turnover is not null")


def quantile_returns(signal: DataFrame, forward: DataFrame, target: str, n: int = 5) -> DataFrame:
    """Mean return and count per date and bucket; buckets (a, b] lie between linear quantiles."""
    joined = signal.join(forward.select("date", "ticker", finite(target).alias("y")), ["date", "ticker"])
    joined = joined.withColumn("value", finite("value")).where("value is not null and y is not null")
    cuts = F.percentile("value", F.array(*[F.lit(k / n) for k in range(1, n)])).over(Window.partitionBy("date"))
    bucket = F.size(F.filter("_cuts", lambda c: c < F.col("value"))) + 1
    return joined.withColumn("_cuts", cuts).groupBy("date", bucket.alias("bucket")).agg(F.avg("y").alias("mean_return"), F.count("y").alias("n"))


def quantile_spread(signal: DataFrame, forward: DataFrame, target: str, n: int = 5) -> DataFrame:
    """Return of the lowest minus the highest ordinal bucket per date."""
    joined = signal.join(forward.select("date", "ticker", F.col(target).alias("y")), ["date", "ticker"]).where("value is not null and y is not null")
    day = Window.partitionBy("date")
    bucket = F.floor((F.row_number().over(day.orderBy("value", "ticker")) - 1) * n / F.count(F.lit(1)).over(day))
    put = joined.withColumn("_b", bucket).groupBy("date")
    low, high = (F.avg(F.when(F.col("_b") == b, F.col("y"))) for b in (0, n - 1))
    return put.agg((low - high).alias("spread"))


def factor_summary(stats: DataFrame, turnover: DataFrame) -> DataFrame:
    """IC statistics with the mean turnover and a verdict in words."""
    verdict = F.when((F.abs("t_stat") > 2) & (F.abs("ir") > 0.5), "strong").when((F.abs("t_stat") > 2) & (F.abs("ir") > 0.3), "usable").when(F.abs("t_stat") > 2, "significant").otherwise("weak")
    return stats.crossJoin(turnover.agg(F.avg("turnover").alias("mean_turnover"))).withColumn("verdict", verdict)


def ic_correlation(series: dict[str, DataFrame]) -> DataFrame:
    """(a, b, corr) over the dates that both IC series have."""
    names = sorted(series)
    long = None
    for name in names:
        own = series[name].select("date", F.lit(name).alias("name"), "ic")
        long = own if long is None else long.unionByName(own)
    pairs = long.toDF("date", "a", "x").join(long.toDF("date", "b", "y"), "date").where("a <= b")
    return pairs.groupBy("a", "b").agg(safe_corr("x", "y").alias("corr"))
