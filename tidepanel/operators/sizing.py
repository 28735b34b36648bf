"""Position sizing: signals to weights per date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidepanel.functions.factors import log_return
from tidepanel.operators.cross_section import ratio
from tidepanel.operators.time_series import rolling, trailing

def day() -> WindowSpec:
    return Window.partitionBy("date")


def legs(signal: DataFrame, n_long: int, n_short: int) -> DataFrame:
    """``signal`` with ``side`` -1, 0 or 1: the lowest and the highest names; ties go by ticker, short before long."""
    if n_long < 0 or n_short < 0 or n_long + n_short == 0:
        raise ValueError("n_long and n_short must not be negative, nor both 0")
    up = F.row_number().over(day().orderBy("value", "ticker"))
    down = F.count(F.lit(1)).over(day()) - up + 1
    side = F.when(up <= n_short, -1).when(down <= n_long, 1).otherwise(0)
    return signal.where(F.col("value").isNotNull()).withColumn("side", side)


def size_equal_weight(signal: DataFrame, n_long: int = 10, n_short: int = 10) -> DataFrame:
    picked = legs(signal, n_long, n_short).where("side <> 0")
    return picked.select("date", "ticker", (F.col("side") / F.lit(float(n_long + n_short))).alias("weight"))


def realized_volatility(prices: DataFrame, window: int = 20) -> DataFrame:
    """Deviation of the last ``window`` log returns, not annualised."""
    r = prices.withColumn("_r", log_return())
    return r.select("date", "ticker", rolling(F.stddev_samp, F.col("_r"), window, trailing(window)).alias("volatility"))


def _inverse(signal: DataFrame, volatility: DataFrame, n_long: int, n_short: int) -> DataFrame:
    joined = legs(signal, n_long, n_short).where("side <> 0").join(volatility, ["date", "ticker"])
    joined = joined.where("volatility is not null").withColumn("sigma", F.greatest("volatility", F.lit(1e-8)))
    share = (1.0 / F.col("sigma")) / F.sum(1.0 / F.col("sigma")).over(day())
    return joined.withColumn("weight", F.col("side") * share)


def size_inverse_volatility(signal: DataFrame, volatility: DataFrame, n_long: int = 10, n_short: int = 10) -> DataFrame:
    """Weights by 1/sigma, gross exposure 1."""
    return _inverse(signal, volatility, n_long, n_short).select("date", "ticker", "weight")


def size_volatility_target(
    signal: DataFrame, volatility: DataFrame, n_long: int = 10, n_short: int = 10,
    target: float = 0.10, periods: int = 252, max_leverage: float = 3.0,
) -> DataFrame:
    """Inverse-volatility weights scaled to a target volatility, names taken as uncorrelated."""
    base = _inverse(signal, volatility, n_long, n_short)
    risk = F.sqrt(F.sum(F.col("weight") * F.col("weight") * F.col("sigma") * F.col("sigma")).over(day()))
    scale = F.least(ratio(F.lit(target) / F.sqrt(F.lit(float(periods))), risk), F.lit(max_leverage))
    return base.select("date", "ticker", (F.col("weight") * scale).alias("weight"))


def size_signal_weighted(
    signal: DataFrame, returns: DataFrame, n_long: int = 10, n_short: int = 10,
    lookback: int = 60, max_position: float = 0.10, max_leverage: float = 1.0, ret: str = "daily_return",
) -> DataFrame:
    """|z| / variance in each leg, normalised to the leverage and capped (the cap is not redistributed)."""
    var = returns.select("date", "ticker", rolling(F.var_samp, F.col(ret), lookback, trailing(lookback)).alias("var"))
    z: Column = ratio(F.col("value") - F.avg("value").over(day()), F.stddev_samp("value").over(day()))
    picked = legs(signal.withColumn("z", z), n_long, n_short).where("side <> 0").join(var, ["date", "ticker"]).where("var > 0 and z is not null")
    raw = picked.withColumn("raw", F.col("side") * F.abs("z") / F.col("var"))
    gross = ratio(F.col("raw"), F.sum(F.abs("raw")).over(day())) * max_leverage
    capped = F.least(F.greatest(gross, F.lit(-max_position)), F.lit(max_position))
    return raw.select("date", "ticker", capped.alias("weight")).where(F.abs("weight") > 1e-10)


def sizing_methods(n_long: int, n_short: int, prices: DataFrame, returns: DataFrame, target: float = 0.10, max_leverage: float = 3.0) -> dict:
    """Name -> function of a signal; nothing is planned until one is called."""
    vol = realized_volatility(prices)
    return {
        "Equal-Weight": lambda s: size_equal_weight(s, n_long, n_short),
        "Inverse-Vol": lambda s: size_inverse_volatility(s, vol, n_long, n_short),
        f"Vol-Target ({target:.0%})": lambda s: size_volatility_target(s, vol, n_long, n_short, target, max_leverage=max_leverage),
        "Signal-Weighted": lambda s: size_signal_weighted(s, returns, n_long, n_short),
    }
