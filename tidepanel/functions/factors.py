"""Indicators and factors, and the registry through which pipelines find them.

A factor is a function ``f(bars, **params) -> (date, ticker, value)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators import cross_section as cs
from tidepanel.operators import time_series as ts

Factor = Callable[..., DataFrame]
_factors: dict[str, Factor] = {}
_indicators: dict[str, Factor] = {}


def register_factor(name: str, f: Factor | None = None):
    """Registers a factor, directly or as a decorator; names are case-insensitive."""
    def put(g: Factor) -> Factor:
        _factors[name.lower()] = g
        return g

    return put(f) if f else put


def list_factors() -> list[str]:
    return sorted(_factors)


def get_factor(name: str) -> Factor:
    if name.lower() not in _factors:
        raise KeyError(f"unknown factor {name!r}; known: {', '.join(list_factors())}")
    return _factors[name.lower()]


def compute_factor(name: str, bars: DataFrame, params: dict | None = None, **preprocessing) -> DataFrame:
    """A registered factor's values, cleaned and normalised."""
    return cs.preprocess_factor(get_factor(name)(bars, **(params or {})), **preprocessing)


def register_indicator(name: str):
    def put(g: Factor) -> Factor:
        _indicators[name] = g
        return g

    return put


def get_indicator(name: str) -> Factor:
    return _indicators[name]


def list_indicators() -> list[str]:
    return sorted(_indicators)


def _signal(bars: DataFrame, value: Column) -> DataFrame:
    return bars.select("date", "ticker", cs.finite(value).alias("value"))


def log_return(price: str = "close") -> Column:
    before = F.lag(price).over(ts.by_ticker())
    return F.when((F.col(price) > 0) & (before > 0), F.ln(F.col(price) / before))


@register_indicator("obv")
def obv(bars: DataFrame) -> DataFrame:
    """On-balance volume: starts at the first volume, then adds or subtracts by the close's direction."""
    w = ts.by_ticker()
    before = F.lag("close").over(w)
    step = F.when(before.isNull() | (F.col("close") > before), F.col("volume")).when(F.col("close") < before, -F.col("volume")).otherwise(0)
    return bars.withColumn("_step", step).withColumn("obv", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


@register_indicator("bbiboll")
def bbiboll(bars: DataFrame, length: int = 11, multiple: float = 6.0, pct_window: int = 252) -> DataFrame:
    """Bull-bear index bands: bbi, dev, upr, dwn, dev_pct and longterm_dev_pct_rank.

    dev_pct counts the deviations of the last ``pct_window`` rows that do not
    exceed the current one, from min(50, pct_window // 3) rows on.
    """
    close = F.col("close")
    means = [ts.rolling(F.avg, close, n, ts.trailing(n)) for n in (3, 6, 12, 24)]
    out = bars.withColumn("bbi", (means[0] + means[1] + means[2] + means[3]) / 4)
    out = out.withColumn("dev", ts.rolling(F.stddev_pop, F.col("bbi"), length, ts.trailing(length)) * F.lit(float(multiple)))
    out = out.withColumns({"upr": F.col("bbi") + F.col("dev"), "dwn": F.col("bbi") - F.col("dev")})
    recent = F.collect_list("dev").over(ts.trailing(pct_window))
    out = out.withColumns({"_row": F.row_number().over(ts.by_ticker()), "_recent": recent})
    count = F.size(F.filter("_recent", lambda v: v <= F.col("dev")))
    rank = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("dev").asc_nulls_last(), "date"))
    out = out.withColumns({
        "dev_pct": F.when(F.col("dev").isNotNull() & (F.col("_row") >= min(50, pct_window // 3)), count),
        "longterm_dev_pct_rank": F.when(F.col("dev").isNotNull(), rank),
    })
    return out.drop("_row", "_recent")


@register_factor("bbiboll")
def bbiboll_factor(bars: DataFrame, length: int = 11, multiple: float = 6.0) -> DataFrame:
    """Distance of the close from the index in band widths."""
    return _signal(bbiboll(bars, length, multiple), cs.ratio(F.col("close") - F.col("bbi"), F.col("dev")))


@register_factor("momentum")
def momentum(bars: DataFrame, lookback: int = 20) -> DataFrame:
    before = F.lag("close", lookback).over(ts.by_ticker())
    return _signal(bars, F.when((before > 0) & (F.col("close") > 0), F.ln(F.col("close") / before)))


@register_factor("vol_ratio")
def vol_ratio(bars: DataFrame, short: int = 5, long: int = 20) -> DataFrame:
    """Short over long deviation of log returns."""
    r = bars.withColumn("_r", log_return())
    a, b = (ts.rolling(F.stddev_samp, F.col("_r"), n, ts.trailing(n)) for n in (short, long))
    return _signal(r, cs.ratio(a, b))


@register_factor("str")
def short_term_reversal(bars: DataFrame, lookback: int = 5) -> DataFrame:
    return _signal(bars, -(cs.ratio(F.col("close"), F.lag("close", lookback).over(ts.by_ticker())) - 1))


@register_factor("vpd")
def volume_price_divergence(bars: DataFrame, window: int = 20) -> DataFrame:
    """Volume over its mean, signed by the return."""
    mean = ts.rolling(F.avg, F.col("volume"), window, ts.trailing(window))
    move = cs.ratio(F.col("close"), F.lag("close").over(ts.by_ticker())) - 1
    return _signal(bars, cs.ratio(F.col("volume").cast("double"), mean) * F.signum(move))


@register_factor("alpha001")
def alpha001(bars: DataFrame, window: int = 5) -> DataFrame:
    """Cross-sectional rank of the place of the greatest signed squared return."""
    move = bars.withColumn("_m", ts.signed_power(cs.ratio(F.col("close"), F.lag("close").over(ts.by_ticker())) - 1, 2.0))
    placed = move.withColumn("_a", ts.ts_argmax(F.col("_m"), window, ts.trailing(window)))
    return _signal(placed, F.when(F.col("_a").isNotNull(), cs.percent_rank("_a", "date")))


@register_factor("alpha002")
def alpha002(bars: DataFrame, window: int = 6) -> DataFrame:
    """Minus the correlation of the ranks of log-volume change and intraday return."""
    before = F.lag("volume", 2).over(ts.by_ticker())
    # the logarithm of the quotient, so that equal quotients tie exactly
    change = F.when((F.col("volume") > 0) & (before > 0), F.ln(F.col("volume") / before))
    out = bars.withColumns({"_d": change, "_i": cs.ratio(F.col("close") - F.col("open"), F.col("open"))})
    out = out.withColumns({c: F.when(F.col(x).isNotNull(), cs.percent_rank(x, "date")) for c, x in (("_x", "_d"), ("_y", "_i"))})
    return _signal(out, -ts.ts_corr(F.col("_x"), F.col("_y"), window, ts.trailing(window)))


@register_factor("alpha003")
def alpha003(bars: DataFrame, window: int = 10) -> DataFrame:
    """Minus the correlation of the ranks of open and volume."""
    out = bars.withColumns({"_x": cs.percent_rank("open", "date"), "_y": cs.percent_rank("volume", "date")})
    return _signal(out, -ts.ts_corr(F.col("_x"), F.col("_y"), window, ts.trailing(window)))
