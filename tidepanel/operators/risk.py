"""Risk and distribution statistics of a return series: one-row tables."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators.cross_section import finite, ratio

NORMAL = NormalDist()


def clean(df: DataFrame, ret: str = "r") -> DataFrame:
    """(r): the finite returns."""
    return df.select(finite(ret).alias("r")).where("r is not null")


def skewness() -> Column:
    """Bias-corrected skewness, NULL below 3 values or without spread."""
    n = F.count("r").cast("double")
    g1 = F.when(F.stddev_pop("r") > 0, F.skewness("r"))
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def kurtosis() -> Column:
    """Bias-corrected excess kurtosis, NULL below 4 values or without spread."""
    n = F.count("r").cast("double")
    g2 = F.when(F.stddev_pop("r") > 0, F.kurtosis("r"))
    return F.when(n > 3, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * g2 + 6))


def tail_table(df: DataFrame, levels: tuple[float, ...] = (0.9, 0.95, 0.99), ret: str = "r") -> DataFrame:
    """Historical and parametric VaR and CVaR for each confidence level, and their ratios."""
    r = clean(df, ret)
    stats = r.agg(F.avg("r").alias("mu"), F.stddev_samp("r").alias("sd"), F.percentile("r", F.array(*[F.lit(1 - c) for c in levels])).alias("cuts"))
    z = [NORMAL.inv_cdf(1 - c) for c in levels]
    rows = F.array(*[F.struct(F.lit(c).alias("confidence"), F.lit(x).alias("z"), F.lit(NORMAL.pdf(x) / (1 - c)).alias("h"), F.get("cuts", F.lit(i)).alias("cut")) for i, (c, x) in enumerate(zip(levels, z, strict=True))])
    spread = stats.select("mu", "sd", F.explode(rows).alias("x")).select("mu", "sd", "x.*")
    low = r.crossJoin(F.broadcast(spread)).where(F.col("r") <= F.col("cut"))  # a row per level
    cvar = low.groupBy("confidence").agg((-F.avg("r")).alias("cvar_historical"))
    out = spread.join(cvar, "confidence").select(
        "confidence", (-F.col("cut")).alias("var_historical"), (-(F.col("mu") + F.col("z") * F.col("sd"))).alias("var_parametric"),
        "cvar_historical", (-(F.col("mu") - F.col("sd") * F.col("h"))).alias("cvar_parametric"),
    )
    return out.withColumn("var_ratio", ratio(F.col("var_historical"), F.col("var_parametric")))


def drawdowns(daily: DataFrame, ret: str = "r", date: str = "date") -> DataFrame:
    """(date, drawdown): wealth over its running maximum, minus 1."""
    w = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    wealth = daily.where(finite(ret).isNotNull()).select(date, F.product(1 + F.col(ret)).over(w).alias("wealth"))
    return wealth.select(date, (F.col("wealth") / F.max("wealth").over(w) - 1).alias("drawdown"))


def moments(df: DataFrame, ret: str = "r", periods: int = 252) -> DataFrame:
    """n, annual mean, volatility and Sharpe, skewness, kurtosis, tail ratio, Jarque-Bera and its p."""
    tail = F.percentile("r", F.array(F.lit(0.05), F.lit(0.95)))
    year = F.lit(float(periods))
    g1 = F.when(F.stddev_pop("r") > 0, F.skewness("r"))
    g2 = F.when(F.stddev_pop("r") > 0, F.kurtosis("r"))
    jb = F.count("r") / 6.0 * (g1 * g1 + g2 * g2 / 4.0)
    row = clean(df, ret).agg(
        F.count("r").alias("n"), (F.avg("r") * year).alias("annual_mean"), (F.stddev_samp("r") * F.sqrt(year)).alias("annual_volatility"),
        (ratio(F.avg("r"), F.stddev_samp("r")) * F.sqrt(year)).alias("sharpe"), skewness().alias("skewness"), kurtosis().alias("kurtosis"),
        tail.alias("_t"), jb.alias("jarque_bera"), F.exp(-jb / 2).alias("jarque_bera_p"),
    )
    left = F.abs(F.get("_t", F.lit(0)))
    return row.withColumn("tail_ratio", F.when(left < 1e-10, float("inf")).otherwise(F.abs(F.get("_t", F.lit(1))) / left)).drop("_t")


def at_least_two(df: DataFrame) -> DataFrame:
    """A one-row table with ``n``, or the error of fewer than 2 finite returns."""
    return df.withColumn("n", F.when(F.col("n") >= 2, F.col("n")).otherwise(F.raise_error(F.lit("at least 2 finite returns are needed")).cast("bigint")))


def risk_summary(daily: DataFrame, ret: str = "r", date: str = "date", confidence: float = 0.95, periods: int = 252) -> DataFrame:
    """Thirteen risk measures of a return series in one row; fewer than 2 finite returns are an error."""
    row = at_least_two(moments(daily, ret, periods))
    tail = tail_table(daily, (confidence,), ret).drop("confidence")
    fall = drawdowns(daily, ret, date).agg((-F.min("drawdown")).alias("max_drawdown"))
    out = row.crossJoin(F.broadcast(tail)).crossJoin(F.broadcast(fall))  # one row each
    return out.select(
        F.col("annual_mean").alias("mean_return"), F.col("annual_volatility").alias("volatility"), F.coalesce("sharpe", F.lit(0.0)).alias("sharpe"), "skewness",
        F.col("kurtosis").alias("excess_kurtosis"), "var_historical", "var_parametric", "cvar_historical", "cvar_parametric", "var_ratio", "max_drawdown", "tail_ratio",
        F.col("n").alias("n_observations"),
    )


def distribution_summary(df: DataFrame, ret: str = "r", levels: tuple[float, ...] = (0.9, 0.95, 0.99)) -> DataFrame:
    """n, mean, deviation, shape, Jarque-Bera with its p, and the tail table as an array, in one row."""
    row = at_least_two(moments(df, ret, 1)).select(
        "n", F.col("annual_mean").alias("mean"), F.col("annual_volatility").alias("std"), "skewness", F.col("kurtosis").alias("excess_kurtosis"), "jarque_bera", "jarque_bera_p",
    )
    tail = tail_table(df, levels, ret)
    return row.crossJoin(F.broadcast(tail.agg(F.sort_array(F.collect_list(F.struct(*tail.columns))).alias("tail"))))  # a row per level


def qq_data(df: DataFrame, ret: str = "r") -> DataFrame:
    """(theoretical, sample): normal quantiles at (i - 0.5) / n against the standardised sorted sample."""
    w = Window.orderBy("r")
    all_rows = Window.partitionBy()
    x = clean(df, ret).select(
        ((F.row_number().over(w) - 0.5) / F.count(F.lit(1)).over(all_rows)).alias("p"),
        ratio(F.col("r") - F.avg("r").over(all_rows), F.stddev_samp("r").over(all_rows)).alias("sample"),
    )
    quantile = F.pandas_udf(lambda s: s.map(NORMAL.inv_cdf), "double")
    return x.select(quantile("p").alias("theoretical"), "sample")


def histogram(df: DataFrame, bins: int = 80, ret: str = "r") -> DataFrame:
    """(bin, low, high, density, normal): density histogram, its last bin closed, with the fitted normal density."""
    r = clean(df, ret)
    stats = r.agg(F.min("r").alias("a"), F.max("r").alias("b"), F.count("r").alias("n"), F.avg("r").alias("mu"), F.stddev_samp("r").alias("sd"))
    width = (F.col("b") - F.col("a")) / bins
    place = F.least(F.floor(ratio(F.col("r") - F.col("a"), width)), F.lit(bins - 1)).cast("int")
    counts = r.crossJoin(F.broadcast(stats)).groupBy(F.coalesce(place, F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("k"))
    grid = stats.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(counts, "bin", "left")
    low, mid = F.col("a") + F.col("bin") * width, F.col("a") + (F.col("bin") + 0.5) * width
    z = ratio(mid - F.col("mu"), F.col("sd"))
    return grid.select(
        "bin", low.alias("low"), (low + width).alias("high"), ratio(F.coalesce("k", F.lit(0)) / F.col("n"), width).alias("density"),
        (ratio(F.exp(-z * z / 2), F.col("sd")) / math.sqrt(2 * math.pi)).alias("normal"),
    )


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W and p by Royston's approximation for 12 to 5000 values, on the driver."""
    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    if not 12 <= n <= 5000:
        raise ValueError("needs 12 to 5000 values")
    m = np.array([NORMAL.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u = 1 / math.sqrt(n)
    c = m / math.sqrt(m @ m)
    last = c[-1] + 0.221157 * u - 0.147981 * u**2 - 2.07119 * u**3 + 4.434685 * u**4 - 2.706056 * u**5
    prior = c[-2] + 0.042981 * u - 0.293762 * u**2 - 1.752461 * u**3 + 5.682633 * u**4 - 3.582633 * u**5
    phi = (m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * prior**2)
    a = m / math.sqrt(phi)
    a[0], a[1], a[-2], a[-1] = -last, -prior, prior, last
    w = float((a @ x) ** 2 / ((x - x.mean()) @ (x - x.mean())))
    k = math.log(n)
    mu = 0.0038915 * k**3 - 0.083751 * k**2 - 0.31082 * k - 1.5861
    sigma = math.exp(0.0030302 * k**2 - 0.082676 * k - 0.4803)
    return w, 1 - NORMAL.cdf((math.log(1 - w) - mu) / sigma)
