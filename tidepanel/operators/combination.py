"""Combination of factors."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METHODS = ("equal", "ic", "mean_variance", "risk_parity")


def ic_moments(series: list[DataFrame]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, sample deviations and sample covariance of IC series, aligned from their starts and cut to the shortest."""
    k = len(series)
    order = Window.orderBy("date")  # one row per date
    long = [s.select(F.row_number().over(order).alias("i"), F.lit(j).alias("j"), "ic") for j, s in enumerate(series)]
    wide = reduce(DataFrame.unionByName, long).groupBy("i").pivot("j", list(range(k))).agg(F.first("ic")).na.drop()
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    row = wide.agg(*[F.avg(str(a)) for a in range(k)], *[F.covar_samp(str(a), str(b)) for a, b in pairs]).collect()[0]
    values = [0.0 if v is None else float(v) for v in row]
    cov = np.zeros((k, k))
    for (a, b), v in zip(pairs, values[k:], strict=True):
        cov[a, b] = cov[b, a] = v
    return np.array(values[:k]), np.sqrt(np.diag(cov)), cov


def weights(method: str, series: list[DataFrame] | None, k: int) -> list[float]:
    """Weights that sum to 1: equal, by mean IC, by inverse covariance, or by inverse deviation of the IC."""
    if method not in METHODS:
        raise ValueError(f"unknown combination {method!r}")
    if method == "equal":
        return [1.0 / k] * k
    if not series or len(series) != k:
        raise ValueError(f"{method} needs one IC series per factor")
    mean, std, cov = ic_moments(series)
    if method == "ic":
        raw = np.maximum(mean, 0.0)
    elif method == "mean_variance":
        raw = np.maximum(np.linalg.solve(cov + 1e-6 * np.eye(k), mean), 0.0)
    else:
        raw = np.where(std > 1e-10, 1.0 / np.maximum(std, 1e-10), 0.0)
    return [1.0 / k] * k if raw.sum() <= 1e-12 else (raw / raw.sum()).tolist()


def combine_factors(signals: list[DataFrame], method: str = "equal", series: list[DataFrame] | None = None) -> DataFrame:
    """Weighted sum of factors over the (date, ticker) that all have: one aggregation, no chain of joins."""
    if not signals:
        raise ValueError("no factors to combine")
    if len(signals) == 1:
        return signals[0]
    k = len(signals)
    w = weights(method, series, k)
    long = reduce(DataFrame.unionByName, [s.select("date", "ticker", F.lit(j).alias("j"), "value") for j, s in enumerate(signals)])
    parts = [F.max(F.when(F.col("j") == j, F.col("value"))) for j in range(k)]
    total = reduce(lambda a, b: a + b, [p * F.lit(float(x)) for p, x in zip(parts, w, strict=True)])
    return long.groupBy("date", "ticker").agg(total.alias("value"), F.count_distinct("j").alias("_n")).where(F.col("_n") == k).drop("_n")
