"""Validation: walk-forward folds, bootstrap, Sharpe tests, multiple testing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NORMAL = NormalDist()


@dataclass(frozen=True)
class Fold:
    fold: int
    train_start: int
    train_end: int
    test_start: int
    test_end: int

    @property
    def train_size(self) -> int:
        return self.train_end - self.train_start

    @property
    def test_size(self) -> int:
        return self.test_end - self.test_start


def walk_forward_folds(n: int, train: int, test: int, embargo: int = 5, anchored: bool = False) -> list[Fold]:
    """Half-open index ranges; tests follow one another, and the last may be as short as half."""
    if min(n, train, test) <= 0 or embargo < 0:
        raise ValueError("sizes must be positive and the embargo not negative")
    folds = []
    start = train + embargo
    while start < n:
        end = min(start + test, n)
        if end - start < max(1, test // 2) and end - start < test:
            break
        stop = start - embargo
        folds.append(Fold(len(folds), 0 if anchored else stop - train, stop, start, end))
        start += test
    if not folds:
        raise ValueError("too few dates for a fold")
    return folds


def folds_frame(spark: SparkSession, folds: list[Fold]) -> DataFrame:
    return spark.createDataFrame([asdict(f) for f in folds], "fold int, train_start int, train_end int, test_start int, test_end int")


def split_by_folds(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """``panel`` once for each fold and part it lies in: adds ``fold`` and ``split`` ('is' or 'oos')."""
    dates = panel.select("date").distinct().withColumn("_i", F.row_number().over(Window.orderBy("date")) - 1)
    parts = folds.select("fold", F.explode(F.array(
        F.struct(F.lit("is").alias("split"), F.col("train_start").alias("a"), F.col("train_end").alias("b")),
        F.struct(F.lit("oos").alias("split"), F.col("test_start").alias("a"), F.col("test_end").alias("b")),
    )).alias("x")).select("fold", "x.*")
    placed = dates.join(parts, (F.col("_i") >= F.col("a")) & (F.col("_i") < F.col("b"))).select("date", "fold", "split")
    return panel.join(placed, "date")


def fold_dates(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """Each fold's first and last dates in and out of sample, and its numbers of dates."""
    placed = split_by_folds(panel.select("date").distinct(), folds).groupBy("fold")
    spans = [f(F.when(F.col("split") == split, F.col("date"))).alias(f"{name}_{end}") for split, name in (("is", "train"), ("oos", "test")) for f, end in ((F.min, "start"), (F.max, "end"))]
    sizes = [F.count(F.when(F.col("split") == split, 1)).alias(f"{name}_size") for split, name in (("is", "train"), ("oos", "test"))]
    return placed.agg(*spans, *sizes)


def bootstrap_sharpe(daily: DataFrame, ret: str = "portfolio_return", n_boot: int = 10_000, block: int = 5, seed: int = 42, periods: int = 252, level: float = 0.95) -> DataFrame:
    """Sharpe ratio, bootstrap error and percentile interval by circular blocks; each replicate has its own seed."""
    spark = daily.sparkSession
    r = np.array([x[0] for x in daily.orderBy("date").select(ret).where(f"{ret} is not null").collect()])  # one per date
    if len(r) < 2:
        raise ValueError("needs two returns")

    def sharpe(x: np.ndarray) -> float:
        s = x.std(ddof=1)
        return float(x.mean() / s * math.sqrt(periods)) if s > 1e-12 else 0.0

    blocks = -(-len(r) // block)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k in batch["id"]:
                starts = np.random.default_rng((seed, int(k))).integers(0, len(r), blocks)
                out.append(sharpe(r[((starts[:, None] + np.arange(block)) % len(r)).ravel()[: len(r)]]))
            yield pd.DataFrame({"sharpe": out})

    found = spark.range(n_boot).mapInPandas(draw, "sharpe double")
    cuts = F.percentile("sharpe", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    return found.agg(cuts.alias("c"), F.stddev_samp("sharpe").alias("se")).select(F.lit(sharpe(r)).alias("sharpe"), "se", F.get("c", F.lit(0)).alias("low"), F.get("c", F.lit(1)).alias("high"))


def sharpe_statistics(daily: DataFrame, ret: str = "portfolio_return", periods: int = 252) -> DataFrame:
    """One row: n_obs, annual Sharpe ratio and its error allowing for skewness and kurtosis (NULL below 10)."""
    row = daily.where(f"{ret} is not null").agg(
        F.count(ret).alias("n_obs"), (F.avg(ret) / F.nullif(F.stddev_samp(ret), F.lit(0.0))).alias("s"),
        F.when(F.stddev_pop(ret) > 0, F.skewness(ret)).alias("g1"), (F.when(F.stddev_pop(ret) > 0, F.kurtosis(ret))).alias("g2"),
    )
    s = F.col("s")
    se = F.sqrt((1 + s * s / 2 - F.col("g1") * s + F.col("g2") / 4 * s * s) / F.col("n_obs")) * math.sqrt(periods)
    return row.select("n_obs", (s * math.sqrt(periods)).alias("sharpe"), F.when(F.col("n_obs") >= 10, se).alias("se"))


def sharpe_pvalue(stats: DataFrame) -> dict:
    """Two-sided p value that the Sharpe ratio is 0."""
    row = stats.collect()[0]
    out = row.asDict()
    out["z"] = row.sharpe / row.se if row.se else 0.0
    out["p_value"] = 2 * (1 - NORMAL.cdf(abs(out["z"]))) if row.se else 1.0
    return out


def probabilistic_sharpe(stats: DataFrame, benchmark_sr: float = 0.0) -> dict:
    """Probability that the true Sharpe ratio exceeds the benchmark."""
    out = sharpe_pvalue(stats)
    return out | {"benchmark_sr": benchmark_sr, "psr": NORMAL.cdf((out["sharpe"] - benchmark_sr) / out["se"]) if out["se"] else 0.5}


def deflated_sharpe(stats: DataFrame, n_trials: int) -> dict:
    """The same against the greatest Sharpe ratio expected of ``n_trials`` without skill."""
    if n_trials < 1:
        raise ValueError("n_trials must be positive")
    se, euler = sharpe_pvalue(stats)["se"] or 0.0, 0.5772156649015329
    best = 0.0 if n_trials == 1 else se * ((1 - euler) * NORMAL.inv_cdf(1 - 1 / n_trials) + euler * NORMAL.inv_cdf(1 - 1 / (n_trials * math.e)))
    out = probabilistic_sharpe(stats, best)
    return out | {"dsr": out["psr"], "n_trials": n_trials}


def corrections(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(label, p) -> p values after Bonferroni, Holm and Benjamini-Hochberg, and whether each is below ``alpha``."""
    up = Window.orderBy("p", "label")
    all_rows = Window.partitionBy()
    x = tests.select("label", "p", F.count(F.lit(1)).over(all_rows).cast("double").alias("n"), F.row_number().over(up).alias("k"))
    x = x.withColumns({"_holm": F.col("p") * (F.col("n") - F.col("k") + 1), "_bh": F.col("p") * F.col("n") / F.col("k")})
    holm = F.max("_holm").over(up.rowsBetween(Window.unboundedPreceding, 0))
    bh = F.min("_bh").over(Window.orderBy(F.desc("p"), F.desc("label")).rowsBetween(Window.unboundedPreceding, 0))
    one = F.lit(1.0)
    x = x.select("label", "p", F.least(F.col("p") * F.col("n"), one).alias("bonferroni"), F.least(holm, one).alias("holm"), F.least(bh, one).alias("bh"))
    return x.withColumns({f"{m}_significant": F.col(m) < alpha for m in ("bonferroni", "holm", "bh")})
