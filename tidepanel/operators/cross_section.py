"""Cross-sectional operators: one window partition per date.

NaN and infinite values become NULL on entry, and NULL is all that comes out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(value: Column | str) -> Column:
    """The value, NULL where it is NaN or infinite."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def average_rank(value: str, *by: str) -> Column:
    """1-based rank in which equal values share their mean rank; NULLs come last."""
    tied = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return F.rank().over(Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last())) + (tied - 1) / F.lit(2.0)


def percent_rank(value: str, *by: str) -> Column:
    """Average rank over the number of values."""
    return average_rank(value, *by) / F.count(value).over(Window.partitionBy(*by))


def winsorize(df: DataFrame, pct: float = 0.01, value: str = "value", date: str = "date") -> DataFrame:
    """Clips to the pct and 1 - pct quantiles of each date, nearest rank."""
    all_day = Window.partitionBy(date)
    n = F.count(value).over(all_day)
    place = F.row_number().over(all_day.orderBy(F.col(value).asc_nulls_last()))
    marked = df.withColumns({"_n": n, "_p": place})
    low = F.max(F.when(F.col("_p") == 1 + F.round(F.lit(float(pct)) * (F.col("_n") - 1)), F.col(value))).over(all_day)
    high = F.max(F.when(F.col("_p") == 1 + F.round(F.lit(1.0 - pct) * (F.col("_n") - 1)), F.col(value))).over(all_day)
    clipped = F.when(F.col(value).isNotNull(), F.least(F.greatest(F.col(value), low), high))
    return marked.withColumn(value, clipped).drop("_n", "_p")


def zscore(df: DataFrame, value: str = "value", date: str = "date") -> DataFrame:
    """(x - mean) / sample deviation of the date; NULL where the deviation is 0 or missing."""
    w = Window.partitionBy(date)
    return df.withColumn(value, ratio(F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w)))


def rank_normalize(df: DataFrame, value: str = "value", date: str = "date") -> DataFrame:
    """Average rank scaled to -1..1; NULL for a single name."""
    n = F.count(value).over(Window.partitionBy(date))
    return df.withColumn(value, ratio(average_rank(value, date) - 1, (n - 1).cast("double")) * 2 - 1)


def sector_neutralize(df: DataFrame, sectors: DataFrame, value: str = "value", date: str = "date") -> DataFrame:
    """x minus the mean of its date and sector; names without a sector are a group of their own."""
    joined = df.join(sectors.select("ticker", F.col("sector").alias("_sector")), "ticker", "left")
    return joined.withColumn(value, F.col(value) - F.avg(value).over(Window.partitionBy(date, "_sector"))).drop("_sector").select(*df.columns)


def preprocess_factor(
    df: DataFrame, sectors: DataFrame | None = None, winsorize_pct: float = 0.01, method: str = "zscore",
    neutralize: tuple[str, ...] = (), value: str = "value", date: str = "date",
) -> DataFrame:
    """Drops missing values, then clips, normalises and neutralises."""
    if method not in ("zscore", "rank"):
        raise ValueError(f"unknown normalisation {method!r}")
    if unknown := set(neutralize) - {"sector"}:
        raise ValueError(f"unknown neutralisation {sorted(unknown)}")
    if "sector" in neutralize and sectors is None:
        raise ValueError("sector neutralisation needs sectors")
    out = df.withColumn(value, finite(value)).where(F.col(value).isNotNull())
    if winsorize_pct > 0:
        out = winsorize(out, winsorize_pct, value, date)
    out = zscore(out, value, date) if method == "zscore" else rank_normalize(out, value, date)
    return sector_neutralize(out, sectors, value, date) if "sector" in neutralize else out
