"""Market-bar panels over the star-schema tables: weekly bars by brand, monthly bars by supplier, ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def aggregate_bars(trades: DataFrame, price: Column, size: Column, order: Column) -> DataFrame:
    """OHLCV bars of trades that carry ``ticker`` and ``date``; ``order`` settles first and last."""
    return trades.groupBy("ticker", "date").agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.sum(size).cast("bigint").alias("volume"),
        F.count(F.lit(1)).alias("transactions"),
    )


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = "l_shipdate l_orderkey l_linenumber l_partkey l_suppkey l_quantity l_extendedprice".split()
    return table(spark, sf_dir, "lineitem").select(*columns)


_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _price() -> Column:
    return F.lit(1000.0) + F.sqrt(F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0)))


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker = brand, date = week): a long history of 25 names."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
    trades = _trades(spark, sf_dir).join(part, "l_partkey").withColumn("date", F.date_trunc("week", "l_shipdate").cast("date"))
    return aggregate_bars(trades, _price(), F.col("l_quantity"), F.struct(*_ORDER))


def monthly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker = supplier key, date = month): a wide cross-section."""
    trades = _trades(spark, sf_dir).withColumns({"ticker": F.col("l_suppkey").cast("string"), "date": F.date_trunc("month", "l_shipdate").cast("date")})
    return aggregate_bars(trades, _price(), F.col("l_quantity"), F.struct(*_ORDER))


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker = supplier key, sector = region)."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    supplier = table(spark, sf_dir, "supplier")
    joined = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("s_suppkey").cast("string").alias("ticker"), F.col("r_name").alias("sector"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker = event type, timestamps, price, size = 1)."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("ticker"), F.col("ts").alias("timestamps"), F.col("value").alias("price"), F.lit(1).cast("bigint").alias("size")
    )
