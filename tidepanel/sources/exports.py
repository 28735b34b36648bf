"""Backtest results written as files: daily portfolio, trades, open positions, metrics and configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators.portfolio import performance


def _csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def _text(daily: DataFrame, title: str, facts: dict, path: str) -> None:
    lines = [title, "=" * 50, ""] + [f"{k}: {v}" for k, v in facts.items()]
    daily.sparkSession.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


def export_backtest(folder: str, name: str, daily: DataFrame, trades: DataFrame, positions: DataFrame, config: dict | None = None, benchmark: DataFrame | None = None) -> dict:
    """Writes ``<folder>/<name>_...`` folders: CSV of the portfolio by date, of trades by percent return and of open positions by
    purchase, metrics (returned too) and configuration as text.  Every frame is written by its own tasks, none is collected.
    """
    base = f"{folder.rstrip('/')}/{name}"
    metrics = performance(daily, benchmark=benchmark).first().asDict()  # one row
    _csv(daily.orderBy("date"), f"{base}_portfolio_daily")
    _csv(trades.withColumn("return %", F.round(F.col("ret") * 100, 2)).drop("ret").orderBy(F.desc("return %"), "ticker", "buy_date"), f"{base}_trades")
    _csv(positions.drop("ret").orderBy("buy_date", "ticker"), f"{base}_open_positions")
    _text(daily, f"{name}: performance", metrics, f"{base}_metrics")
    if config:
        _text(daily, f"{name}: configuration", config, f"{base}_config")
    return metrics
