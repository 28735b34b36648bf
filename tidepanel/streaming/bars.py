"""Streams: bars from ticks, activity sessions, and low-volume periods with state per ticker."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def stream_bars(ticks: DataFrame, width: str = "5 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """OHLCV bars of (ticker, timestamps, price, size); a bar closes when the watermark passes its end."""
    window = F.window("timestamps", width, slide) if slide else F.window("timestamps", width)
    grouped = ticks.withWatermark("timestamps", late).groupBy("ticker", window.alias("w")).agg(
        F.min_by("price", "timestamps").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "timestamps").alias("close"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("transactions"),
    )
    return grouped.select("ticker", F.col("w.start").alias("timestamps"), "open", "high", "low", "close", "volume", "transactions")


def stream_sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Bursts of activity: (ticker, start, end, ticks), ended by a gap."""
    grouped = ticks.withWatermark("timestamps", late).groupBy("ticker", F.session_window("timestamps", gap).alias("w")).agg(F.count(F.lit(1)).alias("ticks"))
    return grouped.select("ticker", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "ticks")


class LowVolumeTracker(StatefulProcessor):
    """Emits each run of low-volume days when it closes; the open run is the state.

    Rows of one micro-batch are ordered by date; a row not later than the last
    one seen is ignored.
    """

    def __init__(self, threshold: float, min_days: int = 1):
        self.threshold, self.min_days = threshold, min_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", "start date, last date, seen date, days bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        start, last, seen, days = self.state.get() if self.state.exists() else (None, None, None, 0)
        closed = []
        for row in pd.concat(list(rows)).sort_values("date").itertuples():
            date: dt.date = row.date
            if seen is not None and date <= seen:
                continue
            seen = date
            if row.volume <= self.threshold:
                start, last, days = start or date, date, days + 1
            elif days:
                if days >= self.min_days:
                    closed.append((key[0], start, last, days, "closed"))
                start, last, days = None, None, 0
        self.state.update((start, last, seen, days))
        yield pd.DataFrame(closed, columns=["ticker", "period_start", "period_end", "duration_days", "status"])

    def close(self) -> None:
        pass


def stream_low_volume(bars: DataFrame, threshold: float, min_days: int = 1) -> DataFrame:
    """Closed low-volume periods of a stream of (ticker, date, volume)."""
    return bars.select("ticker", "date", "volume").groupBy("ticker").transformWithStateInPandas(
        LowVolumeTracker(threshold, min_days), "ticker string, period_start date, period_end date, duration_days bigint, status string", "Append", "None"
    )
