"""Trade-based backtests: signal state machine, trade matching, holdings and trade statistics."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.factors import bbiboll
from tidepanel.operators.cross_section import ratio
from tidepanel.operators.joins import asof_join, range_join


def state_machine(bars: DataFrame, max_dev_pct: int = 1, stop_loss: float = -0.1, take_profit: float = 0.2) -> DataFrame:
    """(ticker, date, signal): buy when flat and dev_pct is at most the limit; sell on loss with dev_pct above it, or on profit.

    The state runs along a ticker's sorted bars in one fold; the next bar's
    open against the buying close decides.
    """
    rows = F.array_sort(F.collect_list(F.struct("date", "open", "close", "dev_pct")))
    grouped = bars.where("dev_pct is not null").groupBy("ticker").agg(rows.alias("rows"))
    start = F.struct(F.lit(None).cast("double").alias("held"), F.array().cast("array<struct<date:date,signal:int>>").alias("out"))

    def step(s, x):
        change = x["open"] / F.nullif(s["held"], F.lit(0.0)) - 1
        sell = s["held"].isNotNull() & (((change < stop_loss) & (x["dev_pct"] > max_dev_pct)) | (change > take_profit))
        buy = s["held"].isNull() & (x["dev_pct"] <= max_dev_pct)
        signal = F.when(buy, 1).when(sell, -1)
        held = F.when(buy, x["close"]).when(sell, F.lit(None).cast("double")).otherwise(s["held"])
        put = F.array(F.struct(x["date"].alias("date"), signal.alias("signal")))
        return F.struct(held.alias("held"), F.when(signal.isNotNull(), F.concat(s["out"], put)).otherwise(s["out"]).alias("out"))

    signals = grouped.select("ticker", F.explode(F.aggregate("rows", start, step, lambda s: s["out"])).alias("s"))
    return signals.select("ticker", "s.date", "s.signal")


def match_trades(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Round trips and open positions: each buy with the next sell of its ticker (NULLs while open)."""
    buys = signals.where("signal = 1").select("ticker", F.col("date").alias("buy_date"))
    sells = signals.where("signal = -1").select("ticker", F.col("date").alias("sell_date"))
    pairs = asof_join(buys, sells, "ticker", "buy_date", "sell_date")
    close = bars.select("ticker", F.col("date").alias("buy_date"), F.col("close").alias("buy_price"))
    opened = bars.select("ticker", F.col("date").alias("sell_date"), F.col("open").alias("sell_open"))
    out = pairs.join(close, ["ticker", "buy_date"]).join(opened, ["ticker", "sell_date"], "left")
    return out.withColumn("ret", ratio(F.col("sell_open"), F.col("buy_price")) - 1)


def daily_holdings(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """(date, n_positions, portfolio_return): mean return of the open trades of each date, 0 on others."""
    last = F.coalesce("sell_date", F.lit("9999-12-31").cast("date"))
    spans = trades.select("ticker", F.monotonically_increasing_id().alias("trade"), "buy_date", last.alias("last"))
    held = range_join(bars.select("ticker", "date", "close"), spans, "ticker", "date", "buy_date", "last")
    before = F.lag("close").over(Window.partitionBy("ticker", "buy_date").orderBy("date"))
    moved = held.withColumn("r", ratio(F.col("close"), before) - 1).where("r is not null")
    daily = moved.groupBy("date").agg(F.count(F.lit(1)).alias("n_positions"), F.avg("r").alias("portfolio_return"))
    calendar = bars.select("date").distinct()
    return calendar.join(daily, "date", "left").na.fill(0)


def trade_statistics(trades: DataFrame) -> DataFrame:
    """Counts, win rate, best, worst, mean win and loss, holding days, profit factor, expectancy of closed trades."""
    r = F.col("ret")
    win, loss = F.when(r > 0, r), F.when(r <= 0, r)
    days = F.datediff("sell_date", "buy_date")
    return trades.where(r.isNotNull()).agg(
        F.count(r).alias("n_trades"), ratio(F.count(win).cast("double"), F.count(r).cast("double")).alias("win_rate"),
        F.max(r).alias("best"), F.min(r).alias("worst"), F.avg(win).alias("avg_win"), F.avg(loss).alias("avg_loss"),
        F.avg(days).alias("avg_days"), ratio(F.sum(win), -F.sum(loss)).alias("profit_factor"), F.avg(r).alias("expectancy"),
    )


def position_status(positions: DataFrame) -> DataFrame:
    """Open positions with ``delisted`` dates (array of text): the last of these, Active or Delisted, and days held."""
    dates = F.filter(F.transform("delisted", lambda x: F.to_date(F.try_to_timestamp(x))), lambda d: d.isNotNull())
    out = positions.withColumn("last_delisted", F.array_max(dates))
    gone = F.col("last_delisted").isNotNull() & (F.col("last_delisted") <= F.col("backtest_date"))
    end = F.when(gone, F.col("last_delisted")).otherwise(F.col("backtest_date"))
    return out.withColumns({"status": F.when(gone, "Delisted").otherwise("Active"), "hold_days": F.datediff(end, "buy_date")})


def status_counts(positions: DataFrame, by: str = "backtest_date") -> DataFrame:
    """Per date: positions, those active and delisted, and their mean days held."""
    status = position_status(positions)
    gone = F.col("status") == "Delisted"
    return status.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_positions"), F.count(F.when(~gone, 1)).alias("n_active"), F.count(F.when(gone, 1)).alias("n_delisted"), F.avg("hold_days").alias("avg_hold_days"),
    )


class Strategy(ABC):
    """Indicators -> signals -> trades -> daily portfolio, always of one shape; optionally over a risk-free rate."""

    @abstractmethod
    def indicators(self, bars: DataFrame) -> DataFrame: ...

    @abstractmethod
    def signals(self, bars: DataFrame) -> DataFrame: ...

    def run(self, bars: DataFrame, risk_free: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(daily portfolio, closed trades, open positions)."""
        trades = match_trades(self.signals(self.indicators(bars)), bars)
        daily = daily_holdings(trades, bars)
        if risk_free is not None:
            daily = daily.join(risk_free.select("date", "rate"), "date", "left").withColumn("portfolio_return", F.col("portfolio_return") - F.coalesce("rate", F.lit(0.0))).drop("rate")
        return daily, trades.where("sell_date is not null"), trades.where("sell_date is null")


class BbiBollStrategy(Strategy):
    def __init__(self, max_dev_pct: int = 1, stop_loss: float = -0.1, take_profit: float = 0.2):
        self.rules = (max_dev_pct, stop_loss, take_profit)

    def indicators(self, bars: DataFrame) -> DataFrame:
        return bbiboll(bars)

    def signals(self, bars: DataFrame) -> DataFrame:
        return state_machine(bars, *self.rules)
