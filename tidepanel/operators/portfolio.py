"""Rebalancing, portfolio returns, turnover and the portfolio tracker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidepanel.functions.costs import CostModel
from tidepanel.operators.cross_section import ratio


def by_date(part: str | None = None) -> WindowSpec:
    """Over one row per date; over those of each ``part`` (a column or field), if one is named."""
    return (Window.partitionBy(part) if part else Window).orderBy("date")


def so_far(part: str | None = None) -> WindowSpec:
    return by_date(part).rowsBetween(Window.unboundedPreceding, 0)


def resample_weights(weights: DataFrame, every: int = 5, part: str | None = None) -> DataFrame:
    """Keeps the weights of every n-th date (of each part) and repeats them until the next."""
    if every <= 1:
        return weights
    dates = weights.select("date").distinct().withColumn("i", F.row_number().over(by_date(part)) - 1)
    base = F.last(F.when(F.col("i") % every == 0, F.col("date")), ignorenulls=True).over(so_far(part))
    mapping = dates.select(F.col("date").alias("to"), base.alias("date"))
    return weights.join(mapping, "date").select(F.col("to").alias("date"), "ticker", "weight")


def portfolio_return(weights: DataFrame, returns: DataFrame, ret: str = "next_day_return") -> DataFrame:
    joined = weights.join(returns, ["date", "ticker"])
    return joined.groupBy("date").agg(F.sum(F.col("weight") * F.col(ret)).alias("portfolio_return"))


def turnover(weights: DataFrame, first_zero: bool = False, part: str | None = None) -> DataFrame:
    """Half the sum of absolute weight changes per date, without the first date of each part (or with 0 there).

    Each weight counts for its date and, negated, for the next, together with
    that date's number; one aggregation replaces the comparison of days.
    """
    dates = weights.select("date").distinct().select("date", F.lead("date").over(by_date(part)).alias("next"), F.row_number().over(by_date(part)).alias("i"))
    now = F.struct(F.col("date").alias("d"), F.col("weight").alias("w"), F.col("i"))
    then = F.struct(F.col("next").alias("d"), (-F.col("weight")).alias("w"), (F.col("i") + 1).alias("i"))
    moves = weights.join(dates, "date").select("ticker", F.explode(F.array(now, then)).alias("m"))
    moves = moves.where("m.d is not null").select(F.col("m.d").alias("date"), "ticker", F.col("m.w").alias("weight"), F.col("m.i").alias("i"))
    changed = moves.groupBy("date", "ticker").agg(F.sum("weight").alias("d"), F.max("i").alias("i"))
    out = changed.groupBy("date").agg((F.sum(F.abs("d")) / 2).alias("turnover"), F.max("i").alias("i"))
    if first_zero:
        return out.select("date", F.when(F.col("i") == 1, 0.0).otherwise(F.col("turnover")).alias("turnover"))
    return out.where("i > 1").select("date", "turnover")


def weight_diagnostics(weights: DataFrame) -> DataFrame:
    w = F.col("weight")
    return weights.groupBy("date").agg(
        F.sum(w).alias("net"), F.sum(F.abs(w)).alias("gross"), F.sum(F.when(w > 0, w).otherwise(0.0)).alias("long"),
        F.sum(F.when(w < 0, w).otherwise(0.0)).alias("short"), F.max(F.abs(w)).alias("max_weight"), F.count(F.lit(1)).alias("n"),
    )


def equity(ret: str = "portfolio_return", part: str | None = None) -> Column:
    return F.product(1 + F.coalesce(F.col(ret), F.lit(0.0))).over(so_far(part))


def track(weights: DataFrame, returns: DataFrame, cost_bps: float = 0.0, ret: str = "next_day_return", part: str | None = None) -> DataFrame:
    """Daily portfolio: gross and net return, turnover, equity and position counts."""
    w = F.col("weight")
    daily = weights.join(returns, ["date", "ticker"], "left").groupBy("date").agg(
        F.sum(w * F.col(ret)).alias("gross_return"), F.sum((F.abs(w) > 1e-8).cast("int")).alias("n_positions"),
        F.sum((w > 1e-8).cast("int")).alias("n_long"), F.sum((w < -1e-8).cast("int")).alias("n_short"),
    ).where("gross_return is not null")
    daily = daily.join(turnover(weights, first_zero=True, part=part), "date")
    daily = daily.withColumn("cost", F.col("turnover") * F.lit(cost_bps / 1e4)).withColumn("portfolio_return", F.col("gross_return") - F.col("cost"))
    return daily.withColumn("equity_curve", equity(part=part))


def performance(daily: DataFrame, periods: int = 252, ddof: int = 0, benchmark: DataFrame | None = None) -> DataFrame:
    """Total and annual return, volatility, Sharpe, Sortino, Calmar, Omega, drawdown and its longest run, as one row.

    ``ddof`` 0 is the analyser's convention, 1 the pipeline's.  A ``benchmark`` (date, value) adds its return
    between the first and the last date that both have, and the excess of the portfolio's total return over it.
    """
    curve = daily.withColumn("e", equity()).withColumn("peak", F.max("e").over(so_far()))
    curve = curve.withColumns({"dd": F.col("e") / F.col("peak") - 1, "run": F.sum((F.col("e") >= F.col("peak")).cast("int")).over(so_far())})
    curve = curve.withColumn("length", F.count(F.when(F.col("dd") < 0, 1)).over(Window.partitionBy("run")))
    r = F.col("portfolio_return")
    std = (F.stddev_pop if ddof == 0 else F.stddev_samp)(r)
    down = F.stddev_pop(F.when(r < 0, r)) if ddof == 0 else F.stddev_samp(F.when(r < 0, r))
    year = F.lit(float(periods))
    row = curve.agg(
        F.min("date").alias("start"), F.max("date").alias("end"), F.count(r).alias("n"),
        (F.max_by("e", "date") - 1).alias("total_return"), (F.avg(r) * year).alias("annual_return"), (std * F.sqrt(year)).alias("annual_volatility"),
        (ratio(F.avg(r), std) * F.sqrt(year)).alias("sharpe"), (ratio(F.avg(r), down) * F.sqrt(year)).alias("sortino"),
        (-F.min("dd")).alias("max_drawdown"), ratio(F.sum(F.greatest(r, F.lit(0.0))), F.sum(F.greatest(-r, F.lit(0.0)))).alias("omega"),
        F.coalesce(F.max("length"), F.lit(0)).alias("max_drawdown_days"),
    )
    row = row.withColumn("calmar", ratio(F.col("annual_return"), F.col("max_drawdown")))
    if benchmark is None:
        return row
    own = daily.select("date").join(benchmark, "date").agg((ratio(F.max_by("value", "date"), F.min_by("value", "date")) - 1).alias("benchmark_return"))
    return row.crossJoin(own).withColumn("excess_return", F.col("total_return") - F.col("benchmark_return"))  # one row each


def monthly_returns(daily: DataFrame) -> DataFrame:
    return daily.groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg((F.product(1 + F.col("portfolio_return")) - 1).alias("ret"))


def monthly_table(daily: DataFrame) -> DataFrame:
    return monthly_returns(daily).groupBy("year").pivot("month", list(range(1, 13))).agg(F.first("ret"))


def relative_to_first(prices: DataFrame, price: str = "close") -> DataFrame:
    """A benchmark's value relative to its first."""
    return prices.select("date", ratio(F.col(price), F.first(price).over(by_date().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("value"))


def net_returns(gross: DataFrame, moved: DataFrame, model: CostModel, value: float = 1.0) -> DataFrame:
    """(date, gross_return, cost, net_return) under a cost model, for a portfolio worth ``value``; cost is a share of it."""
    traded = F.abs(F.coalesce("turnover", F.lit(0.0))) * F.lit(float(value))
    both = gross.join(moved, "date", "left").select("date", F.col("portfolio_return").alias("gross_return"), (model.cost(traded) / F.lit(float(value))).alias("cost"))
    return both.withColumn("net_return", F.col("gross_return") - F.col("cost"))


def half_years(daily: DataFrame, ret: str = "portfolio_return", periods: int = 252) -> DataFrame:
    """(year, half, n, sharpe, total_return): how stable a portfolio is over sub-periods."""
    r = F.col(ret)
    half = F.ceil(F.month("date") / F.lit(6)).cast("int")
    return daily.where(r.isNotNull()).groupBy(F.year("date").alias("year"), half.alias("half")).agg(
        F.count(r).alias("n"), (ratio(F.avg(r), F.stddev_samp(r)) * F.sqrt(F.lit(float(periods)))).alias("sharpe"), (F.product(1 + r) - 1).alias("total_return"),
    )


def cost_curve(gross: DataFrame, moved: DataFrame, levels: tuple[float, ...] = (0, 1, 2, 5, 10, 15, 20, 30, 50, 75, 100), periods: int = 252) -> DataFrame:
    """Net Sharpe and annual return at each cost level; (date, portfolio_return) and (date, turnover) are aligned by date."""
    both = gross.join(moved, "date", "left").withColumn("bps", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    net = F.col("portfolio_return") - F.coalesce("turnover", F.lit(0.0)) * F.col("bps") / 1e4
    mean, std = F.avg(net), F.stddev_samp(net)
    year = F.lit(float(periods))
    return both.groupBy("bps").agg((ratio(mean, std) * F.sqrt(year)).alias("sharpe"), (mean * year).alias("annual_return"))


def breakeven_cost(gross: DataFrame, moved: DataFrame, most: float = 200.0) -> DataFrame:
    """Cost in basis points at which the mean net return is 0; 0 if the gross mean is not positive."""
    both = gross.join(moved, "date", "left").agg(F.avg("portfolio_return").alias("g"), F.avg(F.coalesce("turnover", F.lit(0.0))).alias("t"))
    root = F.least(F.coalesce(ratio(F.col("g"), F.col("t")) * 1e4, F.lit(most)), F.lit(most))
    return both.select(F.when(F.col("g") > 0, root).otherwise(0.0).alias("breakeven_bps"))
