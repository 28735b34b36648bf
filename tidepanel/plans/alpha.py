"""Pipelines: factors to portfolio, backtests over weights, walk-forward runs, universes and their configuration."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.factors import compute_factor
from tidepanel.operators import portfolio, validation
from tidepanel.operators.combination import combine_factors
from tidepanel.operators.returns import daily_returns, ic_series, next_day_returns
from tidepanel.operators.sizing import sizing_methods
from tidepanel.operators.trades import Strategy

_universes: dict[str, dict[str, str]] = {}


def register_universe(name: str, sectors: dict[str, str]) -> None:
    """Registers ticker -> sector under a case-insensitive name."""
    _universes[name.upper()] = dict(sectors)


def list_universes() -> list[str]:
    return sorted(_universes)


def get_universe(name: str) -> dict[str, str]:
    if name.upper() not in _universes:
        raise KeyError(f"Unknown universe {name!r}")
    return _universes[name.upper()]


def universe_frame(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame(sorted(get_universe(name).items()), "ticker string, sector string")


@dataclass
class FactorSpec:
    name: str
    direction: int = 1
    params: dict = field(default_factory=dict)


@dataclass
class AlphaConfig:
    """One run: factors, preprocessing, combination, legs, sizing, rebalancing.  ``n_short`` decides the mode."""

    factors: list[FactorSpec] = field(default_factory=lambda: [FactorSpec("momentum"), FactorSpec("vol_ratio")])
    winsorize_pct: float = 0.01
    method: str = "zscore"
    neutralize: tuple[str, ...] = ()
    combination: str = "equal"
    n_long: int = 10
    n_short: int = 10
    sizing: str = "Equal-Weight"
    rebalance_every: int = 5
    cost_bps: float = 0.0

    def __post_init__(self) -> None:
        self.factors = [f if isinstance(f, FactorSpec) else FactorSpec(**f) if isinstance(f, dict) else FactorSpec(str(f)) for f in self.factors]
        self.neutralize = tuple(self.neutralize)
        if not self.factors:
            raise ValueError("no factors")
        if self.n_long < 0 or self.n_short < 0 or self.n_long + self.n_short == 0:
            raise ValueError("n_long and n_short must not be negative, nor both 0")

    @property
    def portfolio_mode(self) -> str:
        return "long_short" if self.n_short else "long_only"

    def to_dict(self) -> dict:
        return asdict(self) | {"neutralize": list(self.neutralize)}

    @classmethod
    def from_dict(cls, values: dict) -> AlphaConfig:
        unknown = set(values) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        return cls(**values)

    def to_yaml(self) -> str:
        import yaml

        return yaml.safe_dump(self.to_dict(), sort_keys=False)

    @classmethod
    def from_yaml(cls, text: str) -> AlphaConfig:
        import yaml

        return cls.from_dict(yaml.safe_load(text))


def build_signal(bars: DataFrame, config: AlphaConfig, sectors: DataFrame | None = None) -> DataFrame:
    """The combined, direction-adjusted factor."""
    signals = []
    for f in config.factors:
        s = compute_factor(f.name, bars, f.params, sectors=sectors, winsorize_pct=config.winsorize_pct, method=config.method, neutralize=config.neutralize)
        signals.append(s.withColumn("value", F.col("value") * f.direction) if f.direction != 1 else s)
    series = None
    if config.combination != "equal":
        ahead = next_day_returns(daily_returns(bars))
        series = [ic_series(s, ahead, "next_day_return", least=2) for s in signals]
    return combine_factors(signals, config.combination, series).where("value is not null")


def run_alpha(bars: DataFrame, config: AlphaConfig, sectors: DataFrame | None = None, part: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(weights, daily tracking) of one configuration, planned lazily; dates of different parts stay apart."""
    returns = daily_returns(bars)
    methods = sizing_methods(config.n_long, config.n_short, bars, returns)
    weights = portfolio.resample_weights(methods[config.sizing](build_signal(bars, config, sectors)), config.rebalance_every, part)
    return weights, portfolio.track(weights, next_day_returns(returns), config.cost_bps, part=part)


def compare(results: dict[str, DataFrame]) -> DataFrame:
    """Performance of several daily portfolios, a row each."""
    out = None
    for name, daily in results.items():
        row = portfolio.performance(daily).select(F.lit(name).alias("name"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def run_strategies(bars: DataFrame, strategies: dict[str, Strategy], benchmark: DataFrame | None = None) -> tuple[dict[str, tuple[DataFrame, DataFrame, DataFrame]], DataFrame]:
    """Every strategy's (daily, closed trades, open positions), and a row of performance for each."""
    results = {name: s.run(bars) for name, s in strategies.items()}
    out = None
    for name, (daily, _, _) in results.items():
        row = portfolio.performance(daily, benchmark=benchmark).select(F.lit(name).alias("name"), "*")
        out = row if out is None else out.unionByName(row)
    return results, out


def keyed_by_part(placed: DataFrame) -> DataFrame:
    """Bars placed by fold and split, their dates and tickers keyed by the part: windows by ticker or date stay within it."""
    part = (F.col("fold") * 2 + (F.col("split") == "oos").cast("int")).alias("part")
    return placed.withColumns({"date": F.struct(part, F.col("date")), "ticker": F.struct(part, F.col("ticker"))}).drop("fold", "split")


def walk_forward(bars: DataFrame, config: AlphaConfig, n_dates: int, train: int, test: int, embargo: int = 5, anchored: bool = False) -> DataFrame:
    """(fold, split, n_days, sharpe, annual_return, annual_volatility): every fold's two parts, each run on its own bars.

    All parts are one plan keyed by part, whatever their number.  Combinations
    weighted by IC need weights of each part, so there the parts are a union
    of plans.  A part without returns has 0 days and NULLs.
    """
    folds = validation.folds_frame(bars.sparkSession, validation.walk_forward_folds(n_dates, train, test, embargo, anchored))
    placed = validation.split_by_folds(bars, F.broadcast(folds))
    if config.combination == "equal" or len(config.factors) == 1:
        _, daily = run_alpha(keyed_by_part(placed), config, part="date.part")
        daily = daily.select(F.col("date.part").alias("part"), "portfolio_return")
    else:
        daily = None
        for row in folds.collect():  # a row per fold
            for k, split in enumerate(("is", "oos")):
                own = placed.where((F.col("fold") == row.fold) & (F.col("split") == split)).drop("fold", "split")
                found = run_alpha(own, config)[1].select(F.lit(row.fold * 2 + k).alias("part"), "portfolio_return")
                daily = found if daily is None else daily.unionByName(found)
    mean, std = F.avg("portfolio_return"), F.stddev_samp("portfolio_return")
    year = F.lit(252.0)
    found = daily.groupBy("part").agg(
        F.count(F.lit(1)).alias("n_days"), (mean / F.nullif(std, F.lit(0.0)) * F.sqrt(year)).alias("sharpe"),
        (mean * year).alias("annual_return"), (std * F.sqrt(year)).alias("annual_volatility"),
    )
    parts = folds.select("fold", F.posexplode(F.array(F.lit("is"), F.lit("oos"))).alias("k", "split")).withColumn("part", F.col("fold") * 2 + F.col("k"))
    return parts.join(found, "part", "left").select("fold", "split", F.coalesce("n_days", F.lit(0)).alias("n_days"), "sharpe", "annual_return", "annual_volatility")


def sharpe_decay(parts: DataFrame) -> DataFrame:
    """Mean Sharpe ratios in and out of sample, the deviation of the latter, and how much is lost; parts without one do not count."""
    inside, outside = (F.when(F.col("split") == s, F.col("sharpe")) for s in ("is", "oos"))
    return parts.agg(
        F.count_distinct("fold").alias("n_folds"), F.avg(inside).alias("is_sharpe_mean"), F.avg(outside).alias("oos_sharpe_mean"),
        F.stddev_samp(outside).alias("oos_sharpe_std"), (F.avg(inside) - F.avg(outside)).alias("sharpe_decay"),
    )
