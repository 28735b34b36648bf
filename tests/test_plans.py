"""Walk-forward parts keyed in one plan, several strategies, exports."""

import datetime

import pytest

from tidepanel.operators import risk, trades, validation
from tidepanel.plans import alpha
from tidepanel.sources import exports, panels

SF = "/root/testdata/sf0.001"


def test_keyed_parts_equal_parts_run_alone(spark):
    bars = panels.weekly_bars(spark, SF).cache()
    config = alpha.AlphaConfig(n_long=3, n_short=3, sizing="Inverse-Vol", rebalance_every=4, cost_bps=5.0)
    n = bars.select("date").distinct().count()
    got = {(r.fold, r.split): r for r in alpha.walk_forward(bars, config, n, 130, 90, 5).collect()}
    folds = validation.walk_forward_folds(n, 130, 90, 5)
    assert set(got) == {(f.fold, s) for f in folds for s in ("is", "oos")}
    placed = validation.split_by_folds(bars, validation.folds_frame(spark, folds[:1]))
    for split in ("is", "oos"):
        _, daily = alpha.run_alpha(placed.where(f"split = '{split}'").drop("fold", "split"), config)
        own = [r.portfolio_return for r in daily.collect()]
        mean = sum(own) / len(own)
        assert got[0, split].n_days == len(own) and got[0, split].annual_return == pytest.approx(mean * 252)
    bars.unpersist()


def test_parts_without_returns_and_the_decay(spark):
    first = datetime.date(2020, 1, 1)
    bars = spark.createDataFrame([(t, first + datetime.timedelta(d), 10.0 + d, 1) for t in "AB" for d in range(30)], "ticker string, date date, close double, volume bigint")
    parts = alpha.walk_forward(bars, alpha.AlphaConfig(factors=["momentum"], n_long=1, n_short=1), 30, 10, 10, 0)
    assert [(r.n_days, r.sharpe) for r in parts.collect()] == [(0, None)] * 4
    assert alpha.sharpe_decay(parts).first().sharpe_decay is None
    known = spark.createDataFrame([(0, "is", 2.0), (0, "oos", 1.0), (1, "is", 4.0), (1, "oos", None)], "fold int, split string, sharpe double")
    assert alpha.sharpe_decay(known).first().asDict() == {"n_folds": 2, "is_sharpe_mean": 3.0, "oos_sharpe_mean": 1.0, "oos_sharpe_std": None, "sharpe_decay": 2.0}


def test_strategies_and_exports(spark, tmp_path):
    bars = panels.weekly_bars(spark, SF)
    results, table = alpha.run_strategies(bars, {"a": trades.BbiBollStrategy(40, -0.01, 0.005), "b": trades.BbiBollStrategy(80, -0.02, 0.01)})
    assert sorted(r.name for r in table.collect()) == ["a", "b"]
    daily, closed, opened = results["a"]
    metrics = exports.export_backtest(str(tmp_path), "a", daily, closed, opened, {"max_dev_pct": 40})
    assert metrics["n"] == daily.count() == spark.read.csv(str(tmp_path / "a_portfolio_daily"), header=True).count()
    back = spark.read.csv(str(tmp_path / "a_trades"), header=True, inferSchema=True)
    assert back.count() == closed.count() and "return %" in back.columns and "ret" not in back.columns
    assert spark.read.csv(str(tmp_path / "a_open_positions"), header=True).count() == opened.count()
    assert [r.value for r in spark.read.text(str(tmp_path / "a_config")).collect()][-1] == "max_dev_pct: 40"
    assert any(r.value.startswith("sharpe: ") for r in spark.read.text(str(tmp_path / "a_metrics")).collect())


def test_qq_data(spark):
    from statistics import NormalDist, mean, stdev

    values = [0.03, -0.01, 0.02, -0.04, 0.0]
    got = sorted(tuple(r) for r in risk.qq_data(spark.createDataFrame([(v,) for v in values], "r double")).collect())
    want = [(NormalDist().inv_cdf((i + 0.5) / 5), (v - mean(values)) / stdev(values)) for i, v in enumerate(sorted(values))]
    assert [x for r in got for x in r] == pytest.approx([x for r in want for x in r])
