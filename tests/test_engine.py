"""Exact cases, invariants and error paths of the panel engine."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidepanel.functions import costs, factors
from tidepanel.operators import combination, cross_section, dataprep, joins, portfolio, returns, risk, sizing, trades, validation
from tidepanel.plans import alpha
from tidepanel.sources import files, storage
from tidepanel.streaming import bars as streams

D = dt.date


def days(n, start=D(2024, 1, 2)):
    out, d = [], start
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += dt.timedelta(days=1)
    return out


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def signal(spark, rows):
    return frame(spark, rows, "date date, ticker string, value double")


def got(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def test_next_day_shift(spark):
    df = frame(spark, [(d, "A", r) for d, r in zip(days(3), (0.01, 0.02, 0.03), strict=True)], "date date, ticker string, daily_return double")
    assert [r.next_day_return for r in returns.next_day_returns(df).orderBy("date").collect()] == [0.02, 0.03]


def test_known_p_values(spark):
    df = frame(spark, [(str(i), p) for i, p in enumerate((0.001, 0.01, 0.03, 0.10, 0.50))], "label string, p double")
    out = validation.corrections(df).orderBy("p").toPandas()
    assert np.allclose(out.bonferroni, [0.005, 0.05, 0.15, 0.5, 1.0])
    assert np.allclose(out.holm, [0.005, 0.04, 0.09, 0.2, 0.5])
    assert np.allclose(out.bh, [0.005, 0.025, 0.05, 0.125, 0.5])
    assert (out.bonferroni_significant.sum(), out.holm_significant.sum(), out.bh_significant.sum()) == (1, 2, 3)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(0.0001, 1), min_size=1, max_size=12))
def test_corrections_are_ordered(spark, ps):
    out = validation.corrections(frame(spark, [(str(i), p) for i, p in enumerate(ps)], "label string, p double")).toPandas()
    assert (out.bh <= out.holm + 1e-12).all() and (out.holm <= out.bonferroni + 1e-12).all()


def test_drawdown(spark):
    rows = [(d, -0.01 if 100 <= i < 110 else 0.0) for i, d in enumerate(days(252))]
    daily = frame(spark, rows, "date date, portfolio_return double")
    assert risk.drawdowns(daily, "portfolio_return").agg(F.min("drawdown")).first()[0] == pytest.approx(0.99**10 - 1)
    assert portfolio.performance(daily).first().max_drawdown_days == 152


def test_var_of_a_uniform_series(spark):
    df = spark.range(10_001).select((F.col("id") / 50_000.0 - 0.1).alias("r"))
    row = risk.tail_table(df, (0.95,)).first()
    assert row.var_historical == pytest.approx(0.09) and row.cvar_historical == pytest.approx(0.095, abs=1e-4)


def test_moments_are_bias_corrected(spark):
    x = [0.1, -0.2, 0.05, 0.3, -0.1, 0.0]
    row = risk.moments(frame(spark, [(v,) for v in [*x, float("nan"), float("inf"), None]], "r double")).first()
    a, n = np.array(x), len(x)
    g1 = ((a - a.mean()) ** 3).mean() / a.std() ** 3
    g2 = ((a - a.mean()) ** 4).mean() / a.std() ** 4 - 3
    assert row.n == n and row.skewness == pytest.approx(g1 * np.sqrt(n * (n - 1)) / (n - 2))
    assert row.kurtosis == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def test_shapiro_wilk_tells_normal_from_skewed():
    rng = np.random.default_rng(1)
    assert risk.shapiro_wilk(rng.normal(size=300))[1] > 0.05
    assert risk.shapiro_wilk(rng.exponential(size=300))[1] < 1e-6


def test_cross_section_edges(spark):
    d = D(2024, 1, 2)
    df = signal(spark, [(d, "A", 1.0), (d, "B", 1.0), (d, "C", 3.0), (d, "D", float("nan")), (d, "E", None), (D(2024, 1, 3), "A", 5.0)])
    out = {(r.date.day, r.ticker): r.value for r in cross_section.preprocess_factor(df, winsorize_pct=0, method="rank").collect()}
    assert out == {(2, "A"): -0.5, (2, "B"): -0.5, (2, "C"): 1.0, (3, "A"): None}
    z = cross_section.preprocess_factor(df).where("date = '2024-01-02'").agg(F.avg("value"), F.stddev_samp("value")).first()
    assert z[0] == pytest.approx(0) and z[1] == pytest.approx(1)
    for bad in ({"method": "x"}, {"neutralize": ("sector",)}, {"neutralize": ("size",)}):
        with pytest.raises(ValueError):
            cross_section.preprocess_factor(df, **bad)


def test_winsorize_clips_outliers(spark):
    df = signal(spark, [(D(2024, 1, 2), f"T{i:03}", 1e6 if i == 99 else float(i)) for i in range(100)])
    assert cross_section.winsorize(df, 0.05).agg(F.max("value"), F.min("value")).first()[:] == (94.0, 5.0)


def test_equal_weights_pick_the_ends(spark):
    rows = [(d, t, base + 10.0 * i) for d, base in zip(days(2), (10, 15), strict=True) for i, t in enumerate("ABCDEF")]
    w = sizing.size_equal_weight(signal(spark, rows), 2, 0)
    assert {(r.ticker, r.weight) for r in w.collect()} == {("E", 0.5), ("F", 0.5)}
    both = sizing.size_equal_weight(signal(spark, rows), 2, 1).groupBy("date").agg(F.sum(F.abs("weight"))).collect()
    assert all(r[1] == pytest.approx(1.0) for r in both)
    with pytest.raises(ValueError):
        sizing.size_equal_weight(signal(spark, rows), 0, 0)


def test_inverse_volatility_has_gross_one(spark):
    rows = [(d, t, float(i)) for d in days(2) for i, t in enumerate("ABCDEF")]
    vol = frame(spark, [(d, t, 0.01 * (i + 1)) for d in days(2) for i, t in enumerate("ABCDEF")], "date date, ticker string, volatility double")
    w = sizing.size_inverse_volatility(signal(spark, rows), vol, 2, 2).groupBy("date").agg(F.sum(F.abs("weight")).alias("g")).collect()
    assert all(r.g == pytest.approx(1.0) for r in w)
    t = sizing.size_volatility_target(signal(spark, rows), vol, 2, 2, max_leverage=0.5).groupBy("date").agg(F.sum(F.abs("weight")).alias("g")).collect()
    assert all(r.g <= 0.5 + 1e-9 for r in t)


def test_turnover_and_rebalance(spark):
    equal = frame(spark, [(d, t, 0.1) for d in days(6) for t in "ABCDEFGHIJ"], "date date, ticker string, weight double")
    assert {r.turnover for r in portfolio.turnover(equal).collect()} == {0.0}
    assert portfolio.turnover(equal, first_zero=True).count() == 6
    flip = frame(spark, [(d, "AB"[i % 2], 1.0) for i, d in enumerate(days(5))], "date date, ticker string, weight double")
    assert [r.turnover for r in portfolio.turnover(flip).orderBy("date").collect()] == [1.0] * 4
    held = portfolio.resample_weights(flip, 2)
    assert [r.ticker for r in held.orderBy("date").collect()] == list("AAAAA")
    assert portfolio.resample_weights(flip, 1) is flip


def test_tracker_charges_turnover(spark):
    w = frame(spark, [(d, "AB"[i % 2], 1.0) for i, d in enumerate(days(3))], "date date, ticker string, weight double")
    r = frame(spark, [(d, t, 0.01) for d in days(3) for t in "AB"], "date date, ticker string, next_day_return double")
    out = portfolio.track(w, r, 10.0).orderBy("date").collect()
    assert [round(x.portfolio_return, 9) for x in out] == [0.01, 0.009, 0.009]
    assert out[-1].equity_curve == pytest.approx(1.01 * 1.009 * 1.009)


def test_cost_models(spark):
    row = spark.range(1).select(
        costs.FixedCost(10).cost(F.lit(-1000.0)).alias("a"), costs.SqrtImpactCost().cost(F.lit(5e7)).alias("b"),
        costs.SqrtImpactCost().cost(F.lit(5e7), F.lit(0.0)).alias("c"), costs.CompositeCost([costs.FixedCost(1), costs.SpreadCost(1)]).cost(F.lit(1e4)).alias("d"),
    ).first()
    assert row.a == pytest.approx(1.0) and row.b == pytest.approx(5e7 * 0.1 * 0.02) and row.c == 0.0 and row.d == pytest.approx(2.0)
    for bad in (lambda: costs.FixedCost(-1), lambda: costs.CompositeCost([])):
        with pytest.raises(ValueError):
            bad()


def test_cost_curve_falls_and_meets_zero_at_the_breakeven(spark):
    g = frame(spark, [(d, 0.001 + 0.002 * (-1) ** i) for i, d in enumerate(days(50))], "date date, portfolio_return double")
    t = frame(spark, [(d, 0.2) for d in days(50)], "date date, turnover double")
    curve = [r.sharpe for r in portfolio.cost_curve(g, t).orderBy("bps").collect()]
    assert curve == sorted(curve, reverse=True)
    assert portfolio.breakeven_cost(g, t).first()[0] == pytest.approx(50.0)


def test_combination(spark):
    rng = random.Random(1)
    sig = [signal(spark, [(d, t, rng.random()) for d in days(5) for t in "ABC"]) for _ in range(2)]
    ic = [frame(spark, [(d, m + 0.1 * rng.random()) for d in days(20)], "date date, ic double") for m in (0.2, -0.5)]
    assert combination.weights("ic", ic, 2) == [1.0, 0.0]
    assert sum(combination.weights("risk_parity", ic, 2)) == pytest.approx(1)
    assert combination.combine_factors(sig[:1]) is sig[0]
    assert combination.combine_factors(sig).count() == 15
    for bad in (lambda: combination.combine_factors([]), lambda: combination.weights("x", ic, 2), lambda: combination.weights("ic", None, 2)):
        with pytest.raises(ValueError):
            bad()


def test_walk_forward_folds():
    folds = validation.walk_forward_folds(504, 126, 63, 5)
    assert len(folds) >= 3 and all(a.test_end <= b.test_start for a, b in zip(folds, folds[1:], strict=False))
    assert all(f.test_start - f.train_end == 5 and f.train_size == 126 for f in folds)
    assert {f.train_start for f in validation.walk_forward_folds(504, 126, 63, 5, anchored=True)} == {0}
    with pytest.raises(ValueError):
        validation.walk_forward_folds(100, 126, 63)


def test_sharpe_tests(spark):
    rng = np.random.default_rng(42)
    df = frame(spark, [(d, float(x)) for d, x in zip(days(252), rng.normal(0.001, 0.01, 252), strict=True)], "date date, portfolio_return double")
    stats = validation.sharpe_statistics(df)
    assert 0 < validation.probabilistic_sharpe(stats)["psr"] < 1
    assert validation.deflated_sharpe(stats, 20)["dsr"] < validation.deflated_sharpe(stats, 1)["dsr"]
    short = validation.sharpe_statistics(df.limit(5))
    assert validation.sharpe_pvalue(short)["n_obs"] == 5 and validation.sharpe_pvalue(short)["p_value"] == 1.0
    a, b = (validation.bootstrap_sharpe(df, n_boot=300).first() for _ in range(2))
    assert a == b and a.low < a.sharpe < a.high


def test_asof_against_brute_force(spark):
    rng = random.Random(7)
    left = [(rng.choice("ab"), rng.randint(0, 30), i) for i in range(80)]
    right = sorted({(rng.choice("ab"), rng.randint(0, 30)) for _ in range(25)})
    lf = frame(spark, left, "k string, t int, i int")
    rf = frame(spark, [(k, t, t * 10) for k, t in right], "k string, u int, v int")
    for forward in (True, False):
        out = {r.i: r.u for r in joins.asof_join(lf, rf, "k", "t", "u", forward).collect()}
        for k, t, i in left:
            near = [u for kk, u in right if kk == k and (u >= t if forward else u <= t)]
            assert out[i] == ((min if forward else max)(near) if near else None)


def test_identity_and_alignment(spark):
    over = frame(
        spark,
        [("A", "CS", "f1", None, None, "2020-01-01", True), ("B", "CS", "f1", "s1", None, "2021-01-01", True), ("C", "CS", None, "s1", None, "2022-01-01", True), ("Z", "ETF", None, None, None, "2022-01-01", True)],
        "ticker string, type string, composite_figi string, share_class_figi string, delisted_utc string, last_updated_utc string, active boolean",
    )
    mapped = dataprep.mapped_tickers(over)
    assert {(r.ticker, r.group_id, r.latest_ticker, tuple(r.tickers)) for r in mapped.collect()} == {(t, "A", "C", ("A", "B", "C")) for t in "ABC"} | {("Z", "Z", "Z", ("Z",))}
    d = days(6)
    bars = frame(spark, [(t, x, 1.0) for t in "ABCQ" for x in d], "ticker string, date date, close double")
    ends = frame(spark, [("A", d[1]), ("B", d[3]), ("C", d[5])], "ticker string, last_date date")
    out = dataprep.align_tickers(bars, mapped, ends)
    assert got(out.groupBy("ticker").count(), "ticker") == [("C", 6), ("Q", 6)]


def test_splits(spark):
    d = days(4)
    bars = frame(spark, [("A", x, 100.0, 100.0, 100.0, 100.0, 10) for x in d], "ticker string, date date, open double, high double, low double, close double, volume bigint")
    splits = frame(spark, [("A", str(d[2]), 1.0, 2.0), ("A", str(d[0]), 1.0, 10.0), ("A", "2030-01-01", 1.0, 5.0)], "ticker string, execution_date string, split_from double, split_to double")
    out = dataprep.adjust_splits(bars, splits).orderBy("date").collect()
    assert [(r.close, r.volume) for r in out] == [(50.0, 20), (50.0, 20), (100.0, 10), (100.0, 10)]


def test_gap_fill_stays_within_a_ticker(spark):
    d = days(5)
    bars = frame(spark, [("A", d[0], 1.0, 5), ("A", d[3], 2.0, 6), ("B", d[2], 9.0, 7)], "ticker string, date date, close double, volume bigint")
    out = got(dataprep.fill_gaps(bars, dataprep.weekday_calendar(spark, str(d[0]), str(d[4]))), "ticker", "date")
    assert out == [("A", d[0], 1.0, 5), ("A", d[1], 1.0, 0), ("A", d[2], 1.0, 0), ("A", d[3], 2.0, 6), ("B", d[2], 9.0, 7)]


def test_sessions_and_timeframes(spark):
    times = ["03:59", "04:00", "09:29", "09:30", "15:59", "16:00", "19:59", "20:00"]
    df = frame(spark, [(f"2024-01-02 {t}:00",) for t in times], "s string").select(F.to_timestamp("s").alias("t"))
    names = [r[0] for r in df.select("t", dataprep.session(F.col("t")).alias("n")).orderBy("t").select("n").collect()]
    assert names == ["other", "premarket", "premarket", "regular", "regular", "afterhours", "afterhours", "other"]
    starts = {f: str(frame(spark, [("2024-08-15 10:47:00",)], "s string").select(dataprep.bar_start(F.to_timestamp("s"), f)).first()[0]) for f in ("30m", "1h", "1w", "1mo", "1q", "1y")}
    assert starts == {"30m": "2024-08-15 10:30:00", "1h": "2024-08-15 10:30:00", "1w": "2024-08-12 00:00:00", "1mo": "2024-08-01 00:00:00", "1q": "2024-07-01 00:00:00", "1y": "2024-01-01 00:00:00"}
    with pytest.raises(ValueError):
        dataprep.bar_start(F.col("t"), "5x")


def test_calendar_minutes_and_dates(spark):
    cal = frame(spark, [(D(2024, 7, 2), False), (D(2024, 7, 3), True)], "date date, half_day boolean")
    assert got(dataprep.calendar_minutes(cal).groupBy("date").count(), "date") == [(D(2024, 7, 2), 960), (D(2024, 7, 3), 600)]
    week = dataprep.weekday_calendar(spark, "2024-01-01", "2024-01-31")
    assert tuple(dataprep.sessions_from(week, "2024-01-06", 3).first()) == (D(2024, 1, 8), D(2024, 1, 10))
    assert dataprep.backtest_dates(spark, "2024-01-01", "2024-03-01", "monthly").count() == 3


def test_state_machine_and_trades(spark):
    rows = [("A", x, o, c, p) for x, (o, c, p) in zip(days(6), [(10.0, 10.0, 5), (10.0, 10.0, 1), (10.5, 10.0, 5), (13.0, 13.0, 5), (13.0, 12.0, 1), (11.0, 11.0, 1)], strict=True)]
    bars = frame(spark, rows, "ticker string, date date, open double, close double, dev_pct int")
    sig = trades.state_machine(bars)
    d = days(6)
    assert got(sig, "date") == [("A", d[1], 1), ("A", d[3], -1), ("A", d[4], 1)]
    out = trades.match_trades(sig, bars).orderBy("buy_date").collect()
    assert [(r.buy_date, r.sell_date) for r in out] == [(d[1], d[3]), (d[4], None)] and out[0].ret == pytest.approx(0.3)
    none = trades.match_trades(sig.limit(0), bars)
    assert none.count() == 0 and trades.trade_statistics(none).first().n_trades == 0
    assert trades.daily_holdings(none, bars).count() == 6


def test_position_status(spark):
    rows = [("A", [], D(2024, 1, 1), D(2024, 2, 1)), ("B", ["2024-01-10T00:00:00Z", "bad"], D(2024, 1, 1), D(2024, 2, 1)), ("C", ["2025-01-01"], D(2024, 1, 1), D(2024, 2, 1))]
    out = trades.position_status(frame(spark, rows, "ticker string, delisted array<string>, buy_date date, backtest_date date"))
    assert [(r.ticker, r.status, r.hold_days) for r in out.orderBy("ticker").collect()] == [("A", "Active", 31), ("B", "Delisted", 9), ("C", "Active", 31)]


def test_files(spark, tmp_path):
    p = tmp_path / "day_aggs-2024-01-02.csv"
    p.write_text("ticker,volume,open,close,high,low,window_start,transactions,extra\nA,10,1,2,3,0.5,1704207600000000000,3,x\nB,N/A,1,2,3,0.5,1704207600000000000,3,y\nC,1,2\n")
    df = files.read_csv(spark, str(p))
    rows = {r.ticker: r for r in df.collect()}
    assert set(rows) == {"A", "B"} and rows["B"].volume is None and rows["A"].extra == "x" and df.schema["open"].dataType.simpleString() == "float"
    files.convert_to_parquet(spark, [str(p)], str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert files.file_facts(back).first().rows == 2
    assert str(files.with_timestamps(back).first().timestamps) == "2024-01-02 15:00:00"
    assert files.detect_kind("x.csv", ["Ticker", "bid_price"]) == "quotes" and files.detect_kind("x.csv", ["price"]) == "trades"
    assert files.paths_in_range(["a/2024-01-01.csv", "a/2024-02-01.csv"], "2024-01-15", "2024-03-01") == ["a/2024-02-01.csv"]
    assert files.folder_facts(spark, str(tmp_path), "*.csv").first().files == 1


def test_result_cache(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert storage.cached_result(spark, str(tmp_path), {"a": 1, "b": D(2024, 1, 1)}, compute).count() == 3
    assert len(calls) == 1 and storage.result_key({"a": 1}) != storage.result_key({"a": 2})


def test_upsert_and_overview(spark):
    old, new = frame(spark, [(1, "a"), (2, "b")], "k int, v string"), frame(spark, [(2, "c"), (3, "d")], "k int, v string")
    assert got(joins.upsert(old, new, ["k"]), "k") == [(1, "a"), (2, "c"), (3, "d")]
    over = frame(spark, [("A", 1), ("B", 2)], "ticker string, n int")
    out = files.correct_overview(over, over.where("ticker = 'A'"), frame(spark, [("C",)], "ticker string"))
    assert got(out, "ticker") == [("B", 2), ("C", None)]


def test_registry_universe_and_config(spark):
    assert {"momentum", "vol_ratio", "bbiboll", "alpha001", "alpha002", "alpha003"} <= set(factors.list_factors())
    assert factors.get_factor("MOMENTUM") is factors.momentum
    with pytest.raises(KeyError):
        factors.get_factor("nope")
    alpha.register_universe("Two", {"A": "Tech", "B": "Fin"})
    assert alpha.get_universe("two") == {"A": "Tech", "B": "Fin"} and alpha.universe_frame(spark, "TWO").count() == 2
    with pytest.raises(KeyError, match="Unknown universe"):
        alpha.get_universe("none")
    config = alpha.AlphaConfig(factors=["momentum", {"name": "str", "direction": -1}], n_short=0)
    assert config.portfolio_mode == "long_only" and alpha.AlphaConfig.from_dict(config.to_dict()) == config
    with pytest.raises(ValueError):
        alpha.AlphaConfig.from_dict({"x": 1})


def test_streamed_low_volume_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(t, d, rng.choice([1, 100])) for t in "AB" for d in days(40)] + [(t, D(2025, 1, 1), 100) for t in "AB"]
    spark.createDataFrame(rows, "ticker string, date date, volume bigint").coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema("ticker string, date date, volume bigint").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = streams.stream_low_volume(live, 10).writeStream.format("memory").queryName("low").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = dataprep.low_volume_periods(spark.read.parquet(str(tmp_path / "in")), 10).where("status = 'closed'")
    assert got(spark.table("low"), "ticker", "period_start") == got(batch, "ticker", "period_start")


def test_streamed_bars_equal_batch(spark, tmp_path):
    rows = [("A", dt.datetime(2024, 1, 2, 10, m, s), float(m), 1) for m in range(20) for s in (0, 30)] + [("A", dt.datetime(2024, 1, 3), 1.0, 1)]
    spark.createDataFrame(rows, "ticker string, timestamps timestamp, price double, size bigint").coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema("ticker string, timestamps timestamp, price double, size bigint").parquet(str(tmp_path / "in"))
    for name, df in (("bars", streams.stream_bars(live)), ("bursts", streams.stream_sessions(live))):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    out = spark.table("bars").orderBy("timestamps").collect()
    assert [(r.open, r.close, r.volume) for r in out] == [(5.0 * i, 5.0 * i + 4, 10) for i in range(4)]
    assert [r.ticks for r in spark.table("bursts").collect()] == [40]
