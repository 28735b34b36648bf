"""Registered queries use all of their tables."""

import pytest

from tidepanel.operators import validation
from tidepanel.plans import alpha, catalogue
from tidepanel.sources import panels

SF = "/root/testdata/sf0.01"


def test_identity_groups_of_all_customers(spark):
    keys = [r.c_custkey for r in panels.table(spark, SF, "customer").select("c_custkey").collect()]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for k in keys:
        for f in [f"n{k // 3}"] + [f"m{k % 97}"] * (k % 4 == 0):
            root[find(f"t{k}")] = find(f)
    groups = {}
    for k in keys:
        groups.setdefault(find(f"t{k}"), []).append(str(k))
    want = sorted((x, min(g)) for g in groups.values() for x in g)
    got = sorted(tuple(r) for r in catalogue.identity_groups(spark, SF).select("ticker", "group_id").collect())
    assert len(keys) > 300 and got == want


def test_walkforward_panel_reaches_the_last_date(spark):
    dates = sorted(r.date for r in panels.weekly_bars(spark, SF).select("date").distinct().collect())
    got = {(r.fold, r.split, r.date) for r in catalogue.walkforward_panel(spark, SF).select("fold", "split", "date").distinct().collect()}
    folds = validation.walk_forward_folds(len(dates), 52, 26, 2)
    assert {d for _, _, d in got} >= {dates[-1]}
    assert got == {(f.fold, s, d) for f in folds for s, a, b in (("is", f.train_start, f.train_end), ("oos", f.test_start, f.test_end)) for d in dates[a:b]}


def test_walk_forward_gets_the_number_of_dates(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(alpha, "walk_forward", lambda bars, config, n, *rest: seen.append((bars.select("date").distinct().count(), n)) or spark.createDataFrame([], "sharpe double, annual_return double, annual_volatility double"))
    catalogue.walk_forward(spark, SF)
    assert seen and seen[0][0] == seen[0][1]


def test_bootstrap_has_the_default_replicates(spark):
    got = catalogue.bootstrap_sharpe(spark, SF).collect()[0]
    want = validation.bootstrap_sharpe(catalogue._daily(spark, SF), n_boot=10_000).collect()[0]
    assert got.asDict() == pytest.approx(want.asDict())
