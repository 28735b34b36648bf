"""Time-series operators: one window partition per ticker, full windows only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidepanel.operators.cross_section import ratio


def by_ticker(date: str = "date", ticker: str = "ticker") -> WindowSpec:
    return Window.partitionBy(ticker).orderBy(date)


def trailing(n: int, date: str = "date", ticker: str = "ticker") -> WindowSpec:
    return by_ticker(date, ticker).rowsBetween(1 - n, 0)


def rolling(agg: Callable[[Column], Column], x: Column, n: int, w: WindowSpec) -> Column:
    """``agg`` over the last ``n`` rows if all of these have a value."""
    return F.when(F.count(x).over(w) == n, agg(x).over(w))


def delay(x: Column, d: int, w: WindowSpec) -> Column:
    return F.lag(x, d).over(w)


def delta(x: Column, d: int, w: WindowSpec) -> Column:
    return x - F.lag(x, d).over(w)


def signed_power(x: Column, a: float) -> Column:
    return F.signum(x) * F.pow(F.abs(x), F.lit(float(a)))


def ts_corr(x: Column, y: Column, n: int, w: WindowSpec) -> Column:
    """Pearson correlation over full windows of pairs; NULL if a side is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w)
    return F.when(F.count(a).over(w) == n, ratio(F.covar_pop(a, b).over(w), spread))


def _ts_place(x: Column, n: int, w: WindowSpec, best: Callable[[Column], Column]) -> Column:
    values = F.collect_list(x).over(w)
    return F.when(F.count(x).over(w) == n, (F.array_position(values, best(x).over(w)) - 1).cast("double"))


def ts_argmax(x: Column, n: int, w: WindowSpec) -> Column:
    """0-based place of the first greatest value in a full window."""
    return _ts_place(x, n, w, F.max)


def ts_argmin(x: Column, n: int, w: WindowSpec) -> Column:
    return _ts_place(x, n, w, F.min)


def ts_rank(x: Column, n: int, w: WindowSpec) -> Column:
    """Share of a full window's values that the current one reaches."""
    values = F.collect_list(x).over(w)
    return F.when(F.count(x).over(w) == n, F.size(F.filter(values, lambda v: v <= x)) / F.lit(float(n)))


def decay_linear(x: Column, n: int, w: WindowSpec) -> Column:
    """Mean of a full window with weights 1..n, the current row weighing most."""
    values = F.collect_list(x).over(w)
    weighted = F.aggregate(F.transform(values, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return F.when(F.count(x).over(w) == n, weighted / F.lit(n * (n + 1) / 2.0))
