"""Registered queries of the engine and the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.functions import costs
from tidepanel.functions import factors as fac
from tidepanel.operators import combination, dataprep, joins, portfolio, returns, risk, sizing, trades, validation
from tidepanel.operators import cross_section as cs
from tidepanel.operators import time_series as ts
from tidepanel.plans import alpha
from tidepanel.sources import files, panels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# --- SQL fragments of the oracles
BARS_W = """px AS (SELECT p_brand AS ticker, date_trunc('week', l_shipdate)::DATE AS date, 1000 + sqrt(l_extendedprice / l_quantity) AS p, l_quantity AS q,
  row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem JOIN part ON l_partkey = p_partkey),
bars AS (SELECT ticker, date, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, sum(q)::BIGINT AS volume, count(*) AS transactions FROM px GROUP BY 1, 2)"""
BARS_M = BARS_W.replace("p_brand AS ticker", "l_suppkey::VARCHAR AS ticker").replace("'week'", "'month'").replace(" JOIN part ON l_partkey = p_partkey", "")
SECTORS = "sectors AS (SELECT s_suppkey::VARCHAR AS ticker, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
RET = """ret AS (SELECT * FROM (SELECT date, ticker, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS daily_return FROM bars) WHERE daily_return IS NOT NULL)"""
NXT = """nxt AS (SELECT * FROM (SELECT date, ticker, lead(daily_return) OVER (PARTITION BY ticker ORDER BY date) AS next_day_return FROM ret) WHERE next_day_return IS NOT NULL)"""
FWD = "fwd AS (SELECT date, ticker, " + ", ".join(f"lead(close, {h}) OVER w / close - 1 AS f{h}" for h in (1, 5, 10, 20)) + " FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date))"


def mom(n: int = 20) -> str:
    return f"sig AS (SELECT * FROM (SELECT date, ticker, ln(close / lag(close, {n}) OVER (PARTITION BY ticker ORDER BY date)) AS value FROM bars) WHERE value IS NOT NULL)"


ZS = "zs AS (SELECT date, ticker, (value - avg(value) OVER d) / nullif(stddev_samp(value) OVER d, 0) AS value FROM sig WINDOW d AS (PARTITION BY date))"
VOL_RATIO = """vr AS (SELECT date, ticker, a / nullif(b, 0) AS value FROM (SELECT date, ticker,
   CASE WHEN count(r) OVER s = 5 THEN stddev_samp(r) OVER s END AS a, CASE WHEN count(r) OVER l = 20 THEN stddev_samp(r) OVER l END AS b
   FROM (SELECT *, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS r FROM bars)
   WINDOW s AS (PARTITION BY ticker ORDER BY date ROWS 4 PRECEDING), l AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)) WHERE a / nullif(b, 0) IS NOT NULL)"""


def sides(source: str, n: int = 5) -> str:
    return f"""sd AS (SELECT *, CASE WHEN u <= {n} THEN -1 WHEN c - u + 1 <= {n} THEN 1 ELSE 0 END AS side FROM (
  SELECT *, row_number() OVER (PARTITION BY date ORDER BY value, ticker) AS u, count(*) OVER (PARTITION BY date) AS c FROM {source} WHERE value IS NOT NULL))"""


EW = "w AS (SELECT date, ticker, side / 10.0::DOUBLE AS weight FROM sd WHERE side <> 0)"
VOLA = """vola AS (SELECT date, ticker, CASE WHEN count(r) OVER l = 20 THEN stddev_samp(r) OVER l END AS volatility
   FROM (SELECT *, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS r FROM bars) WINDOW l AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING))"""
INV = """iv AS (SELECT date, ticker, g AS sigma, side * (1 / g) / sum(1 / g) OVER (PARTITION BY date) AS weight
   FROM (SELECT sd.date, sd.ticker, side, greatest(volatility, 1e-8) AS g FROM sd JOIN vola USING (date, ticker) WHERE side <> 0 AND volatility IS NOT NULL))"""
PR = "pr AS (SELECT date, sum(weight * next_day_return) AS portfolio_return FROM w JOIN nxt USING (date, ticker) GROUP BY date)"
DATES = "dates AS (SELECT date, lead(date) OVER (ORDER BY date) AS nx, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM w))"
TURN = """turn AS (SELECT t.date, i, turnover FROM (SELECT date, sum(abs(d)) / 2 AS turnover FROM (SELECT date, ticker, sum(x) AS d FROM (
   SELECT date, ticker, weight AS x FROM w UNION ALL SELECT nx, ticker, -weight FROM w JOIN dates USING (date) WHERE nx IS NOT NULL) GROUP BY 1, 2) GROUP BY 1) t JOIN dates ON t.date = dates.date)"""
SIGNAL_W = f"{BARS_W}, {RET}, {NXT}, {mom()}, {ZS}, {sides('zs')}, {EW}"


def ranks(x: str, y: str) -> str:
    def one(c: str) -> str:
        return f"rank() OVER (PARTITION BY date ORDER BY {c}) + (count(*) OVER (PARTITION BY date, {c}) - 1) / 2.0::DOUBLE"

    return f"{one(x)} AS rx, {one(y)} AS ry"


def ic_sql(signal: str, target: str, least: int) -> str:
    return f"""SELECT date, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS ic FROM (
  SELECT date, {ranks('value', 'y')} FROM (SELECT s.date, value, {target} AS y FROM {signal} s JOIN fwd f ON s.date = f.date AND s.ticker = f.ticker WHERE value IS NOT NULL AND {target} IS NOT NULL))
  GROUP BY date HAVING count(*) >= {least} AND covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) IS NOT NULL"""


STATS = "coalesce(avg(ic), 0) AS mean_ic, coalesce(stddev_samp(ic), 0) AS std_ic, coalesce(avg(ic) / nullif(stddev_samp(ic), 0), 0) AS ir, coalesce(avg(ic) / nullif(stddev_samp(ic), 0), 0) * sqrt(count(ic)) AS t_stat, coalesce(avg(CASE WHEN ic > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 0) AS hit_rate, count(ic) AS n"
# ---


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle."""
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Reductions and transcendental values to ``digits`` places; ``+ 0.0`` turns -0.0 into 0.0."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def folds_sql(train: int, test: int, embargo: int) -> str:
    """Folds over the numbered dates ``dd`` and their parts ``p``, as half-open ranges."""
    t, e = f"i * {test} + {train + embargo}", f"least(i * {test} + {train + embargo + test}, n)"
    return f"""f AS (SELECT i::INTEGER AS fold, {t} AS t, {e} AS e FROM range(10000) r(i), (SELECT count(*) AS n FROM dd) WHERE {t} < n AND {e} - ({t}) >= {max(1, test // 2)}),
p AS (SELECT fold, 'is' AS split, t - {train + embargo} AS a, t - {embargo} AS b FROM f UNION ALL SELECT fold, 'oos', t, e FROM f)"""


def wrap(ctes: str, body: str, keep: str, *columns: str) -> str:
    return f"WITH {ctes} SELECT {keep}{', ' if keep and columns else ''}{', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in columns)} FROM ({body})"


def _momentum(spark: SparkSession, d: str, bars: DataFrame | None = None) -> DataFrame:
    return fac.momentum(bars if bars is not None else panels.weekly_bars(spark, d)).where("value is not null")


def _weights(spark: SparkSession, d: str) -> DataFrame:
    return sizing.size_equal_weight(cs.zscore(_momentum(spark, d)), 5, 5)


def _next(spark: SparkSession, d: str) -> DataFrame:
    return returns.next_day_returns(returns.daily_returns(panels.weekly_bars(spark, d)))


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.portfolio_return(_weights(spark, d), _next(spark, d))


@query(wrap(f"{SIGNAL_W}, {PR}", "SELECT * FROM pr", "date", "portfolio_return"))
def portfolio_return(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_daily(spark, d), "portfolio_return")


@query(f"WITH {BARS_W} SELECT * FROM bars")
def bars_weekly(spark: SparkSession, d: str) -> DataFrame:
    return panels.weekly_bars(spark, d)


@query(f"WITH {BARS_M} SELECT * FROM bars")
def bars_monthly(spark: SparkSession, d: str) -> DataFrame:
    return panels.monthly_bars(spark, d)


@query(f"WITH {BARS_W}, {RET} SELECT * FROM ret")
def daily_returns(spark: SparkSession, d: str) -> DataFrame:
    return returns.daily_returns(panels.weekly_bars(spark, d))


@query(f"WITH {BARS_W}, {RET}, {NXT} SELECT * FROM nxt")
def next_day_returns(spark: SparkSession, d: str) -> DataFrame:
    return _next(spark, d)


@query(f"WITH {BARS_W}, {FWD} SELECT date, ticker, f1 AS forward_return_1d, f5 AS forward_return_5d, f10 AS forward_return_10d, f20 AS forward_return_20d FROM fwd")
def forward_returns(spark: SparkSession, d: str) -> DataFrame:
    return returns.forward_returns(panels.weekly_bars(spark, d))


@query("WITH " + BARS_W + " SELECT date, ticker, " + ", ".join(f"round(ln(lead(close, {h}) OVER w / close), 6) + 0.0 AS log_forward_return_{h}d" for h in (1, 5, 10, 20)) + " FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)")
def log_forward_returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(returns.log_forward_returns(panels.weekly_bars(spark, d)), *[f"log_forward_return_{h}d" for h in (1, 5, 10, 20)])


WINSOR = """wz AS (SELECT date, ticker, least(greatest(value, max(CASE WHEN p = 1 + round(0.05::DOUBLE * (n - 1)) THEN value END) OVER d), max(CASE WHEN p = 1 + round(0.95::DOUBLE * (n - 1)) THEN value END) OVER d) AS value
  FROM (SELECT *, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY value) AS p FROM {src}) WINDOW d AS (PARTITION BY date))"""
VALUE_M = "sig AS (SELECT date, ticker, close - open AS value FROM bars)"


def _spread_m(spark: SparkSession, d: str) -> DataFrame:
    return panels.monthly_bars(spark, d).select("date", "ticker", (F.col("close") - F.col("open")).alias("value"))


@query(f"WITH {BARS_M}, {VALUE_M}, {WINSOR.format(src='sig')} SELECT * FROM wz")
def winsorize(spark: SparkSession, d: str) -> DataFrame:
    return cs.winsorize(_spread_m(spark, d), 0.05)


@query(wrap(f"{BARS_M}, {VALUE_M}, {ZS}", "SELECT * FROM zs", "date, ticker", "value"))
def zscore(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cs.zscore(_spread_m(spark, d)), "value")


@query(f"WITH {BARS_M}, {VALUE_M} SELECT date, ticker, (rank() OVER (PARTITION BY date ORDER BY value) + (count(*) OVER (PARTITION BY date, value) - 1) / 2.0::DOUBLE - 1) / nullif((count(*) OVER (PARTITION BY date) - 1)::DOUBLE, 0) * 2 - 1 AS value FROM sig")
def rank_norm(spark: SparkSession, d: str) -> DataFrame:
    return cs.rank_normalize(_spread_m(spark, d))


@query(wrap(f"{BARS_M}, {VALUE_M}, {SECTORS}", "SELECT date, sig.ticker, value - avg(value) OVER (PARTITION BY date, sector) AS value FROM sig LEFT JOIN sectors USING (ticker)", "date, ticker", "value"))
def sector_neutral(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cs.sector_neutralize(_spread_m(spark, d), panels.sectors(spark, d)), "value")


@query(wrap(f"{BARS_M}, {SECTORS}, {VALUE_M}, {WINSOR.format(src='sig')}, z AS (SELECT date, ticker, (value - avg(value) OVER d) / nullif(stddev_samp(value) OVER d, 0) AS value FROM wz WINDOW d AS (PARTITION BY date))",
            "SELECT date, z.ticker, value - avg(value) OVER (PARTITION BY date, sector) AS value FROM z LEFT JOIN sectors USING (ticker)", "date, ticker", "value"))
def preprocess(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cs.preprocess_factor(_spread_m(spark, d), panels.sectors(spark, d), 0.05, "zscore", ("sector",)), "value")


@query(wrap(f"{BARS_W}, {mom()}", "SELECT * FROM sig", "date, ticker", "value"))
def momentum(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_momentum(spark, d), "value")


@query(wrap(f"{BARS_W}, {VOL_RATIO}", "SELECT * FROM vr", "date, ticker", "value"))
def vol_ratio(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fac.vol_ratio(panels.weekly_bars(spark, d)).where("value is not null"), "value")


@query(f"""WITH {BARS_W} SELECT date, ticker, sum(CASE WHEN c IS NULL OR close > c THEN volume WHEN close < c THEN -volume ELSE 0 END) OVER (PARTITION BY ticker ORDER BY date)::BIGINT AS obv
  FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS c FROM bars)""")
def obv(spark: SparkSession, d: str) -> DataFrame:
    return fac.obv(panels.weekly_bars(spark, d)).select("date", "ticker", "obv")


BBI = """b AS (SELECT *, CASE WHEN count(close) OVER w24 = 24 THEN (avg(close) OVER w3 + avg(close) OVER w6 + avg(close) OVER w12 + avg(close) OVER w24) / 4 END AS bbi, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM bars
  WINDOW w3 AS (PARTITION BY ticker ORDER BY date ROWS 2 PRECEDING), w6 AS (PARTITION BY ticker ORDER BY date ROWS 5 PRECEDING), w12 AS (PARTITION BY ticker ORDER BY date ROWS 11 PRECEDING), w24 AS (PARTITION BY ticker ORDER BY date ROWS 23 PRECEDING)),
dv AS (SELECT *, CASE WHEN count(bbi) OVER w = 11 THEN stddev_pop(bbi) OVER w * 6 END AS dev FROM b WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 10 PRECEDING))"""


@query(wrap(f"{BARS_W}, {BBI}", """SELECT date, ticker, bbi, dev, bbi + dev AS upr, bbi - dev AS dwn, CASE WHEN dev IS NOT NULL AND i >= 50 THEN
   (SELECT count(*) FROM dv e WHERE e.ticker = dv.ticker AND e.i BETWEEN dv.i - 251 AND dv.i AND e.dev <= dv.dev) END AS dev_pct FROM dv""", "date, ticker, dev_pct::INTEGER AS dev_pct", "bbi", "dev", "upr", "dwn"))
def bbiboll(spark: SparkSession, d: str) -> DataFrame:
    out = fac.bbiboll(panels.weekly_bars(spark, d)).select("date", "ticker", "bbi", "dev", "upr", "dwn", "dev_pct")
    return rounded(out, "bbi", "dev", "upr", "dwn")


@query(wrap(f"{BARS_W}, {BBI}", "SELECT date, ticker, (close - bbi) / nullif(dev, 0) AS value FROM dv", "date, ticker", "value"))
def bbiboll_factor(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fac.bbiboll_factor(panels.weekly_bars(spark, d)), "value")


@query(f"""WITH {BARS_W}, m AS (SELECT *, sign(r) * pow(abs(r), 2.0) AS x FROM (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM bars)),
a AS (SELECT date, ticker, CASE WHEN count(x) OVER w = 5 THEN list_position(list(x) OVER w, max(x) OVER w) - 1 END AS a FROM m WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 4 PRECEDING))
SELECT date, ticker, CASE WHEN a IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY a NULLS FIRST) + (count(*) OVER (PARTITION BY date, a) - 1) / 2.0::DOUBLE - (count(*) OVER (PARTITION BY date) - count(a) OVER (PARTITION BY date))) / count(a) OVER (PARTITION BY date) END AS value FROM a""")
def alpha001(spark: SparkSession, d: str) -> DataFrame:
    return fac.alpha001(panels.weekly_bars(spark, d))


def pct(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0::DOUBLE) / count({x}) OVER (PARTITION BY date) END"


def corr_sql(n: int) -> str:
    return f"""SELECT date, ticker, CASE WHEN count(a) OVER w = {n} THEN -(covar_pop(a, b) OVER w / nullif(stddev_pop(a) OVER w * stddev_pop(b) OVER w, 0)) END AS value
  FROM (SELECT *, CASE WHEN y IS NOT NULL THEN x END AS a, CASE WHEN x IS NOT NULL THEN y END AS b FROM r) WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS {n - 1} PRECEDING)"""


@query(wrap(f"""{BARS_W}, v AS (SELECT date, ticker, CASE WHEN volume > 0 AND l > 0 THEN ln(volume / l) END AS dl, i FROM (SELECT *, lag(volume, 2) OVER (PARTITION BY ticker ORDER BY date) AS l, (close - open) / nullif(open, 0) AS i FROM bars)),
r AS (SELECT date, ticker, {pct('dl')} AS x, {pct('i')} AS y FROM v)""", corr_sql(6), "date, ticker", "value"))
def alpha002(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fac.alpha002(panels.weekly_bars(spark, d)), "value")


@query(wrap(f"{BARS_W}, r AS (SELECT date, ticker, {pct('open')} AS x, {pct('volume')} AS y FROM bars)", corr_sql(10), "date, ticker", "value"))
def alpha003(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fac.alpha003(panels.weekly_bars(spark, d)), "value")


@query(wrap(BARS_W, "SELECT date, ticker, -(close / nullif(lag(close, 5) OVER (PARTITION BY ticker ORDER BY date), 0) - 1) AS value FROM bars", "date, ticker", "value"))
def short_term_reversal(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fac.short_term_reversal(panels.weekly_bars(spark, d)), "value")


@query(wrap(BARS_W, """SELECT date, ticker, CASE WHEN count(volume) OVER l = 20 THEN volume / nullif(avg(volume) OVER l, 0) END * sign(close / nullif(lag(close) OVER w, 0) - 1) AS value
  FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date), l AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)""", "date, ticker", "value"))
def volume_price_divergence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fac.volume_price_divergence(panels.weekly_bars(spark, d)), "value")


MOM_M = f"{BARS_M}, {FWD}, {mom(3)}"


def _momentum_m(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    bars = panels.monthly_bars(spark, d)
    return fac.momentum(bars, 3).where("value is not null"), returns.forward_returns(bars)


@query(wrap(MOM_M, ic_sql("sig", "f1", 30), "date", "ic"))
def ic_series(spark: SparkSession, d: str) -> DataFrame:
    signal, ahead = _momentum_m(spark, d)
    return rounded(returns.ic_series(signal, ahead, "forward_return_1d"), "ic")


STAT_COLUMNS = ("mean_ic", "std_ic", "ir", "t_stat", "hit_rate")


@query(wrap(f"{MOM_M}, ic AS ({ic_sql('sig', 'f1', 5)})", f"SELECT {STATS} FROM ic", "n", *STAT_COLUMNS))
def ic_stats(spark: SparkSession, d: str) -> DataFrame:
    signal, ahead = _momentum_m(spark, d)
    return rounded(returns.ic_stats(returns.ic_series(signal, ahead, "forward_return_1d", 5)), *STAT_COLUMNS)


@query(wrap(MOM_M + "".join(f", ic{h} AS ({ic_sql('sig', f'f{h}', 5)})" for h in (1, 5, 10, 20)),
            " UNION ALL ".join(f"SELECT {h}::INTEGER AS horizon, {STATS} FROM ic{h}" for h in (1, 5, 10, 20)), "horizon, n", *STAT_COLUMNS))
def ic_decay(spark: SparkSession, d: str) -> DataFrame:
    signal, ahead = _momentum_m(spark, d)
    return rounded(returns.ic_decay(signal, ahead, least=5), *STAT_COLUMNS)


@query(wrap(f"{BARS_W}, {mom()}, k AS (SELECT date, ticker, (rank() OVER (PARTITION BY date ORDER BY value) + (count(*) OVER (PARTITION BY date, value) - 1) / 2.0::DOUBLE - 1) / nullif((count(*) OVER (PARTITION BY date) - 1)::DOUBLE, 0) * 2 - 1 AS w FROM sig), c AS (SELECT date, abs(w - lag(w) OVER (PARTITION BY ticker ORDER BY date)) AS c FROM k)",
            "SELECT date, avg(c) AS turnover, count(c) AS n_stocks FROM c GROUP BY date HAVING avg(c) IS NOT NULL", "date, n_stocks", "turnover"))
def rank_turnover(spark: SparkSession, d: str) -> DataFrame:
    return rounded(returns.rank_turnover(_momentum(spark, d)), "turnover")


@query(wrap(f"{MOM_M}, j AS (SELECT s.date, value, f1 AS y FROM sig s JOIN fwd f ON s.date = f.date AND s.ticker = f.ticker WHERE f1 IS NOT NULL), q AS (SELECT date, " + ", ".join(f"quantile_cont(value, 0.{2 * k}::DOUBLE) AS q{k}" for k in range(1, 5)) + " FROM j GROUP BY date)",
            "SELECT j.date, 1 + (value > q1)::INTEGER + (value > q2)::INTEGER + (value > q3)::INTEGER + (value > q4)::INTEGER AS bucket, avg(y) AS mean_return, count(y) AS n FROM j JOIN q ON j.date = q.date GROUP BY 1, 2", "date, bucket, n", "mean_return"))
def quantile_returns(spark: SparkSession, d: str) -> DataFrame:
    signal, ahead = _momentum_m(spark, d)
    return rounded(returns.quantile_returns(signal, ahead, "forward_return_1d"), "mean_return")


@query(wrap(f"{MOM_M}, j AS (SELECT s.date, f1 AS y, floor((row_number() OVER (PARTITION BY s.date ORDER BY value, s.ticker) - 1) * 5 / count(*) OVER (PARTITION BY s.date)) AS b FROM sig s JOIN fwd f ON s.date = f.date AND s.ticker = f.ticker WHERE f1 IS NOT NULL)",
            "SELECT date, avg(y) FILTER (b = 0) - avg(y) FILTER (b = 4) AS spread FROM j GROUP BY date", "date", "spread"))
def quantile_spread(spark: SparkSession, d: str) -> DataFrame:
    signal, ahead = _momentum_m(spark, d)
    return rounded(returns.quantile_spread(signal, ahead, "forward_return_1d"), "spread")


TWO = f"{BARS_W}, {FWD}, {mom()}, {ZS}, {VOL_RATIO}, vz AS (SELECT date, ticker, (value - avg(value) OVER d) / nullif(stddev_samp(value) OVER d, 0) AS value FROM vr WINDOW d AS (PARTITION BY date))"


def _two(spark: SparkSession, d: str) -> tuple[list[DataFrame], list[DataFrame]]:
    bars = panels.weekly_bars(spark, d)
    ahead = returns.forward_returns(bars)
    signals = [cs.zscore(_momentum(spark, d, bars)), cs.zscore(fac.vol_ratio(bars).where("value is not null"))]
    return signals, [returns.ic_series(s, ahead, "forward_return_1d", 2) for s in signals]


def _combined(method: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        signals, series = _two(spark, d)
        return rounded(combination.combine_factors(signals, method, series).where("value is not null"), "value")

    return run


def combined_sql(weights: str) -> str:
    ics = f"ic1 AS ({ic_sql('zs', 'f1', 2)}), ic2 AS ({ic_sql('vz', 'f1', 2)}), n1 AS (SELECT ic, row_number() OVER (ORDER BY date) AS i FROM ic1), n2 AS (SELECT ic, row_number() OVER (ORDER BY date) AS i FROM ic2)"
    moments = "mm AS (SELECT avg(a.ic) AS m1, avg(b.ic) AS m2, stddev_samp(a.ic) AS s1, stddev_samp(b.ic) AS s2, covar_samp(a.ic, b.ic) AS c FROM n1 a JOIN n2 b USING (i))"
    return wrap(f"{TWO}, {ics}, {moments}, rw AS ({weights}), ww AS (SELECT CASE WHEN a + b <= 1e-12 THEN 0.5::DOUBLE ELSE a / (a + b) END AS wa, CASE WHEN a + b <= 1e-12 THEN 0.5::DOUBLE ELSE b / (a + b) END AS wb FROM rw)",
                "SELECT zs.date, zs.ticker, zs.value * wa + vz.value * wb AS value FROM zs JOIN vz ON zs.date = vz.date AND zs.ticker = vz.ticker, ww WHERE zs.value * wa + vz.value * wb IS NOT NULL", "date, ticker", "value")


for _method, _sql in (
    ("equal", "SELECT 1.0::DOUBLE AS a, 1.0::DOUBLE AS b"),
    ("ic", "SELECT greatest(m1, 0.0) AS a, greatest(m2, 0.0) AS b FROM mm"),
    ("risk_parity", "SELECT CASE WHEN s1 > 1e-10 THEN 1 / s1 ELSE 0 END AS a, CASE WHEN s2 > 1e-10 THEN 1 / s2 ELSE 0 END AS b FROM mm"),
    ("mean_variance", "SELECT greatest(((s2 * s2 + 1e-6) * m1 - c * m2) / ((s1 * s1 + 1e-6) * (s2 * s2 + 1e-6) - c * c), 0.0) AS a, greatest(((s1 * s1 + 1e-6) * m2 - c * m1) / ((s1 * s1 + 1e-6) * (s2 * s2 + 1e-6) - c * c), 0.0) AS b FROM mm"),
):
    QUERIES[f"combine_{_method}"], ORACLES[f"combine_{_method}"] = _combined(_method), combined_sql(_sql)


@query(f"WITH {SIGNAL_W} SELECT * FROM w")
def size_equal(spark: SparkSession, d: str) -> DataFrame:
    return _weights(spark, d)


SIZED = f"{BARS_W}, {mom()}, {sides('sig')}, {VOLA}, {INV}"


@query(wrap(SIZED, "SELECT * FROM iv", "date, ticker", "weight"))
def size_inverse_vol(spark: SparkSession, d: str) -> DataFrame:
    bars = panels.weekly_bars(spark, d)
    return rounded(sizing.size_inverse_volatility(_momentum(spark, d, bars), sizing.realized_volatility(bars), 5, 5), "weight")


@query(wrap(SIZED, "SELECT date, ticker, weight * least(0.10::DOUBLE / sqrt(252.0::DOUBLE) / nullif(sqrt(sum(weight * weight * sigma * sigma) OVER (PARTITION BY date)), 0), 3.0::DOUBLE) AS weight FROM iv", "date, ticker", "weight"))
def size_vol_target(spark: SparkSession, d: str) -> DataFrame:
    bars = panels.weekly_bars(spark, d)
    return rounded(sizing.size_volatility_target(_momentum(spark, d, bars), sizing.realized_volatility(bars), 5, 5), "weight")


SIGNAL_SIZED = f"""zz AS (SELECT *, (value - avg(value) OVER (PARTITION BY date)) / nullif(stddev_samp(value) OVER (PARTITION BY date), 0) AS z FROM sig), {sides('zz')},
v AS (SELECT date, ticker, CASE WHEN count(daily_return) OVER l = 60 THEN var_samp(daily_return) OVER l END AS var FROM ret WINDOW l AS (PARTITION BY ticker ORDER BY date ROWS 59 PRECEDING)),
r AS (SELECT sd.date, sd.ticker, side * abs(z) / var AS raw FROM sd JOIN v ON sd.date = v.date AND sd.ticker = v.ticker WHERE side <> 0 AND var > 0 AND z IS NOT NULL),
g AS (SELECT date, ticker, least(greatest(raw / nullif(sum(abs(raw)) OVER (PARTITION BY date), 0), -0.1::DOUBLE), 0.1::DOUBLE) AS weight FROM r)"""


@query(wrap(f"{BARS_W}, {RET}, {mom()}, {SIGNAL_SIZED}", "SELECT * FROM g WHERE abs(weight) > 1e-10", "date, ticker", "weight"))
def size_signal(spark: SparkSession, d: str) -> DataFrame:
    bars = panels.weekly_bars(spark, d)
    return rounded(sizing.size_signal_weighted(_momentum(spark, d, bars), returns.daily_returns(bars), 5, 5), "weight")


@query(f"""WITH {SIGNAL_W}, dd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM w)), mp AS (SELECT a.date AS t, b.date AS f FROM dd a JOIN dd b ON b.i = a.i - a.i % 4)
SELECT t AS date, ticker, weight FROM mp JOIN w ON w.date = mp.f""")
def rebalance(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.resample_weights(_weights(spark, d), 4)


@query(wrap(f"{SIGNAL_W}, {DATES}, {TURN}", "SELECT date, turnover FROM turn WHERE i > 1", "date", "turnover"))
def turnover(spark: SparkSession, d: str) -> DataFrame:
    return rounded(portfolio.turnover(_weights(spark, d)), "turnover")


@query(wrap(SIGNAL_W, "SELECT date, sum(weight) AS net, sum(abs(weight)) AS gross, sum(CASE WHEN weight > 0 THEN weight ELSE 0 END) AS long, sum(CASE WHEN weight < 0 THEN weight ELSE 0 END) AS short, max(abs(weight)) AS max_weight, count(*) AS n FROM w GROUP BY date", "date, n", "net", "gross", "long", "short", "max_weight"))
def weight_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(portfolio.weight_diagnostics(_weights(spark, d)), "net", "gross", "long", "short", "max_weight")


TRACK_TAIL = f"""{PR}, {DATES}, {TURN}, tr AS (SELECT pr.date, pr.portfolio_return AS gross_return, CASE WHEN i = 1 THEN 0.0::DOUBLE ELSE turnover END AS turnover, pr.portfolio_return - CASE WHEN i = 1 THEN 0.0::DOUBLE ELSE turnover END * 0.0005::DOUBLE AS portfolio_return,
  n_positions, n_long, n_short FROM pr JOIN turn ON pr.date = turn.date JOIN (SELECT date, count(*) AS n_positions, count(*) FILTER (weight > 1e-8) AS n_long, count(*) FILTER (weight < -1e-8) AS n_short FROM w GROUP BY date) c ON c.date = pr.date),
eq AS (SELECT *, product(1 + portfolio_return) OVER (ORDER BY date) AS e FROM tr)"""
TRACK = f"{SIGNAL_W}, {TRACK_TAIL}"


@query(wrap(TRACK, "SELECT *, e AS equity_curve, turnover * 0.0005::DOUBLE AS cost FROM eq", "date, n_positions, n_long, n_short", "gross_return", "turnover", "cost", "portfolio_return", "equity_curve"))
def tracker(spark: SparkSession, d: str) -> DataFrame:
    return rounded(portfolio.track(_weights(spark, d), _next(spark, d), 5.0), "gross_return", "turnover", "cost", "portfolio_return", "equity_curve")


PERFORMANCE = ("total_return", "annual_return", "annual_volatility", "sharpe", "sortino", "max_drawdown", "omega", "calmar")


def performance_sql(eq: str = "eq") -> str:
    """Common tables that end in ``p``, and the row selected from it, for (date, portfolio_return, e)."""
    return f"""dn AS (SELECT *, max(e) OVER (ORDER BY date) AS peak FROM {eq}), dx AS (SELECT *, e / peak - 1 AS dd, sum((e >= peak)::INTEGER) OVER (ORDER BY date) AS run FROM dn),
p AS (SELECT min(date) AS start, max(date) AS "end", count(*) AS n, arg_max(e, date) - 1 AS total_return, avg(portfolio_return) * 252 AS annual_return, stddev_pop(portfolio_return) * sqrt(252.0::DOUBLE) AS annual_volatility,
  avg(portfolio_return) / stddev_pop(portfolio_return) * sqrt(252.0::DOUBLE) AS sharpe, avg(portfolio_return) / stddev_pop(CASE WHEN portfolio_return < 0 THEN portfolio_return END) * sqrt(252.0::DOUBLE) AS sortino,
  -min(dd) AS max_drawdown, sum(greatest(portfolio_return, 0.0)) / nullif(sum(greatest(-portfolio_return, 0.0)), 0) AS omega FROM dx)"""


PERFORMED = "SELECT *, annual_return / nullif(max_drawdown, 0) AS calmar, (SELECT coalesce(max(c), 0) FROM (SELECT count(*) AS c FROM dx WHERE dd < 0 GROUP BY run)) AS max_drawdown_days FROM p"


@query(wrap(f"{TRACK}, {performance_sql()}", PERFORMED, 'start, "end", n, max_drawdown_days', *PERFORMANCE))
def perf_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(portfolio.performance(portfolio.track(_weights(spark, d), _next(spark, d), 5.0)), *PERFORMANCE)


@query(wrap(f"{SIGNAL_W}, {PR}", "SELECT year(date)::INTEGER AS year, month(date)::INTEGER AS month, product(1 + portfolio_return) - 1 AS ret FROM pr GROUP BY 1, 2", "year, month", "ret"))
def monthly_returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(portfolio.monthly_returns(_daily(spark, d)), "ret")


@query(wrap(f"{SIGNAL_W}, {PR}, {DATES}, {TURN}, b AS (SELECT portfolio_return - CASE WHEN i = 1 THEN 0 ELSE turnover END * bps / 1e4 AS net, bps FROM pr JOIN turn ON pr.date = turn.date, (SELECT unnest([0, 1, 2, 5, 10, 15, 20, 30, 50, 75, 100])::DOUBLE AS bps))",
            "SELECT bps, avg(net) / nullif(stddev_samp(net), 0) * sqrt(252.0::DOUBLE) AS sharpe, avg(net) * 252 AS annual_return FROM b GROUP BY bps", "bps", "sharpe", "annual_return"))
def cost_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(portfolio.cost_curve(_daily(spark, d), portfolio.turnover(_weights(spark, d))), "sharpe", "annual_return")


@query(wrap(f"{SIGNAL_W}, {PR}, {DATES}, {TURN}, b AS (SELECT avg(portfolio_return) AS g, avg(CASE WHEN i = 1 THEN 0 ELSE turnover END) AS t FROM pr JOIN turn ON pr.date = turn.date)",
            "SELECT CASE WHEN g > 0 THEN least(coalesce(g / nullif(t, 0) * 1e4, 200.0::DOUBLE), 200.0::DOUBLE) ELSE 0.0::DOUBLE END AS breakeven_bps FROM b", "", "breakeven_bps"))
def breakeven(spark: SparkSession, d: str) -> DataFrame:
    return rounded(portfolio.breakeven_cost(_daily(spark, d), portfolio.turnover(_weights(spark, d))), "breakeven_bps")


@query(wrap("x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice AS v, l_quantity * 100000 AS adv FROM lineitem)",
            "SELECT *, abs(v) * 0.0005::DOUBLE + abs(v) * 0.1::DOUBLE * 0.02::DOUBLE * sqrt(abs(v) / adv) AS cost FROM x", "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate", "cost"))
def trade_costs(spark: SparkSession, d: str) -> DataFrame:
    model = costs.CompositeCost([costs.FixedCost(3), costs.SpreadCost(2), costs.SqrtImpactCost()])
    lines = panels.table(spark, d, "lineitem")
    cost = model.cost(F.col("l_extendedprice"), F.col("l_quantity") * 100000)
    return rounded(lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", cost.alias("cost")), "cost")


def _pooled(spark: SparkSession, d: str) -> DataFrame:
    return returns.daily_returns(panels.weekly_bars(spark, d)).select("date", "ticker", F.col("daily_return").alias("r"))


@query(wrap(f"{BARS_W}, {RET}, l AS (SELECT * FROM (VALUES " + ", ".join(f"({c}::DOUBLE, {risk.NORMAL.inv_cdf(1 - c)!r}::DOUBLE, {risk.NORMAL.pdf(risk.NORMAL.inv_cdf(1 - c)) / (1 - c)!r}::DOUBLE)" for c in (0.9, 0.95, 0.99)) + ") t(confidence, z, h)), s AS (SELECT avg(daily_return) AS mu, stddev_samp(daily_return) AS sd FROM ret), k AS (SELECT l.*, mu, sd, (SELECT CASE WHEN confidence = 0.9::DOUBLE THEN quantile_cont(daily_return, 0.1::DOUBLE) WHEN confidence = 0.95::DOUBLE THEN quantile_cont(daily_return, 0.05::DOUBLE) ELSE quantile_cont(daily_return, 0.01::DOUBLE) END FROM ret) AS cut FROM l, s)",
            "SELECT confidence, -cut AS var_historical, -(mu + z * sd) AS var_parametric, (SELECT -avg(daily_return) FROM ret WHERE daily_return <= cut) AS cvar_historical, -(mu - sd * h) AS cvar_parametric, -cut / nullif(-(mu + z * sd), 0) AS var_ratio FROM k", "confidence", "var_historical", "var_parametric", "cvar_historical", "cvar_parametric", "var_ratio"))
def var_cvar(spark: SparkSession, d: str) -> DataFrame:
    return rounded(risk.tail_table(_pooled(spark, d)), "var_historical", "var_parametric", "cvar_historical", "cvar_parametric", "var_ratio")


MOMENTS = ("annual_mean", "annual_volatility", "sharpe", "skewness", "kurtosis", "jarque_bera", "jarque_bera_p", "tail_ratio")


@query(f"""WITH {SIGNAL_W}, {PR}, m AS (SELECT count(*)::DOUBLE AS n, avg(portfolio_return) AS a, stddev_samp(portfolio_return) AS s, skewness(portfolio_return) AS g1, kurtosis(portfolio_return) AS g2, quantile_cont(portfolio_return, 0.05::DOUBLE) AS lo, quantile_cont(portfolio_return, 0.95::DOUBLE) AS hi FROM pr),
p AS (SELECT *, g1 * (n - 2) / sqrt(n * (n - 1)) AS b1, (g2 * (n - 2) * (n - 3) / (n - 1) - 6) / (n + 1) AS b2 FROM m), j AS (SELECT *, n / 6 * (b1 * b1 + b2 * b2 / 4) AS jb FROM p)
SELECT n::BIGINT AS n, round(a * 252, 6) AS annual_mean, round(s * sqrt(252.0::DOUBLE), 6) AS annual_volatility, round(a / s * sqrt(252.0::DOUBLE), 6) AS sharpe, round(g1, 6) AS skewness, round(g2, 6) AS kurtosis, round(jb, 6) AS jarque_bera, round(exp(-jb / 2), 6) AS jarque_bera_p, round(abs(hi) / abs(lo), 6) AS tail_ratio FROM j""")
def moments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(risk.moments(_daily(spark, d), "portfolio_return"), *MOMENTS)


@query(wrap(f"{SIGNAL_W}, {PR}, e AS (SELECT date, product(1 + portfolio_return) OVER (ORDER BY date) AS e FROM pr)", "SELECT date, e / max(e) OVER (ORDER BY date) - 1 AS drawdown FROM e", "date", "drawdown"))
def drawdown(spark: SparkSession, d: str) -> DataFrame:
    return rounded(risk.drawdowns(_daily(spark, d), "portfolio_return"), "drawdown")


@query(wrap(f"{BARS_W}, {RET}, s AS (SELECT min(daily_return) AS a, max(daily_return) AS b, count(*) AS n FROM ret), h AS (SELECT least(floor((daily_return - a) / ((b - a) / 20)), 19)::INTEGER AS bin, count(*) AS k FROM ret, s GROUP BY 1), g AS (SELECT unnest(range(20))::INTEGER AS bin)",
            "SELECT g.bin, a + g.bin * (b - a) / 20 AS low, coalesce(k, 0) / n / ((b - a) / 20) AS density FROM g CROSS JOIN s LEFT JOIN h ON g.bin = h.bin", "bin", "low", "density"))
def return_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(risk.histogram(_pooled(spark, d), 20).select("bin", "low", "density"), "low", "density")


KNOWN = [("a", 0.001), ("b", 0.01), ("c", 0.03), ("d", 0.10), ("e", 0.50)]


@query("WITH t AS (SELECT * FROM (VALUES ('a', 0.001::DOUBLE), ('b', 0.01::DOUBLE), ('c', 0.03::DOUBLE), ('d', 0.10::DOUBLE), ('e', 0.50::DOUBLE)) t(label, p)), k AS (SELECT *, count(*) OVER ()::DOUBLE AS n, row_number() OVER (ORDER BY p, label) AS k FROM t), "
       "m AS (SELECT label, p, least(p * n, 1) AS bonferroni, least(max(p * (n - k + 1)) OVER (ORDER BY k), 1) AS holm, least(min(p * n / k) OVER (ORDER BY k DESC), 1) AS bh FROM k) "
       "SELECT *, bonferroni < 0.05::DOUBLE AS bonferroni_significant, holm < 0.05::DOUBLE AS holm_significant, bh < 0.05::DOUBLE AS bh_significant FROM m")
def multiple_testing(spark: SparkSession, d: str) -> DataFrame:
    return validation.corrections(spark.createDataFrame(KNOWN, "label string, p double"))


@query(f"""WITH {SIGNAL_W}, {PR}, m AS (SELECT count(*)::DOUBLE AS n, avg(portfolio_return) / stddev_samp(portfolio_return) AS s, skewness(portfolio_return) AS g1, kurtosis(portfolio_return) AS g2 FROM pr),
p AS (SELECT *, g1 * (n - 2) / sqrt(n * (n - 1)) AS b1, (g2 * (n - 2) * (n - 3) / (n - 1) - 6) / (n + 1) AS b2 FROM m)
SELECT n::BIGINT AS n_obs, round(s * sqrt(252.0::DOUBLE), 6) AS sharpe, round(sqrt((1 + s * s / 2 - b1 * s + b2 / 4 * s * s) / n) * sqrt(252.0::DOUBLE), 6) AS se FROM p""")
def sharpe_error(spark: SparkSession, d: str) -> DataFrame:
    return rounded(validation.sharpe_statistics(_daily(spark, d)), "sharpe", "se")


@query(f"""WITH {BARS_W}, dd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM bars)), {folds_sql(52, 26, 2)}
SELECT bars.date, ticker, close, fold, split FROM bars JOIN dd ON bars.date = dd.date JOIN p ON i >= a AND i < b""")
def walkforward_panel(spark: SparkSession, d: str) -> DataFrame:
    bars = panels.weekly_bars(spark, d)
    n = bars.select("date").distinct().count()
    folds = validation.folds_frame(spark, validation.walk_forward_folds(n, 52, 26, 2))
    return validation.split_by_folds(bars.select("date", "ticker", "close"), folds)


TICKS = "t AS (SELECT event_type AS ticker, ts, value AS price, hour(ts) * 60 + minute(ts) AS m FROM events), s AS (SELECT *, CASE WHEN m >= 240 AND m < 570 THEN 'premarket' WHEN m >= 570 AND m < 960 THEN 'regular' WHEN m >= 960 AND m < 1200 THEN 'afterhours' ELSE 'other' END AS session FROM t)"


@query(f"WITH {TICKS} SELECT ticker, session, ts::DATE AS date, count(*) AS ticks, max(price) AS high, min(price) AS low FROM s GROUP BY 1, 2, 3")
def sessions(spark: SparkSession, d: str) -> DataFrame:
    t = panels.ticks(spark, d)
    return t.groupBy("ticker", dataprep.session(F.col("timestamps")).alias("session"), F.col("timestamps").cast("date").alias("date")).agg(
        F.count(F.lit(1)).alias("ticks"), F.max("price").alias("high"), F.min("price").alias("low")
    )


@query(f"WITH {TICKS}, b AS (SELECT *, CASE session WHEN 'premarket' THEN 240 WHEN 'regular' THEN 570 WHEN 'afterhours' THEN 960 ELSE 0 END AS base FROM s) SELECT ticker, date_trunc('day', ts) + to_minutes(CAST(base + floor((m - base) / 30) * 30 AS BIGINT)) AS timestamps, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, count(*) AS volume, count(*) AS transactions FROM b GROUP BY 1, 2")
def resample_30m(spark: SparkSession, d: str) -> DataFrame:
    t = panels.ticks(spark, d)
    bars = t.select("ticker", "timestamps", *[F.col("price").alias(c) for c in ("open", "high", "low", "close")], F.col("size").alias("volume"), F.col("size").alias("transactions"))
    return dataprep.resample(bars, "30m")


@query(f"""WITH {BARS_W}, c AS (SELECT DISTINCT date FROM bars), sp AS (SELECT ticker, min(date) AS a, max(date) AS b FROM bars GROUP BY 1), g AS (SELECT ticker, date FROM sp JOIN c ON date BETWEEN a AND b),
f AS (SELECT g.ticker, g.date, b.open, b.high, b.low, b.close, coalesce(volume, 0) AS volume, coalesce(transactions, 0) AS transactions, last_value(close IGNORE NULLS) OVER (PARTITION BY g.ticker ORDER BY g.date) AS lc FROM g LEFT JOIN bars b ON b.ticker = g.ticker AND b.date = g.date)
SELECT ticker, date, coalesce(open, lc) AS open, coalesce(high, lc) AS high, coalesce(low, lc) AS low, coalesce(close, lc) AS close, volume, transactions FROM f""")
def gap_fill(spark: SparkSession, d: str) -> DataFrame:
    bars = panels.weekly_bars(spark, d)
    return dataprep.fill_gaps(bars, bars.select("date").distinct())


SPLITS = [("Brand#11", "1996-06-05", 1.0, 2.0), ("Brand#11", "1999-01-13", 1.0, 4.0), ("Brand#22", "1997-03-19", 10.0, 1.0), ("Brand#33", "2030-01-01", 1.0, 2.0)]


@query(f"""WITH {BARS_W}, sv AS (SELECT * FROM (VALUES ('Brand#11', DATE '1996-06-05', 1.0::DOUBLE, 2.0::DOUBLE), ('Brand#11', DATE '1999-01-13', 1.0::DOUBLE, 4.0::DOUBLE), ('Brand#22', DATE '1997-03-19', 10.0::DOUBLE, 1.0::DOUBLE), ('Brand#33', DATE '2030-01-01', 1.0::DOUBLE, 2.0::DOUBLE)) s(ticker, x, a, b)),
sp AS (SELECT ticker, min(date) AS lo, max(date) AS hi FROM bars GROUP BY 1), f AS (SELECT sv.ticker, x - 1 AS d, product(a / b) OVER (PARTITION BY sv.ticker ORDER BY x DESC) AS f FROM sv JOIN sp ON sv.ticker = sp.ticker WHERE x >= lo - 1 AND x <= hi + 1),
j AS (SELECT bars.*, coalesce(f, 1) AS f FROM bars ASOF LEFT JOIN f ON bars.ticker = f.ticker AND bars.date <= f.d)
SELECT ticker, date, round(open * f, 4) AS open, round(high * f, 4) AS high, round(low * f, 4) AS low, round(close * f, 4) AS close, round(volume / f)::BIGINT AS volume, transactions FROM j""")
def split_adjust(spark: SparkSession, d: str) -> DataFrame:
    splits = spark.createDataFrame(SPLITS, "ticker string, execution_date string, split_from double, split_to double")
    return dataprep.adjust_splits(panels.weekly_bars(spark, d), splits)


@query("""WITH RECURSIVE e AS (SELECT c_custkey::VARCHAR AS t, 'n' || (c_custkey // 3) AS f FROM customer UNION ALL SELECT c_custkey::VARCHAR, 'm' || (c_custkey % 97) FROM customer WHERE c_custkey % 4 = 0),
p AS (SELECT DISTINCT a.t AS u, b.t AS v FROM e a JOIN e b ON a.f = b.f), r AS (SELECT u, v FROM p UNION SELECT r.u, p.v FROM r JOIN p ON r.v = p.u)
SELECT u AS ticker, min(v) AS group_id FROM r GROUP BY u""")
def identity_groups(spark: SparkSession, d: str) -> DataFrame:
    c = panels.table(spark, d, "customer")
    a = c.select(F.concat(F.lit("t:"), F.col("c_custkey")).alias("a"), F.concat(F.lit("~n"), F.floor(F.col("c_custkey") / 3)).alias("b"))
    b = c.where("c_custkey % 4 = 0").select(F.concat(F.lit("t:"), F.col("c_custkey")).alias("a"), F.concat(F.lit("~m"), F.col("c_custkey") % 97).alias("b"))
    found = joins.connected(a.unionByName(b)).where("node like 't:%'")
    return found.select(F.expr("substring(node, 3)").alias("ticker"), F.expr("substring(component, 3)").alias("group_id"))


@query(f"""WITH {BARS_W}, m AS (SELECT ticker, date, volume <= 300 AS low, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i, max(date) OVER (PARTITION BY ticker) AS last FROM bars),
r AS (SELECT *, i - row_number() OVER (PARTITION BY ticker ORDER BY date) AS run FROM m WHERE low)
SELECT ticker, min(date) AS period_start, max(date) AS period_end, count(*) AS duration_days, CASE WHEN max(date) = max(last) THEN 'ongoing' ELSE 'closed' END AS status FROM r GROUP BY ticker, run HAVING count(*) >= 2""")
def low_volume_islands(spark: SparkSession, d: str) -> DataFrame:
    return dataprep.low_volume_periods(panels.weekly_bars(spark, d), 300, 2)


@query("SELECT o_custkey, arg_max(o_orderkey, row(o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    orders = panels.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return joins.latest(orders, ["o_custkey"], F.struct("o_orderdate", "o_orderkey"))


ALTERNATE = f"alt AS (SELECT ticker, date, CASE WHEN i % 14 = 1 THEN 1 WHEN i % 14 = 8 THEN -1 END AS signal FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM bars))"
TRADES_TAIL = "tr AS (SELECT b.ticker, b.date AS buy_date, s.date AS sell_date FROM (SELECT * FROM alt WHERE signal = 1) b ASOF LEFT JOIN (SELECT * FROM alt WHERE signal = -1) s ON b.ticker = s.ticker AND b.date <= s.date), tt AS (SELECT tr.*, p.close AS buy_price, q.open AS sell_open, q.open / p.close - 1 AS ret FROM tr JOIN bars p ON p.ticker = tr.ticker AND p.date = tr.buy_date LEFT JOIN bars q ON q.ticker = tr.ticker AND q.date = tr.sell_date)"
TRADES = f"{BARS_W}, {ALTERNATE}, {TRADES_TAIL}"
HELD = """h AS (SELECT bars.date, bars.close / lag(bars.close) OVER (PARTITION BY tt.ticker, buy_date ORDER BY bars.date) - 1 AS r FROM tt JOIN bars ON bars.ticker = tt.ticker AND bars.date BETWEEN buy_date AND coalesce(sell_date, DATE '9999-12-31')), hg AS (SELECT date, count(*) AS n, avg(r) AS a FROM h WHERE r IS NOT NULL GROUP BY date),
hd AS (SELECT c.date, coalesce(n, 0) AS n_positions, coalesce(a, 0) AS portfolio_return FROM (SELECT DISTINCT date FROM bars) c LEFT JOIN hg ON hg.date = c.date)"""


def _trades(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    bars = panels.weekly_bars(spark, d)
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("ticker").orderBy("date"))
    signals = bars.select("ticker", "date", i.alias("i")).select("ticker", "date", F.when(F.col("i") % 14 == 1, 1).when(F.col("i") % 14 == 8, -1).alias("signal"))
    return trades.match_trades(signals, bars), bars


@query(f"WITH {TRADES} SELECT * FROM tt")
def trades_asof(spark: SparkSession, d: str) -> DataFrame:
    return _trades(spark, d)[0]


TRADE_STATS = ("win_rate", "best", "worst", "avg_win", "avg_loss", "avg_days", "profit_factor", "expectancy")


@query(wrap(TRADES, "SELECT count(ret) AS n_trades, count(*) FILTER (ret > 0) / count(ret) AS win_rate, max(ret) AS best, min(ret) AS worst, avg(ret) FILTER (ret > 0) AS avg_win, avg(ret) FILTER (ret <= 0) AS avg_loss, avg(sell_date - buy_date) AS avg_days, sum(ret) FILTER (ret > 0) / -sum(ret) FILTER (ret <= 0) AS profit_factor, avg(ret) AS expectancy FROM tt WHERE ret IS NOT NULL", "n_trades", *TRADE_STATS))
def trade_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(trades.trade_statistics(_trades(spark, d)[0]), *TRADE_STATS)


@query(wrap(f"{TRADES}, {HELD}", "SELECT * FROM hd", "date, n_positions", "portfolio_return"))
def daily_holdings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(trades.daily_holdings(*_trades(spark, d)), "portfolio_return")


def machine_sql(dev: int, stop: float, take: float) -> str:
    sell = f"((o.open / m.held - 1 < {stop}::DOUBLE AND o.dev_pct > {dev}) OR o.open / m.held - 1 > {take}::DOUBLE)"
    return f"""{BARS_W}, {BBI}, dp AS (SELECT ticker, date, open, close, i, CASE WHEN dev IS NOT NULL AND i >= 50 THEN (SELECT count(*) FROM dv e WHERE e.ticker = dv.ticker AND e.i BETWEEN dv.i - 251 AND dv.i AND e.dev <= dv.dev) END AS dev_pct FROM dv),
o AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k FROM dp WHERE dev_pct IS NOT NULL),
m AS (SELECT ticker, date, k, CASE WHEN dev_pct <= {dev} THEN 1 END AS signal, CASE WHEN dev_pct <= {dev} THEN close END AS held FROM o WHERE k = 1
  UNION ALL SELECT o.ticker, o.date, o.k, CASE WHEN m.held IS NULL AND o.dev_pct <= {dev} THEN 1 WHEN m.held IS NOT NULL AND {sell} THEN -1 END,
   CASE WHEN m.held IS NULL AND o.dev_pct <= {dev} THEN o.close WHEN m.held IS NOT NULL AND {sell} THEN NULL ELSE m.held END
  FROM m JOIN o ON o.ticker = m.ticker AND o.k = m.k + 1)"""


@query(f"WITH RECURSIVE {machine_sql(40, -0.01, 0.005)} SELECT ticker, date, signal::INTEGER AS signal FROM m WHERE signal IS NOT NULL")
def state_machine(spark: SparkSession, d: str) -> DataFrame:
    return trades.state_machine(fac.bbiboll(panels.weekly_bars(spark, d)), 40, -0.01, 0.005)


@query("""SELECT s_suppkey::VARCHAR AS ticker FROM supplier WHERE s_suppkey % 3 < 2 AND (s_suppkey % 5 <> 0 OR make_date((1990 + s_suppkey % 20)::BIGINT, 1, 2) > DATE '2000-06-01')""")
def common_stocks(spark: SparkSession, d: str) -> DataFrame:
    s = panels.table(spark, d, "supplier")
    kind = F.element_at(F.array(F.lit("CS"), F.lit("ADRC"), F.lit("ETF")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    gone = F.when(F.col("s_suppkey") % 5 == 0, F.concat((1990 + F.col("s_suppkey") % 20).cast("string"), F.lit("-01-02T00:00:00Z")))
    overview = s.select(F.col("s_suppkey").cast("string").alias("ticker"), kind.alias("type"), gone.alias("delisted_utc"))
    return dataprep.common_stocks(overview, "2000-06-01")


@query("SELECT event_id, t.ts, o.o_orderdate FROM (SELECT event_id, user_id, ts FROM events) t ASOF LEFT JOIN (SELECT o_custkey, o_orderdate FROM orders) o ON t.user_id = o.o_custkey AND t.ts >= o.o_orderdate")
def asof_backward(spark: SparkSession, d: str) -> DataFrame:
    events = panels.table(spark, d, "events").select("event_id", F.col("user_id").alias("k"), "ts")
    orders = panels.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderdate")
    return joins.asof_join(events, orders, "k", "ts", "o_orderdate", forward=False).select("event_id", "ts", "o_orderdate")


@query(wrap(BARS_W, "SELECT date, avg(close) AS c, first_value(avg(close)) OVER (ORDER BY date) AS f FROM bars GROUP BY date", "date, round(c / f, 6) + 0.0 AS value"))
def benchmark_relative(spark: SparkSession, d: str) -> DataFrame:
    index = panels.weekly_bars(spark, d).groupBy("date").agg(F.avg("close").alias("close"))
    return rounded(portfolio.relative_to_first(index), "value")


@query()
def bootstrap_sharpe(spark: SparkSession, d: str) -> DataFrame:
    return validation.bootstrap_sharpe(_daily(spark, d))


def cleaned(source: str, out: str) -> str:
    """A factor after clipping at 1 % and standardisation."""
    clip = WINSOR.format(src=source).replace("0.05::DOUBLE", "0.01::DOUBLE").replace("0.95::DOUBLE", "0.99::DOUBLE").replace("wz AS", f"{out}w AS", 1)
    return f"{clip}, {ZS.replace('zs AS', f'{out} AS', 1).replace('FROM sig', f'FROM {out}w')}"


PARTED = f"""{BARS_W.replace("bars AS (", "raw AS (")}, dd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM raw)), {folds_sql(130, 90, 5)},
bars AS (SELECT struct_pack(part := fold * 2 + (split = 'oos')::INTEGER, day := raw.date) AS date, struct_pack(part := fold * 2 + (split = 'oos')::INTEGER, name := ticker) AS ticker, close FROM raw JOIN dd ON raw.date = dd.date JOIN p ON i >= a AND i < b),
{RET}, {NXT}, {mom()}, {cleaned('sig', 'za')}, {sides('za')}, w0 AS (SELECT date, ticker, side / 10.0::DOUBLE AS weight FROM sd WHERE side <> 0),
wi AS (SELECT date, date.part AS part, row_number() OVER (PARTITION BY date.part ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM w0)),
w AS (SELECT x.date, ticker, weight FROM wi x JOIN wi y ON x.part = y.part AND y.i = x.i - x.i % 4 JOIN w0 ON w0.date = y.date), {PR},
wf AS (SELECT fold, split, (SELECT count(*) FROM pr WHERE pr.date.part = fold * 2 + (split = 'oos')::INTEGER) AS n_days,
  (SELECT avg(portfolio_return) FROM pr WHERE pr.date.part = fold * 2 + (split = 'oos')::INTEGER) AS m, (SELECT stddev_samp(portfolio_return) FROM pr WHERE pr.date.part = fold * 2 + (split = 'oos')::INTEGER) AS s FROM p),
wr AS (SELECT fold, split, n_days, m / nullif(s, 0) * sqrt(252.0::DOUBLE) AS sharpe, m * 252 AS annual_return, s * sqrt(252.0::DOUBLE) AS annual_volatility FROM wf)"""


def _walk_forward(spark: SparkSession, d: str) -> DataFrame:
    config = alpha.AlphaConfig(factors=["momentum"], n_long=5, n_short=5, rebalance_every=4)
    bars = panels.weekly_bars(spark, d)
    return alpha.walk_forward(bars, config, bars.select("date").distinct().count(), 130, 90, 5)


@query(wrap(PARTED, "SELECT * FROM wr", "fold, split, n_days", "sharpe", "annual_return", "annual_volatility"))
def walk_forward(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_walk_forward(spark, d), "sharpe", "annual_return", "annual_volatility")


DECAY = ("is_sharpe_mean", "oos_sharpe_mean", "oos_sharpe_std", "sharpe_decay")


@query(wrap(PARTED, "SELECT count(DISTINCT fold) AS n_folds, avg(sharpe) FILTER (split = 'is') AS is_sharpe_mean, avg(sharpe) FILTER (split = 'oos') AS oos_sharpe_mean, stddev_samp(sharpe) FILTER (split = 'oos') AS oos_sharpe_std, avg(sharpe) FILTER (split = 'is') - avg(sharpe) FILTER (split = 'oos') AS sharpe_decay FROM wr", "n_folds", *DECAY))
def sharpe_decay(spark: SparkSession, d: str) -> DataFrame:
    return rounded(alpha.sharpe_decay(_walk_forward(spark, d)), *DECAY)


@query(f"""WITH {BARS_W}, dd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM bars)), {folds_sql(52, 26, 2)}
SELECT fold, min(date) FILTER (split = 'is') AS train_start, max(date) FILTER (split = 'is') AS train_end, min(date) FILTER (split = 'oos') AS test_start, max(date) FILTER (split = 'oos') AS test_end, count(*) FILTER (split = 'is') AS train_size, count(*) FILTER (split = 'oos') AS test_size FROM dd JOIN p ON i >= a AND i < b GROUP BY fold""")
def fold_dates(spark: SparkSession, d: str) -> DataFrame:
    dates = panels.weekly_bars(spark, d).select("date").distinct()
    return validation.fold_dates(dates, validation.folds_frame(spark, validation.walk_forward_folds(dates.count(), 52, 26, 2)))


IC_PAIR = f"""{BARS_W}, {RET}, {NXT}, fwd AS (SELECT date, ticker, next_day_return AS y FROM nxt), {mom().replace("sig AS", "mo AS", 1)}, {cleaned('mo', 'za')}, {VOL_RATIO}, {cleaned('vr', 'zb')}, ic1 AS ({ic_sql('za', 'y', 2)}), ic2 AS ({ic_sql('zb', 'y', 2)})"""
ALPHA = f"""{IC_PAIR}, n1 AS (SELECT ic, row_number() OVER (ORDER BY date) AS i FROM ic1), n2 AS (SELECT ic, row_number() OVER (ORDER BY date) AS i FROM ic2),
mm AS (SELECT greatest(avg(a.ic), 0.0) AS a, greatest(avg(b.ic), 0.0) AS b FROM n1 a JOIN n2 b USING (i)), ww AS (SELECT CASE WHEN a + b <= 1e-12 THEN 0.5::DOUBLE ELSE a / (a + b) END AS wa, CASE WHEN a + b <= 1e-12 THEN 0.5::DOUBLE ELSE b / (a + b) END AS wb FROM mm),
sig AS (SELECT * FROM (SELECT za.date, za.ticker, za.value * wa + zb.value * wb AS value FROM za JOIN zb ON za.date = zb.date AND za.ticker = zb.ticker, ww) WHERE value IS NOT NULL), {SIGNAL_SIZED},
wi AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM g WHERE abs(weight) > 1e-10)), w AS (SELECT x.date, ticker, weight FROM wi x JOIN wi y ON y.i = x.i - x.i % 5 JOIN g ON g.date = y.date WHERE abs(weight) > 1e-10), {TRACK_TAIL}"""
TRACKED = ("gross_return", "turnover", "cost", "portfolio_return", "equity_curve")


@query(wrap(ALPHA, "SELECT *, e AS equity_curve, turnover * 0.0005::DOUBLE AS cost FROM eq", "date, n_positions, n_long, n_short", *TRACKED))
def alpha_pipeline(spark: SparkSession, d: str) -> DataFrame:
    config = alpha.AlphaConfig(n_long=5, n_short=5, combination="ic", sizing="Signal-Weighted", cost_bps=5.0)
    return rounded(alpha.run_alpha(panels.weekly_bars(spark, d), config)[1], *TRACKED)


def _ics(spark: SparkSession, d: str) -> tuple[list[DataFrame], list[DataFrame]]:
    bars = panels.weekly_bars(spark, d)
    ahead = returns.next_day_returns(returns.daily_returns(bars))
    signals = [fac.compute_factor(name, bars) for name in ("momentum", "vol_ratio")]
    return signals, [returns.ic_series(s, ahead, "next_day_return", least=2) for s in signals]


@query(wrap(f"{IC_PAIR}, l AS (SELECT date, 'momentum' AS name, ic FROM ic1 UNION ALL SELECT date, 'vol_ratio', ic FROM ic2)", "SELECT a.name AS a, b.name AS b, covar_pop(a.ic, b.ic) / nullif(stddev_pop(a.ic) * stddev_pop(b.ic), 0) AS corr FROM l a JOIN l b ON a.date = b.date AND a.name <= b.name GROUP BY 1, 2", "a, b", "corr"))
def ic_correlation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(returns.ic_correlation(dict(zip(("momentum", "vol_ratio"), _ics(spark, d)[1], strict=True))), "corr")


@query(wrap(f"{IC_PAIR}, rk AS (SELECT date, ticker, (rank() OVER (PARTITION BY date ORDER BY value) + (count(*) OVER (PARTITION BY date, value) - 1) / 2.0::DOUBLE - 1) / nullif((count(value) OVER (PARTITION BY date) - 1)::DOUBLE, 0) * 2 - 1 AS w FROM za), c AS (SELECT date, abs(w - lag(w) OVER (PARTITION BY ticker ORDER BY date)) AS c FROM rk), tv AS (SELECT avg(t) AS mean_turnover FROM (SELECT avg(c) AS t FROM c GROUP BY date)), st AS (SELECT {STATS} FROM ic1)",
            "SELECT *, CASE WHEN abs(t_stat) > 2 AND abs(ir) > 0.5 THEN 'strong' WHEN abs(t_stat) > 2 AND abs(ir) > 0.3 THEN 'usable' WHEN abs(t_stat) > 2 THEN 'significant' ELSE 'weak' END AS verdict FROM st, tv", "n, verdict", *STAT_COLUMNS, "mean_turnover"))
def factor_summary(spark: SparkSession, d: str) -> DataFrame:
    signals, series = _ics(spark, d)
    return rounded(returns.factor_summary(returns.ic_stats(series[0]), returns.rank_turnover(signals[0])), *STAT_COLUMNS, "mean_turnover")


def strategy_sql(dev: int, stop: float, take: float) -> str:
    return f"{machine_sql(dev, stop, take)}, alt AS (SELECT ticker, date, signal FROM m WHERE signal IS NOT NULL), {TRADES_TAIL}, {HELD}"


@query(wrap(strategy_sql(40, -0.01, 0.005), "SELECT * FROM hd", "date, n_positions", "portfolio_return").replace("WITH", "WITH RECURSIVE", 1))
def strategy_backtest(spark: SparkSession, d: str) -> DataFrame:
    bars = panels.weekly_bars(spark, d)
    return rounded(trades.BbiBollStrategy(40, -0.01, 0.005).run(bars)[0], "portfolio_return")


RULES = {"narrow": (40, -0.01, 0.005), "wide": (80, -0.02, 0.01)}
BENCHED = (*PERFORMANCE, "benchmark_return", "excess_return")


def compared_sql(name: str) -> str:
    tables = f"{strategy_sql(*RULES[name])}, eq AS (SELECT *, product(1 + portfolio_return) OVER (ORDER BY date) AS e FROM hd), {performance_sql()}, bm AS (SELECT date, avg(close) AS c FROM bars GROUP BY date), br AS (SELECT arg_max(c, date) / arg_min(c, date) - 1 AS benchmark_return FROM bm), pb AS ({PERFORMED})"
    body = wrap(tables, f"SELECT '{name}' AS name, *, total_return - benchmark_return AS excess_return FROM pb, br", 'name, start, "end", n, max_drawdown_days', *BENCHED)
    return f"SELECT * FROM ({body.replace('WITH', 'WITH RECURSIVE', 1)})"


@query(" UNION ALL ".join(compared_sql(name) for name in RULES))
def strategy_comparison(spark: SparkSession, d: str) -> DataFrame:
    bars = panels.weekly_bars(spark, d)
    benchmark = portfolio.relative_to_first(bars.groupBy("date").agg(F.avg("close").alias("close")))
    return rounded(alpha.run_strategies(bars, {name: trades.BbiBollStrategy(*rules) for name, rules in RULES.items()}, benchmark)[1], *BENCHED)


@query(f"WITH {BARS_W}, {BBI} SELECT date, ticker, CASE WHEN dev IS NOT NULL THEN row_number() OVER (PARTITION BY ticker ORDER BY dev NULLS LAST, date) END::INTEGER AS longterm_dev_pct_rank FROM dv")
def longterm_rank(spark: SparkSession, d: str) -> DataFrame:
    return fac.bbiboll(panels.weekly_bars(spark, d)).select("date", "ticker", "longterm_dev_pct_rank")


ISLANDS = """lm AS (SELECT ticker, date, volume <= 300 AS low, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM bars), lr AS (SELECT *, i - row_number() OVER (PARTITION BY ticker ORDER BY date) AS run FROM lm WHERE low),
ls AS (SELECT ticker, min(date) AS a, max(date) AS b, count(*) AS n FROM lr GROUP BY ticker, run)"""


@query(f"WITH {BARS_W}, {ISLANDS}, x AS (SELECT * FROM ls QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY n DESC, b DESC) = 1), tv AS (SELECT ticker, trunc(avg(close * volume))::BIGINT AS avg_turnover FROM bars WHERE volume > 300 GROUP BY 1) SELECT x.ticker, n AS max_duration_days, a AS max_duration_start_date, b AS max_duration_end_date, avg_turnover FROM x LEFT JOIN tv ON x.ticker = tv.ticker")
def low_volume_summary(spark: SparkSession, d: str) -> DataFrame:
    bars = panels.weekly_bars(spark, d)
    return dataprep.low_volume_summary(dataprep.low_volume_periods(bars, 300), bars, 300)


@query(f"WITH {BARS_M}, {ISLANDS.replace('300', '100')} SELECT ticker, date, close, volume FROM bars WHERE ticker NOT IN (SELECT ticker FROM ls WHERE n > 2) AND ticker NOT IN (SELECT ticker FROM bars GROUP BY 1 HAVING avg(close * volume) < 190000)")
def exclude_low_volume(spark: SparkSession, d: str) -> DataFrame:
    bars = panels.monthly_bars(spark, d)
    return dataprep.exclude_low_volume(bars, dataprep.low_volume_periods(bars, 100), 2, 190_000.0).select("ticker", "date", "close", "volume")


@query(f"""WITH {BARS_M}, tk AS (SELECT DISTINCT ticker, ticker::BIGINT // 3 AS g, ticker::BIGINT % 3 AS k FROM bars), cu AS (SELECT *, CASE WHEN k < 2 THEN make_date(1994 + 2 * k, 6, 30) END AS last_date FROM tk),
cx AS (SELECT *, last_value(ticker) OVER (PARTITION BY g ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS latest, max(last_date) OVER (PARTITION BY g ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after FROM cu)
SELECT latest AS ticker, date, close FROM bars JOIN cx ON bars.ticker = cx.ticker WHERE (after IS NULL OR date > after) AND (last_date IS NULL OR date <= last_date)""")
def align_tickers(spark: SparkSession, d: str) -> DataFrame:
    bars = panels.monthly_bars(spark, d).select("ticker", "date", "close")
    key = F.col("ticker").cast("bigint")
    names = bars.select("ticker").distinct().withColumns({"g": F.floor(key / 3), "k": (key % 3).cast("int")})
    groups = names.groupBy(F.col("g").cast("string").alias("group_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "ticker"))), lambda x: x["ticker"]).alias("tickers"))
    ends = names.select("ticker", F.when(F.col("k") < 2, F.make_date(F.lit(1994) + F.col("k") * 2, F.lit(6), F.lit(30))).alias("last_date"))
    return dataprep.align_tickers(bars, groups.withColumn("latest_ticker", F.element_at("tickers", -1)), ends)


@query("SELECT s_suppkey::VARCHAR AS ticker, s_name AS name, s_nationkey AS nation FROM supplier WHERE s_suppkey % 10 <> 3 UNION ALL SELECT 'new' || n_nationkey, NULL, n_nationkey FROM nation")
def correct_overview(spark: SparkSession, d: str) -> DataFrame:
    s = panels.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("ticker"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    added = panels.table(spark, d, "nation").select(F.concat(F.lit("new"), F.col("n_nationkey")).alias("ticker"), F.col("n_nationkey").alias("nation"))
    return files.correct_overview(s, s.where("cast(ticker as bigint) % 10 = 3"), added)


POSITIONS = """ps AS (SELECT s_suppkey::VARCHAR AS ticker, DATE '1995-01-01' + (s_suppkey % 700)::INTEGER AS buy_date, make_date((1997 + s_suppkey % 2)::BIGINT, 1, 1) AS backtest_date, CASE WHEN s_suppkey % 3 = 0 THEN make_date((1994 + s_suppkey % 8)::BIGINT, 3, 5) END AS gone FROM supplier),
pt AS (SELECT ticker, backtest_date, CASE WHEN gone <= backtest_date THEN 'Delisted' ELSE 'Active' END AS status, CASE WHEN gone <= backtest_date THEN gone ELSE backtest_date END - buy_date AS hold_days FROM ps)"""


def _positions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    gone = F.concat((1994 + k % 8).cast("string"), F.lit("-03-05T00:00:00Z"))
    return panels.table(spark, d, "supplier").select(
        k.cast("string").alias("ticker"), F.date_add(F.lit("1995-01-01").cast("date"), (k % 700).cast("int")).alias("buy_date"),
        F.make_date((1997 + k % 2).cast("int"), F.lit(1), F.lit(1)).alias("backtest_date"), F.when(k % 3 == 0, F.array(gone, F.lit(""))).otherwise(F.array().cast("array<string>")).alias("delisted"),
    )


@query(f"WITH {POSITIONS} SELECT ticker, status, hold_days::INTEGER AS hold_days FROM pt")
def position_status(spark: SparkSession, d: str) -> DataFrame:
    return trades.position_status(_positions(spark, d)).select("ticker", "status", "hold_days")


@query(wrap(POSITIONS, "SELECT backtest_date, count(*) AS n_positions, count(*) FILTER (status = 'Active') AS n_active, count(*) FILTER (status = 'Delisted') AS n_delisted, avg(hold_days) AS avg_hold_days FROM pt GROUP BY 1", "backtest_date, n_positions, n_active, n_delisted", "avg_hold_days"))
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(trades.status_counts(_positions(spark, d)), "avg_hold_days")


@query("SELECT o_custkey AS custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey < 12")
def intersect_rows(spark: SparkSession, d: str) -> DataFrame:
    customers = panels.table(spark, d, "customer").where("c_nationkey < 12")
    return joins.intersect_rows(panels.table(spark, d, "orders").select(F.col("o_custkey").alias("custkey")), customers.select(F.col("c_custkey").alias("custkey")))


@query("SELECT o_custkey AS custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey < 12")
def except_rows(spark: SparkSession, d: str) -> DataFrame:
    orders = panels.table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"))
    return joins.except_rows(orders, panels.table(spark, d, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("custkey")))


@query(wrap(f"{SIGNAL_W}, {PR}, {DATES}, {TURN}, c AS (SELECT pr.date, portfolio_return AS gross_return, CASE WHEN i = 1 THEN 0.0::DOUBLE ELSE turnover END AS t FROM pr JOIN turn ON pr.date = turn.date), "
            "k AS (SELECT date, gross_return, t * 0.0005::DOUBLE + t * 0.1::DOUBLE * 0.02::DOUBLE * sqrt(t * 1e7 / 5e7) AS cost FROM c)",
            "SELECT *, gross_return - cost AS net_return FROM k", "date", "gross_return", "cost", "net_return"))
def net_returns(spark: SparkSession, d: str) -> DataFrame:
    model = costs.CompositeCost([costs.FixedCost(5), costs.SqrtImpactCost()])
    return rounded(portfolio.net_returns(_daily(spark, d), portfolio.turnover(_weights(spark, d)), model, 1e7), "gross_return", "cost", "net_return")


@query(wrap(f"{SIGNAL_W}, {PR}", "SELECT year(date)::INTEGER AS year, CASE WHEN month(date) <= 6 THEN 1 ELSE 2 END::INTEGER AS half, count(*) AS n, avg(portfolio_return) / nullif(stddev_samp(portfolio_return), 0) * sqrt(252.0::DOUBLE) AS sharpe, product(1 + portfolio_return) - 1 AS total_return FROM pr GROUP BY 1, 2", "year, half, n", "sharpe", "total_return"))
def half_years(spark: SparkSession, d: str) -> DataFrame:
    return rounded(portfolio.half_years(_daily(spark, d)), "sharpe", "total_return")


@query(wrap(f"{SIGNAL_W}, {PR}, m AS (SELECT year(date)::INTEGER AS year, month(date) AS month, product(1 + portfolio_return) - 1 AS ret FROM pr GROUP BY 1, 2)",
            "SELECT year, " + ", ".join(f'max(ret) FILTER (month = {m}) AS "{m}"' for m in range(1, 13)) + " FROM m GROUP BY year", "year", *(f'"{m}"' for m in range(1, 13))))
def monthly_table(spark: SparkSession, d: str) -> DataFrame:
    return rounded(portfolio.monthly_table(_daily(spark, d)), *map(str, range(1, 13)))


RISK = ("mean_return", "volatility", "sharpe", "skewness", "excess_kurtosis", "var_historical", "var_parametric", "cvar_historical", "cvar_parametric", "var_ratio", "max_drawdown", "tail_ratio")
_Z, _H = risk.NORMAL.inv_cdf(1 - 0.95), risk.NORMAL.pdf(risk.NORMAL.inv_cdf(1 - 0.95)) / (1 - 0.95)


@query(wrap(f"""{SIGNAL_W}, {PR}, e AS (SELECT date, product(1 + portfolio_return) OVER (ORDER BY date) AS e FROM pr), g AS (SELECT e / max(e) OVER (ORDER BY date) - 1 AS dd FROM e),
m AS (SELECT count(*) AS n_observations, avg(portfolio_return) AS a, stddev_samp(portfolio_return) AS s, skewness(portfolio_return) AS skewness, kurtosis(portfolio_return) AS excess_kurtosis, quantile_cont(portfolio_return, 0.05::DOUBLE) AS lo, quantile_cont(portfolio_return, 0.95::DOUBLE) AS hi FROM pr)""",
            f"""SELECT n_observations, a * 252 AS mean_return, s * sqrt(252.0::DOUBLE) AS volatility, a / s * sqrt(252.0::DOUBLE) AS sharpe, skewness, excess_kurtosis, -lo AS var_historical, -(a + {_Z!r}::DOUBLE * s) AS var_parametric,
  (SELECT -avg(portfolio_return) FROM pr WHERE portfolio_return <= lo) AS cvar_historical, -(a - s * {_H!r}::DOUBLE) AS cvar_parametric, -lo / nullif(-(a + {_Z!r}::DOUBLE * s), 0) AS var_ratio, (SELECT -min(dd) FROM g) AS max_drawdown, abs(hi) / abs(lo) AS tail_ratio FROM m""", "n_observations", *RISK))
def risk_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(risk.risk_summary(_daily(spark, d), "portfolio_return"), *RISK)


SHAPE = ("mean", "std", "skewness", "excess_kurtosis", "jarque_bera", "jarque_bera_p")


@query(wrap(f"""{SIGNAL_W}, {PR}, m AS (SELECT count(*) AS n, avg(portfolio_return) AS mean, stddev_samp(portfolio_return) AS std, skewness(portfolio_return) AS skewness, kurtosis(portfolio_return) AS excess_kurtosis FROM pr),
p AS (SELECT *, skewness * (n - 2) / sqrt(n * (n - 1.0::DOUBLE)) AS b1, (excess_kurtosis * (n - 2) * (n - 3) / (n - 1) - 6) / (n + 1) AS b2 FROM m), j AS (SELECT *, n / 6.0::DOUBLE * (b1 * b1 + b2 * b2 / 4) AS jarque_bera FROM p)""",
            "SELECT *, exp(-jarque_bera / 2) AS jarque_bera_p FROM j", "n", *SHAPE))
def distribution_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(risk.distribution_summary(_daily(spark, d), "portfolio_return").drop("tail"), *SHAPE)


@query(wrap(f"{BARS_W}, x AS (SELECT ticker, date, close, list(close) OVER w AS v, min(close) OVER w AS low, count(*) OVER w AS n, lag(close, 1) OVER o AS c1, lag(close, 2) OVER o AS c2, lag(close, 3) OVER o AS c3, lag(close, 4) OVER o AS c4 FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 4 PRECEDING), o AS (PARTITION BY ticker ORDER BY date))",
            "SELECT ticker, date, CASE WHEN n = 5 THEN (list_position(v, low) - 1)::DOUBLE END AS argmin, CASE WHEN n = 5 THEN (1 + (c1 <= close)::INTEGER + (c2 <= close)::INTEGER + (c3 <= close)::INTEGER + (c4 <= close)::INTEGER) / 5.0::DOUBLE END AS rank, CASE WHEN n = 5 THEN (5 * close + 4 * c1 + 3 * c2 + 2 * c3 + c4) / 15.0::DOUBLE END AS decay FROM x", "ticker, date", "argmin", "rank", "decay"))
def rolling_places(spark: SparkSession, d: str) -> DataFrame:
    w, x = Window.partitionBy("ticker").orderBy("date").rowsBetween(-4, 0), F.col("close")
    bars = panels.weekly_bars(spark, d)
    return rounded(bars.select("ticker", "date", ts.ts_argmin(x, 5, w).alias("argmin"), ts.ts_rank(x, 5, w).alias("rank"), ts.decay_linear(x, 5, w).alias("decay")), "argmin", "rank", "decay")


@query("SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    customers, suppliers = panels.table(spark, d, "customer"), panels.table(spark, d, "supplier")
    return joins.union_distinct(customers.select(F.col("c_nationkey").alias("nationkey")), suppliers.select(F.col("s_nationkey").alias("nationkey")))
