"""Every query with an oracle gives the oracle's rows on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if pd.isna(x):
            return None
        if isinstance(x, (bool, str)):
            return x
        if hasattr(x, "item"):
            x = x.item()
        if isinstance(x, (int, float)):
            return round(float(x), 5) + 0.0
        return str(pd.Timestamp(x))

    cols = sorted(df.columns)
    return sorted((tuple(plain(v) for v in r) for r in df[cols].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(entry.catalogue.ORACLES))
def test_oracle(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not [p for p in wrong if not all(u == v or (isinstance(u, float) and isinstance(v, float) and abs(u - v) <= 2e-5 * max(1, abs(v))) for u, v in zip(*p, strict=True))], wrong[:2]
