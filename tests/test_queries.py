"""Every registered query of the library against its SQL in DuckDB."""

import os

import duckdb
import pytest

from casewise.plans import catalog
from casewise.sources.fixtures import TABLES


def plain(v):
    if v is None or type(v).__name__ in ("NAType", "NaTType") or (isinstance(v, float) and v != v):
        return None
    if hasattr(v, "dtype"):
        v = v.item()
    if type(v).__name__ == "Decimal":
        v = float(v)
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else str(round(v, 6))
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr), list(df.columns)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for n in TABLES:
        p = f"{sf}/{n}.parquet"
        con.execute(f"create view {n} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, sf, duck, name):
    got = catalog.queries()[name](spark, sf).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).df()
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0
