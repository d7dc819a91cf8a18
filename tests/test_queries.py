"""Every registered query runs, and equals its SQL where it has one."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from plyforge.plans import registry


@pytest.fixture(scope="module")
def sql(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(sf_dir + "/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def canon(df: pd.DataFrame) -> list[tuple]:
    def one(x):
        if isinstance(x, str):
            return x
        if pd.isna(x):
            return ""
        return repr(round(float(x), 6))

    return sorted(tuple(one(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_sql(spark, sf_dir, sql, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    want = sql.sql(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
