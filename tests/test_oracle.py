"""Every registered query against its DuckDB oracle, on the smallest tables."""

import os
import sys

import duckdb
import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(HERE, "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import digest  # noqa: E402
from qualis import queries as Q  # noqa: E402
from qualis.fixtures import BASE_TABLES  # noqa: E402

from .conftest import SF_SMALL  # noqa: E402

NAMES = sorted(Q.queries())  # those of qualis.llm have tests of their own



@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_oracle():
    assert set(Q.queries()) == set(Q.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    s_cols, s_hash, _ = digest(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(E.oracle_sql()[name])
    d_cols, d_hash, _ = digest([c[0] for c in cur.description], cur.fetchall())
    assert s_cols == d_cols
    assert s_hash == d_hash


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "ts_freq_enc" in df.columns
