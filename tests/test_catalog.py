"""Every catalogue query that has one against its DuckDB statement on sf0.001."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from tidemark.plans import catalog  # noqa: E402

catalog.load_all()


@pytest.fixture(scope="module")
def duck(sf_small):
    import duckdb
    from oracle_check import TABLES
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_oracle(spark, duck, sf_small, name):
    import __spark_entry__ as ent
    from oracle_check import digest_rows
    df = ent.queries()[name](spark, sf_small)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(ent.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(rows) == len(drows)
    assert digest_rows(df.columns, rows)[0] == digest_rows(dcols, drows)[0]


def test_every_query_has_oracle_or_is_rows_only():
    import __spark_entry__ as ent
    q, o = ent.queries(), ent.oracle_sql()
    assert set(o) <= set(q)
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == {"search_response_json"}


def test_entry_smoke(spark):
    import __spark_entry__ as ent
    df = ent.entry(spark)
    assert df.count() >= 0
    assert "surt" in df.columns
