"""Every catalog query with SQL gives DuckDB's rows on the smallest tables."""

import datetime
import os

import pytest

from gatherlake import queries as catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def norm(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v.isoformat() if isinstance(v, datetime.date | datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    out = catalog.queries()[name](spark, SF)
    columns = sorted(out.columns)
    got = [tuple(norm(v) for v in r) for r in out.select(columns).collect()]
    found = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(norm(r[names.index(c)]) for c in columns) for r in found.fetchall()]
    assert sorted(map(str, got)) == sorted(map(str, want))
