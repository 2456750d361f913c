"""Every query of this package runs on the smallest tables, and gives the rows of its SQL where it has one."""

from pathlib import Path

import duckdb
import pytest

from compare import norm
from lorekeep.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    if name not in SQL:
        assert got
        return
    result = con.execute(SQL[name])
    have = [d[0] for d in result.description]
    assert sorted(have) == columns
    assert got == sorted(tuple(norm(r[have.index(c)]) for c in columns) for r in result.fetchall())
