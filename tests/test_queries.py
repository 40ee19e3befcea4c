"""Every registered query against its SQL oracle, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from sphaera import registry

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(float(v)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, str(SF))
    cols = sorted(df.columns)
    ours = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    r = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(r.columns) == cols
    theirs = sorted(tuple(map(plain, x)) for x in r.select(*(f'"{c}"' for c in cols)).fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, str(SF)).count() > 0
