"""Every query that has SQL, against DuckDB, on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    rel = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = [tuple(r[i] for i in order) for r in rel.fetchall()]
    assert len(ours) == len(theirs)
    # rows are paired by their keys, the values that aren't floats; rows with equal keys by their floats in order
    exact = lambda row: tuple(x for x in row if not isinstance(x, float))
    floats = lambda row: tuple(x for x in row if isinstance(x, float))
    ours, theirs = (sorted(rows, key=lambda row: ([(x is None, str(x)) for x in exact(row)], floats(row))) for rows in (ours, theirs))
    bad = [(a, b) for a, b in zip(ours, theirs, strict=True) if not all(map(same, a, b))]
    assert not bad, (len(bad), len(ours), bad[:3])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
