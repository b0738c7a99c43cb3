"""Every registered query with SQL against DuckDB, as row sets."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from factorium.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def norm(v):
    if isinstance(v, float):
        return "0.0" if v == 0 else repr(v)
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = Counter(tuple(norm(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == want


def test_independent_set_covers_all_orders(spark, sf, duck):
    """Against the set chosen one by one in order of (degree, id) over the links of all orders."""
    vertices = [v for (v,) in duck.execute("SELECT c_custkey FROM customer").fetchall()]
    near = {v: set() for v in vertices}
    for a, b in duck.execute("SELECT o_custkey, (o_custkey * 17 + o_orderkey) % (SELECT count(*) FROM customer) FROM orders").fetchall():
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    chosen = set()
    for v in sorted(vertices, key=lambda v: (len(near[v]), v)):
        if not near[v] & chosen:
            chosen.add(v)
    got = [r.v for r in QUERIES["independent_set"](spark, sf).collect()]
    assert sorted(got) == sorted(chosen)
    order = [r.v for r in QUERIES["schur_ordering"](spark, sf).orderBy("place").collect()]
    assert order == sorted(set(vertices) - chosen) + sorted(chosen)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(QUERIES)
