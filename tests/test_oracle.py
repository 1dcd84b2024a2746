"""Every query with SQL against that SQL in another engine; the others must give rows."""

import math

import duckdb
import pytest

from kilnflow.plans.registry import ORACLE_SQL, QUERIES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return ("",)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, str):
        return ("s", v)
    try:
        f = float(v)
    except (TypeError, ValueError):
        return ("s", str(v))
    return ("n", f)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, oracle, name):
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLE_SQL:
        assert got[1]
        return
    cur = oracle.execute(ORACLE_SQL[name])
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1]):
        for x, y in zip(a, b):
            assert x == y or (x[0] == y[0] == "n" and math.isclose(x[1], y[1], rel_tol=1e-7, abs_tol=1e-9)), (a, b)
