"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from ringspark.plans import catalog, derived

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    names = sorted(df.columns)
    own = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    cursor = duck.execute(catalog.oracle_sql()[name])
    theirs = [x[0] for x in cursor.description]
    assert sorted(theirs) == names
    other = [tuple(plain(dict(zip(theirs, r, strict=True))[c]) for c in names) for r in cursor.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(own, key=key) == sorted(other, key=key)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_route_hops_end_at_owners(spark):
    rows = catalog.queries()["route_hops"](spark, SF).collect()
    nodes = sorted(r["id"] for r in derived.living(spark, SF).collect())
    for r in rows:
        path = r["path"].split(",")
        assert r["owner"] == next((n for n in nodes if n >= r["key"]), nodes[0])
        assert path[0] == r["src"] and path[-1] == r["owner"] and r["hops"] == len(path) - 1
    assert sum(r["hops"] for r in rows) / len(rows) <= math.log2(len(nodes)) + 1
