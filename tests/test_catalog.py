"""Every query with SQL gives what DuckDB gives on the same tables; the others give rows."""

import math
import os

import duckdb
import pytest

from tidemark import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def plain(v):
    return ("nan" if math.isnan(v) else f"{v + 0.0:.5f}") if isinstance(v, float) else repr(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert got
    if name in catalog.SQL:
        r = duck.execute(catalog.SQL[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == cols
        assert got == sorted(tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall())


def test_pair_dashboard_takes_all_pairs(spark):
    sizes = catalog.vectors(spark, DATA).groupBy("head").count().collect()
    want = {}
    for head, n in sizes:
        last = range(max(0, n - catalog.N), n)  # the anchors
        want |= {(head, "qk"): sum(p + 1 for p in last), (head, "qq"): len(last) * (n - 1), (head, "kk"): len(last) * (n - 1)}
    got, bins = {}, 0
    for r in catalog.pair_dashboard(spark, DATA).filter("metric = 'cos'").collect():
        got[r["head"], r["pair_type"]] = got.get((r["head"], r["pair_type"]), 0) + r["n"]
        bins = max(bins, r["bin"])
    assert got == {k: n for k, n in want.items() if n} and bins == 15
