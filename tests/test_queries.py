"""Every registered query against its DuckDB statement on the smallest tables."""

import math
import os

import duckdb
import pytest

from strandline.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def cell(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 5) + 0.0
        return float(x) if type(x).__name__ == "Decimal" else x

    return [cols[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in catalogue.ORACLES:  # operators tested against brute force in test_operators.py
        assert got[0] and got[1]
        return
    cur = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    assert got[0] == want[0]
    ints = lambda r: [tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in t) for t in r]
    assert ints(got[1]) == ints(want[1])
