"""The driver's contract: queries run on small tables with stable columns, and match their SQL."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from strandweave.plans import registry

SF = "/root/testdata/sf0.001"


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_match_their_sql(spark, name):
    check(spark, registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(registry.PUBLISHED))
def test_published_values(spark, name):
    function, sql = registry.PUBLISHED[name]
    if sql:
        check(spark, function, sql)
    else:
        assert function(spark, SF).count() > 0


def check(spark, function, sql):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(sql)
    columns = sorted(c[0] for c in want.description)
    rows = want.fetchall()
    order = [[c[0] for c in want.description].index(c) for c in columns]
    df = function(spark, SF)
    assert sorted(df.columns) == columns
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    want = sorted((tuple(r[i] for i in order) for r in rows), key=key)
    assert len(got) == len(want) and all(same(x, y) for a, b in zip(got, want) for x, y in zip(a, b))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
