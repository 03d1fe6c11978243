"""Driver contract: entry(), queries() and oracle_sql() agree at sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from fathom.plans import registry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
SF = "/root/testdata/sf0.001"


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["qid", "name", "last_modified"]
    assert df.count() > 0


registry.load_all()


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(registry.QUERIES) <= set(E.queries()) and set(registry.ORACLES) <= set(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    cols = sorted(sdf.columns)
    a = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    b = sorted((tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
    assert a == b


def _rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)


def test_same_result_under_1_and_8_shuffle_partitions(spark):
    qs = {name: E.queries()[name] for name in registry.QUERIES}
    first = {}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        for name, fn in qs.items():
            first[name] = _rows(fn(spark, SF))
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        for name, fn in qs.items():
            assert _rows(fn(spark, SF)) == first[name], name
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
