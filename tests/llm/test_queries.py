"""The registered queries: names, SQL oracles and repeatability."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from fathom.llm import queries as Q
from tests.llm.conftest import SF


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_every_operator_has_a_query():
    assert [int(n[2:].split("_")[0]) for n in Q.QUERIES] == list(range(1, 14))
    assert {*Q.QUERIES, "pipeline"} <= set(E.queries())


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{t}')")
    df = Q.QUERIES[name](spark, SF)
    cols = ", ".join(sorted(df.columns))
    assert rows(df) == sorted(c.execute(f"SELECT {cols} FROM ({Q.ORACLES[name]})").fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted({*Q.QUERIES} - {"op2_pack_best_two_fit", "op5_balanced_shards", "op9_lm_ctw"}))
def test_same_rows_with_other_partitions(spark, name):
    first = rows(Q.QUERIES[name](spark, SF))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert rows(Q.QUERIES[name](spark, SF)) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
