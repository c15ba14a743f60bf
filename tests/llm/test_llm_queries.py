import glob

import duckdb
import pytest

from terseframe.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs_on_the_smallest_tables(spark, sf, name):
    got = queries.QUERIES[name](spark, sf)
    key = "conv_id" if name.startswith("op7") else "page_id" if name.startswith("op1_") else "doc_id"
    table = {"conv_id": "conversations", "page_id": "pages", "doc_id": "documents"}[key]
    ids = spark.read.parquet(f"{sf}/{table}.parquet").select(key).distinct().count()
    if name.startswith("op10"):
        assert got.count() >= 0
    else:
        assert got.select(key).distinct().count() == ids + (key == "conv_id")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_its_sql(spark, sf, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        duck.sql(f"create view {path.split('/')[-1][:-8]} as select * from '{path}'")
    want = duck.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, sf)
    columns = sorted(want.columns)
    assert set(columns) <= set(got.columns) and (name[:2] == "op" or set(columns) == set(got.columns))
    rows = sorted(map(str, (tuple(r) for r in got.select(*columns).collect())))
    assert rows == sorted(map(str, want.select(*columns).fetchall()))
