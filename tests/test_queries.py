import pytest

from terseframe import registry


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_against_duckdb(spark, sf, name):
    import duckdb

    got = registry.QUERIES[name](spark, sf)
    if name not in registry.ORACLES:
        assert got.count() >= 0
        return
    con = duckdb.connect()
    con.sql("set TimeZone='UTC'")
    for t in ("documents", "pages", "conversations", "events", "orders", "part", "nation"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def norm(rows):
        return sorted((tuple(round(v, 6) if isinstance(v, float) else str(v) if not isinstance(v, (int, float, type(None))) else v for v in r) for r in rows), key=str)

    assert norm(got.select(*columns).collect()) == norm(want.select(*[f'"{c}"' for c in columns]).fetchall())
