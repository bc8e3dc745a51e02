"""Every registered query with SQL is compared with DuckDB on the smallest tables."""

import duckdb
import pytest

from panelmill.plans import registry

SF = "/root/testdata/sf0.001"
#: A signal needs 252 bars before it, which the smallest tables do not have.
LARGER, NEED_HISTORY = "/root/testdata/sf0.01", {"calibrated_heads", "calibrated_signals"}
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    cursor = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted((tuple(r) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == rows


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_returns_rows(spark, name):
    assert registry.queries()[name](spark, LARGER if name in NEED_HISTORY else SF).count() > 0


def test_the_panel_equals_sql_where_it_has_rows(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{LARGER}/{t}.parquet'")
    got = registry.queries()["calibration_panel"](spark, LARGER)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()['calibration_panel']})").fetchall()
    rows = sorted(tuple(r[c] for c in columns) for r in got.collect())
    assert rows == sorted(want) and len(rows) > 5000
