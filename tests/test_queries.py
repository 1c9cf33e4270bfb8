"""Every registered query of the library against its oracle SQL, and its stable columns."""

import duckdb
import pytest

from tallyvane.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return str({k: plain(v) for k, v in value.items()})
    if isinstance(value, list | tuple):
        return str([plain(v) for v in value])
    return str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLES:
        raise AssertionError(f"{name} has no oracle")
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    names = want.columns
    assert got == sorted(tuple(plain(dict(zip(names, row, strict=True))[c]) for c in columns) for row in want.fetchall())


def test_entry_and_guard(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 11
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
