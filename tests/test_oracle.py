"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tickforge.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def shown(v):
    return repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_rows_equal(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    want = con.sql(registry.ORACLE[name])
    assert want.limit(1).fetchall(), "green on nothing"
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(shown(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(shown(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() >= 0


def test_some_candidates_pass_and_all_families_are_there(con):
    c = duckdb.connect()
    folder = SF.replace("sf0.001", "sf0.01")
    for t in ("orders", "events"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    assert c.sql(f"SELECT count(*) FROM ({registry.ORACLE['candidate_gates']}) WHERE passed AND score IS NOT NULL").fetchall()[0][0] > 0
    assert [c.sql(f"SELECT count(DISTINCT scan_type) FROM ({registry.ORACLE[f'scan_set_{k}']})").fetchall()[0][0] for k in "ac"] == [11, 21]


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
