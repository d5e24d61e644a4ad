"""Every query against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from plumbline.plans.bindings import TABLES
from plumbline.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def as_text(row):
    return tuple(str(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v) for v in row)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(as_text(r) for r in df.select(*columns).collect())
    found = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(as_text(r[names.index(c)] for c in columns) for r in found.fetchall())
    assert got == want


def test_every_query_is_named_once():
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE_SQL) == {"dense_fp16", "greedy_tune", "pair_features_two", "ranker_scores", "head_vectors"}
