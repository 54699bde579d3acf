"""Every registered query against its DuckDB oracle on the smallest tables."""

import datetime as dt
import math
import os

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ["events", "documents", "labels", "benchmark", "pages", "conversations", "embeddings"]
#: queries without an oracle: the columns and the least number of rows of their results
SHAPES = {
    "segmented_tokens": ({"token", "count"}, 1000),
    "changed_files": ({"md5", "reason"}, 1),
    "topic_model_lda": ({"topic", "pos", "term", "weight", "label"}, 100),
    "topic_model_lda_table": ({"topic", "pos", "term", "weight", "label"}, 100),
    "topic_summary_lda": ({"dominant_topic", "count", "positive_ratio"}, 1),
    "topic_model_nmf": ({"topic", "pos", "term", "weight", "label"}, 100),
}


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return v


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in recs), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    srows, scols = df.collect(), df.columns
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(scols) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _rows(scols, srows) == _rows(dcols, drows)


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_shape(spark, name):
    cols, least = SHAPES[name]
    df = E.queries()[name](spark, SF)
    rows = df.collect()
    assert set(df.columns) == cols and len(rows) >= least
    for c in ("toxicity_score", "weight", "positive_ratio"):
        if c in cols:
            assert all(0 <= r[c] <= 1 for r in rows)


def test_every_query_has_a_check():
    """Queries of the training-data subpackage have tests of their own."""
    from plaudit.plans import catalog
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == set(SHAPES)


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "topic_variety" in df.columns
