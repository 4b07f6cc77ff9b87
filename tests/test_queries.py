"""A few registered queries against their SQL statement; every query names real columns."""

import os

import pytest

import __spark_entry__ as entry_module

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
CHECKED = [
    "label_encode", "filter_text", "sentence_split", "tokens", "content_features", "tfidf_bigram_capped",
    "encode_sequences", "word_ngrams", "padded_ngrams", "metrics_by_fold", "lm_loglik",
    "lm_generate_step", "lm_next_draw", "lm_continue", "known_edits", "error_proba", "stratified_kfold",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in sorted(os.listdir(SF)):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return c


def rows(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("" if r[i] is None else str(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, con, name):
    df = entry_module.queries()[name](spark, SF)
    sql = con.sql(entry_module.oracle_sql()[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows(df.collect(), df.columns) == rows(sql.fetchall(), sql.columns)


def test_registry():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
