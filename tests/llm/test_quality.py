"""Quality rules against SQL, line limits and awkward rows."""

import corpus_pipeline
import duckdb
import pytest
from cases import AWKWARD, SF, frame, ordered, prose, tables

from quillspark.llm import oracles, quality, queries


def check(spark, df, documents):
    con = duckdb.connect()
    con.register("documents", documents.toArrow())
    sql = con.sql(oracles.ORACLES["op8_quality"])
    assert ordered(df.collect(), df.columns) == ordered(sql.fetchall(), sql.columns)


def test_query_matches_sql(spark):
    df = queries.op8_quality(spark, SF)
    sql = tables(duckdb.connect()).sql(oracles.ORACLES["op8_quality"])
    assert ordered(df.collect(), df.columns) == ordered(sql.fetchall(), sql.columns)


def boilerplate(n):
    line = prose("menu", 40)
    shared = [(i, f"{line}\n{prose(i, 25)}", "hot") for i in range(n)]
    return [*shared, (900, prose(901, 90), "hot"), (901, f"{line}\n{prose(5, 60)}", "other")]


def test_frequent_lines_reject_all_but_the_first(spark):
    docs = frame(spark, [*boilerplate(30), (0, boilerplate(30)[0][1], "hot")])
    df = quality.judge(docs)
    kept = {r["doc_id"] for r in df.collect() if r["kept"]}
    assert kept == {0, 900, 901}
    check(spark, df, docs.select("doc_id", "text", "source"))
    assert quality.keep_good(docs).columns == docs.columns
    assert {r["doc_id"] for r in quality.keep_good(docs).collect()} == kept


def test_clean_texts_lose_exactly_the_frequent_lines(spark):
    menu, rare = prose("menu", 20), prose("rare", 5)
    text = lambda i: f"{prose(i, 40)}\n\n  {menu.upper()} \n{rare if i < 5 else prose((i, 1), 5)}\n{menu}\n{prose((i, 2), 30)}\n"
    rows = [(i, text(i), "hot") for i in range(30)] + [(0, text(3), "hot"), (40, text(3), "other"), (41, f"{menu}\n{menu}\n{prose(9, 20)}", "hot")]
    got = quality.clean(frame(spark, rows))
    assert got.columns == frame(spark, rows).columns
    cut = lambda t: "\n".join(x for x in t.split("\n") if x.strip().lower() != menu)
    first = {text(0), text(3)}  # texts that share the smallest id keep the line
    want = [(d, t if h == "other" or t in first else cut(t), h) for d, t, h in rows[:-1]]
    assert sorted((r["doc_id"], r["text"], r["source"]) for r in got.collect()) == sorted(want)
    assert {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, frame(spark, rows), SF).where(f"text like '%{menu}%'").collect()} == {0, 3, 40}


def test_lines_below_the_limit_stay(spark):
    assert all(r["kept"] for r in quality.judge(frame(spark, boilerplate(9))).collect())


@pytest.mark.parametrize("repeat", [1, 3])
def test_awkward_rows(spark, repeat):
    rows = AWKWARD * repeat + [(20, "a b c a b c a b c " * 20), (21, None, None), (22, prose(9, 60), None)]
    docs = frame(spark, rows)
    df = quality.judge(docs)
    assert df.count() == len(rows)
    by_id = {r["doc_id"]: r for r in df.collect()}
    assert by_id[20]["n_repeat_words"] == 180 and not by_id[20]["kept"]
    assert by_id[2]["n_words"] == 0 and by_id[2]["base_failed"]
    assert by_id[22]["kept"] and by_id[5]["n_words"] == 60_000
    small = docs.where("doc_id is null or doc_id <> 5")
    check(spark, quality.judge(small), small.select("doc_id", "text", "source"))


def test_empty_table(spark):
    assert quality.judge(frame(spark, [])).count() == 0
    assert quality.keep_good(frame(spark, [])).count() == 0
