"""Mixing against SQL; targets, clamping and repeats."""

import duckdb
from cases import AWKWARD, SF, frame, ordered, prose, tables

from quillspark.llm import mixing, oracles, queries


def uneven():
    rows = [(i, prose(i, 20 + i % 50), "c") for i in range(400)]
    rows += [(1000 + i, prose(i, 30), "a") for i in range(5)]
    rows += [(2000 + i, prose(i, 40), "b") for i in range(40)]
    rows += [(3000, prose(1, 900), "d"), (3001, prose(1, 9), "d"), (3002, "", "e"), (3003, prose(3, 50), None)]
    return rows


def test_query_matches_sql(spark):
    df = queries.op10_mixing(spark, SF)
    sql = tables(duckdb.connect()).sql(oracles.ORACLES["op10_mixing"])
    assert ordered(df.collect(), df.columns) == ordered(sql.fetchall(), sql.columns)


def test_clamped_sources_match_sql(spark):
    docs = frame(spark, uneven())
    df = mixing.mix(docs)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toArrow())
    sql = con.sql(oracles.ORACLES["op10_mixing"])
    assert ordered(df.collect(), df.columns) == ordered(sql.fetchall(), sql.columns)


def test_targets_add_up_and_are_met(spark):
    source = {r[0]: r[2] for r in uneven()}
    rows = mixing.mix(frame(spark, uneven())).collect()
    assert rows == mixing.mix(frame(spark, uneven())).collect() or sorted(rows) == sorted(
        mixing.mix(frame(spark, uneven())).collect()
    )
    target = {source[r["doc_id"]]: (r["target"], r["source_size"]) for r in rows}
    assert abs(sum(t for t, _ in target.values()) - sum(r["size"] for r in rows)) < 1e-6
    assert target["a"][0] == 3 * target["a"][1] and all(t <= 3 * s for t, s in target.values())
    for name, (aim, _) in target.items():
        taken = sum(r["taken"] for r in rows if source[r["doc_id"]] == name)
        longest = max(r["size"] for r in rows if source[r["doc_id"]] == name)
        assert abs(taken - aim) <= longest / 2 + 1
    assert all(r["taken"] <= 3 * r["size"] for r in rows)


def test_water_filling_by_brute_force(spark):
    sizes = {"a": 10, "b": 5000, "c": 70, "d": 900, "e": 0, "f": 1}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df, (1, 2, 3), 3).collect()}
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes))}
    want, free = {}, set(sizes)
    while free:
        level = (sum(sizes.values()) - sum(want.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            want |= {s: level * weight[s] for s in free}
            break
        want |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    assert {s: round(t, 6) for s, t in got.items()} == {s: round(t, 6) for s, t in want.items()}


def test_repeats_equal_the_mix(spark):
    docs = frame(spark, uneven())
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(docs).collect() if r["size"]}
    rows = mixing.repeat(docs)
    assert rows.columns == docs.columns
    got = {r["doc_id"]: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    assert {d: n for d, n in got.items() if d != 3002} == {d: n for d, n in want.items() if n}


def test_awkward_rows(spark):
    docs = frame(spark, [*AWKWARD, (30, None, None), (31, "x", None)])
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(AWKWARD) + 2
    assert all(r["size"] == 0 and r["taken"] == 0 for r in rows if r["doc_id"] in (0, 1, 2, 30))
    assert mixing.mix(frame(spark, [])).count() == 0
    assert mixing.repeat(frame(spark, [])).count() == 0
    only = mixing.mix(frame(spark, [(1, None), (2, "")])).collect()
    assert [(r["target"], r["taken"]) for r in only] == [(0.0, 0)] * 2
