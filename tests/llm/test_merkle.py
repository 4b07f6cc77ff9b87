"""Merkle manifest against SQL and a plain tree; proofs, tampering and awkward rows."""

import hashlib
import random

import duckdb
from cases import AWKWARD, SF, frame, ordered, prose, tables
from pyspark.sql import functions as F

from quillspark.llm import merkle as M
from quillspark.llm import oracles, queries


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(*values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def proof(tree, at):
    parts = []
    for level in tree[:-1]:
        run = range(at // 8 * 8, min(at // 8 * 8 + 8, len(level)))
        parts.append("".join(level[i] for i in run if i != at))
        at //= 8
    return "".join(parts)


def test_query_matches_sql(spark):
    df = queries.op12_merkle(spark, SF)
    sql = tables(duckdb.connect()).sql(oracles.ORACLES["op12_merkle"])
    assert ordered(df.collect(), df.columns) == ordered(sql.fetchall(), sql.columns)


def test_against_plain_tree_over_several_blocks(spark):
    rng = random.Random(3)
    sizes = {None: 3, "a": 513, "b": 1, "d": 8, **{f"x{i}": rng.randint(1, 20) for i in range(9)}, "z": 1025}
    rows = [(1000 * g + i, name, f"t{rng.random()}") for g, (name, n) in enumerate(sizes.items()) for i in range(n)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "key long, grp string, body string").repartition(3)
    found = M.manifest(docs, ("key", "body"), "grp", "key").withColumn("proof", M.siblings(F.col("path")))
    got = {r["id"]: r for r in M.verified(found).collect()}
    trees = {}
    for name in sizes:
        own = sorted((k, plain_leaf(k, body)) for k, g, body in rows if g == name)
        trees[name] = ([k for k, _ in own], levels([h for _, h in own]))
    above = levels([trees[name][1][-1][0] for name in sorted(sizes, key=lambda x: (x is not None, x or ""))])
    assert len(got) == len(rows) and all(r["verified"] for r in got.values())
    for place, name in enumerate(sorted(sizes, key=lambda x: (x is not None, x or ""))):
        keys, tree = trees[name]
        for at, key in enumerate(keys):
            row = got[key]
            assert (row["leaf"], row["subroot"], row["root"]) == (tree[0][at], tree[-1][0], above[-1][0])
            assert row["proof"] == proof(tree, at) + proof(above, place)


def test_a_changed_leaf_does_not_lead_to_the_root(spark):
    docs = frame(spark, [(i, prose(i, 5)) for i in range(40)])
    other = F.when(F.col("doc_id") == 7, M.leaf(F.lit("forged")))
    rows = M.verified(M.manifest(docs, other=other)).collect()
    assert [r["id"] for r in rows if not r["verified"]] == [7]
    assert len({r["root"] for r in rows}) == 1


def test_awkward_rows(spark):
    rows = M.verified(M.manifest(frame(spark, AWKWARD))).collect()
    assert len(rows) == len(AWKWARD) and all(r["verified"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["id"], []).append(r["leaf"])
    assert by[0] == [plain_leaf(0, "s", "en", None, "")] and by[2] == [plain_leaf(2, "s", "en", None, None)]
    assert len(by[None]) == 2 and len(set(by[3])) == 1
    assert M.manifest(frame(spark, [])).count() == 0
    one = M.verified(M.manifest(frame(spark, [(5, "x")]))).collect()[0]
    assert one["root"] == one["leaf"] == one["subroot"] and one["path"] == [] and one["verified"]
