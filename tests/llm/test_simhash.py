"""SimHash near-duplicates against all pairs; awkward rows."""

import random
import re

import xxhash
from cases import AWKWARD, SF, frame, prose

from quillspark.llm import components as C
from quillspark.llm import queries, simhash


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, radius=3):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ps = sorted(parent)
    for i, a in enumerate(ps):
        for b in ps[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in ps}


def test_query_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    prints = {r["doc_id"]: brute_print(r["text"]) for r in docs}
    roots = brute_components(prints.values())
    first = {}
    for d, p in sorted(prints.items(), reverse=True):
        first[roots[p]] = d
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op1_simhash(spark, SF).collect()}
    assert got == {d: (f"{p:016x}", first[roots[p]]) for d, p in prints.items()}
    assert len({c for _, c in got.values()}) < len(got)


def clustered(seed):
    rng = random.Random(seed)
    found = set()
    for _ in range(20):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            found.add(p)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                p ^= 1 << b
    dense = rng.getrandbits(64)
    weak = rng.sample(range(64), 9)
    found |= {dense ^ sum(1 << b for k, b in enumerate(weak) if m >> k & 1) for m in range(0, 512, 5)}
    return found


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def grouped(pairs):
    out = {}
    for node, root in pairs:
        out.setdefault(root, set()).add(node)
    return sorted(sorted(v) for v in out.values() if len(v) > 1)


def test_links_keep_every_component_also_when_shards_are_split(spark):
    for seed, limit in ((1, 20_000), (2, 5)):
        prints = clustered(seed)
        want = grouped((signed(p), r) for p, r in brute_components(prints).items())
        df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
        edges = simhash.links(df, shard_rows=limit)
        assert all((r["a"] ^ r["b"]) & (1 << 64) - 1 for r in edges.collect())
        assert grouped(tuple(r) for r in C.components(edges).collect()) == want


def test_tree_links_are_a_forest():
    tree = simhash.BKTree(3)
    values = sorted(clustered(5))
    for v in values:
        tree.add(v)
    assert len(tree.links()) < len(values)
    want = grouped(brute_components(values).items())
    assert grouped((v, tree.find(i)) for i, v in enumerate(values)) == want


def test_components_of_a_long_path(spark):
    path = spark.range(20).selectExpr("id as a", "id + 1 as b")
    assert {r["root"] for r in C.components(path).collect()} == {0}
    assert C.components(path.where("a < 0")).count() == 0


def test_awkward_rows(spark):
    docs = frame(spark, AWKWARD)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(AWKWARD)
    assert {r["component_id"] for r in got if r["fp"] == 0} == {0}
    assert {r["component_id"] for r in got if r["id"] in (3, 4)} == {3}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [
        (False, 0), (False, 3), (False, 5), (False, 6), (False, 7), (False, 8), (True, 0),
    ]
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.keep_one(frame(spark, [])).count() == 0


def test_near_copies_go_and_others_stay(spark):
    base = prose("base", 400).split()
    near = [*base]
    near[200] = "changed"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, prose("other", 400)), (4, " ".join(base).upper())]
    assert {r["doc_id"] for r in simhash.keep_one(frame(spark, rows)).collect()} == {1, 3}
