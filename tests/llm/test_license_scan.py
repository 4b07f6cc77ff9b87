"""License scan against a look at every place; awkward rows."""

import random
import re

from cases import AWKWARD, SF, frame, prose

from quillspark.llm import license_scan as L
from quillspark.llm import queries


def normal(text):
    return [w for w in re.split(L.SEPARATOR, (text or "").lower()) if w]


def grams(w):
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(docs, texts=L.TEMPLATES, least=0.8):
    """(doc, license) of every template that a stretch of the template's length and margin holds."""
    out = set()
    for d, text in docs:
        w = normal(text)
        for name, notice in texts:
            v = normal(notice)
            want, margin = grams(v), -(-len(v) // 4)
            if not v or not want & grams(w):
                continue
            for at in range(len(w)):
                region = w[max(0, at - margin) : at + len(v) + margin]
                if len(want & grams(region)) >= least * len(want):
                    out.add((d, name))
                    break
    return out


def test_query_against_every_place(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {(r["doc_id"], r["license"]) for r in queries.op3_license_scan(spark, SF).collect()}
    assert got == brute(docs) and got


def test_whole_and_edited_notices(spark):
    rng = random.Random(2)
    docs = []
    for d in range(80):
        name, notice = L.TEMPLATES[d % len(L.TEMPLATES)]
        words = notice.split()
        if d >= 40 and len(words) > 25:
            words[rng.randrange(len(words))] = "changed"
        docs.append((d, f"{prose(d, d)} {' '.join(words).upper() if d % 3 else '* '.join(words)} {prose(1000 + d, 2 * d)}"))
    docs += [(200, prose(7, 300)), (201, "Released under the license of the MIT")]
    got = {(r["doc_id"], r["license"]) for r in L.scan(frame(spark, docs)).collect()}
    want = brute(docs)
    assert got <= want and len(got) >= 0.98 * len(want)
    assert {d for d, _ in got} >= set(range(40)) and not {d for d, _ in got} & {200, 201}


def test_awkward_rows(spark):
    texts = [("X", "two words"), ("Y", prose(2, 80)), ("Z", ""), ("Y2", prose(2, 80))]
    rows = [*AWKWARD, (60, "Two, words!"), (61, "one two words here")]
    got = sorted((r["doc_id"], r["license"]) for r in L.scan(frame(spark, rows), texts=texts).collect())
    assert got == [(3, "Y"), (3, "Y2"), (4, "Y"), (4, "Y2"), (60, "X")]
    assert L.scan(frame(spark, [])).count() == 0
    assert L.scan(frame(spark, rows), texts=[]).count() == 0
