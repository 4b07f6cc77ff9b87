"""Shared fixtures: awkward document rows and the driver's small tables."""

import os
import random

SF = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "id long, content string, size long, kept string, fp string, host string, words string, start string, target string"
)


def prose(seed, n):
    rng = random.Random(str(seed))
    syllables = "ka lo mi ner tas vu shel dro pin gor ath ely".split()
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))


def frame(spark, rows, source="s"):
    """Documents from (doc_id, text) or (doc_id, text, source), with further columns whose names clash."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else source, None, *[None] * 9) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


LONG = prose("long", 60_000)
AWKWARD = [
    (None, None),
    (None, prose(1, 70)),
    (0, ""),
    (1, " \n\t\x0b\x0c\r "),
    (2, None),
    (3, prose(2, 80)),
    (3, prose(2, 80)),
    (4, prose(2, 80)),
    (5, LONG),
    (6, "ein Wort"),
    (7, "naïve façade \U0001f600 ÉCOLE " * 30),
    (8, prose(3, 60) + "\n" + prose(4, 60)),
]


def tables(con):
    for name in sorted(os.listdir(SF)):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def ordered(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("" if r[i] is None else str(r[i]) for i in order) for r in records)
