"""Rule ensemble: accuracy on held-out labels, rules against plain evaluation, awkward rows."""

import zlib

from cases import AWKWARD, frame, prose
from pyspark.sql import functions as F

from quillspark.llm import queries
from quillspark.llm import rule_ensemble as R

SF = "/root/testdata/sf0.01"


def test_query_on_held_out_labels(spark):
    rows = {r["doc_id"]: r for r in queries.op11_rule_ensemble(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in rows.items())
    unseen = [(rows[d]["predicted"], y) for d, y in labels if rows[d]["held_out"]]
    assert len(unseen) > 80 and {y for _, y in unseen} == {0, 1}
    for kind in (0, 1):
        own = [p == y for p, y in unseen if y == kind]
        assert sum(own) / len(own) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300).cache()
    labels = docs.select("doc_id", (F.length("text") > 1500).cast("int").alias("quality"))
    turned = labels.withColumn("quality", F.when(R.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert R.train(docs, labels) == R.train(docs, turned)
    assert R.train(docs, labels, train_rows=50) == R.train(docs, labels.repartition(3), train_rows=50)


def test_compiled_score_equals_the_rules(spark):
    ensemble = R.Ensemble(
        -0.5,
        ((R.Rule((("log_words", False, 1.5),)), 2.0), (R.Rule((("capitals", True, 0.1), ("symbols", False, 0.01))), -3.0)),
    )
    texts = ["", None, "one two three four five", "A B C D E", "# # * one two three four", prose(1, 300)]
    rows = frame(spark, list(enumerate(texts))).select(R.statistics(F.col("text")).alias("s"), ensemble.score(F.col("text")).alias("p")).collect()
    for r in rows:
        total = ensemble.intercept
        for rule, weight in ensemble.rules:
            if all((r["s"][s] <= t) if most else (r["s"][s] > t) for s, most, t in rule.terms):
                total += weight
        assert abs(r["p"] - 1 / (1 + 2.718281828459045 ** -total)) < 1e-9


def test_statistics(spark):
    text = "Hello world! x# 12\nHello world! x# 12\n\n| A"
    s = frame(spark, [(1, text)]).select(R.statistics(F.col("text")).alias("s")).collect()[0]["s"]
    n, size = 10, len("".join(text.split()))
    assert abs(s["word_length"] - size / n) < 1e-9 and abs(s["capitals"] - 3 / size) < 1e-9
    assert abs(s["digits"] - 4 / size) < 1e-9 and abs(s["symbols"] - 2 / size) < 1e-9
    assert abs(s["bars"] - 1 / n) < 1e-9 and abs(s["marks"] - 2 / n) < 1e-9
    assert abs(s["ends_in_symbol"] - 5 / n) < 1e-9 and abs(s["plain_words"] - 3 / n) < 1e-9
    assert abs(s["distinct_words"] - 6 / n) < 1e-9 and abs(s["distinct_lines"] - 2 / 3) < 1e-9
    assert abs(s["distinct_windows"] - 6 / 8) < 1e-9


def test_paths_of_a_tree():
    text = """RandomForestClassificationModel: uid=x, numTrees=1
  Tree 0 (weight 1.0):
    If (feature 0 <= 1.5)
     If (feature 0 <= 0.5)
      Predict: 0.0
     Else (feature 0 > 0.5)
      Predict: 1.0
    Else (feature 0 > 1.5)
     Predict: 1.0
"""
    s = R.STATISTICS[0]
    assert [r.terms for r in R.tree_rules(text)] == [
        ((s, True, 1.5),), ((s, True, 0.5),), ((s, False, 0.5), (s, True, 1.5)), ((s, False, 1.5),),
    ]


def test_awkward_rows(spark):
    docs = frame(spark, AWKWARD)
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)] + [(None, 1), (3, None)], "doc_id long, quality int")
    rows = R.score(docs, R.train(docs, labels)).collect()
    assert len(rows) == len(AWKWARD) and all(r["score"] is not None and r["held_out"] is not None for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert by[0] == by[2] and len(by[3]) == 1
    none = R.train(docs, labels.limit(0))
    assert none.rules == () and {r["score"] for r in R.score(docs, none).collect()} == {0.5}
    only = R.train(docs, spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int"))
    assert only.rules == () and all(r["predicted"] == 1 for r in R.score(docs, only).collect())
    assert R.score(frame(spark, []), none).count() == 0
    assert R.train(frame(spark, []), labels).rules == ()
