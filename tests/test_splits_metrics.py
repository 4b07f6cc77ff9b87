import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from quillspark.operators import metrics as M
from quillspark.operators import splits as H


def sizes(rows, by):
    out = {}
    for r in rows:
        out[r[by]] = out.get(r[by], 0) + 1
    return out


def test_folds(spark):
    df = spark.range(103).withColumn("y", (F.col("id") < 20).cast("int"))
    folds = sizes(H.kfold(df, "id", 10, 1).collect(), "fold")
    assert len(folds) == 10 and max(folds.values()) - min(folds.values()) <= 1
    strat = H.stratified_kfold(df, "id", "y", 10, 1).collect()
    assert sizes([r for r in strat if r.y == 1], "fold") == {i: 2 for i in range(10)}
    assert H.kfold(df, "id", 10, 1).exceptAll(H.kfold(df.repartition(5), "id", 10, 1)).count() == 0
    parts = H.tail_split(df, "id", 0.2).collect()
    assert sizes(parts, "part") == {"train": 83, "test": 20}
    assert all((r.id >= 83) == (r.part == "test") for r in parts)
    sets = H.fold_sets(H.kfold(df, "id", 10, 1), "id", 0, 0.1).collect()
    assert sum(sizes(sets, "part").values()) == 103 and sizes(sets, "part")["val"] == 9
    held = sizes(H.random_holdout(df, "id", 0.1, 1).collect(), "part")
    assert 2 <= held["test"] <= 20
    order = [r.id for r in H.shuffle(df, "id", 3).collect()]
    ranks = {r.id: r["rank"] for r in H.shuffle_rank(df, "id", 3).collect()}
    assert order != sorted(order) and [ranks[i] for i in order] == list(range(1, 104))


def predictions(spark, tp, fp, tn, fn, model="m", fold=0):
    rows = [(model, fold, 1, 1)] * tp + [(model, fold, 0, 1)] * fp + [(model, fold, 0, 0)] * tn + [(model, fold, 1, 0)] * fn
    return spark.createDataFrame(rows, "model string, fold int, y int, pred int")


def test_metrics(spark):
    p = predictions(spark, 3, 1, 4, 2)
    rows = {r.Fold: r for r in M.metrics_by_fold(p.unionByName(predictions(spark, 1, 0, 1, 0, fold=1))).collect()}
    assert tuple(rows["0"])[2:] == (70.0, 75.0, 60.0, 66.667, 0.7, 0.775)
    assert rows["AVG"].Accuracy == 85.0 and rows["AVG"].AUC == 0.85
    scored = p.select(F.col("y").cast("double"), F.col("pred").cast("double"))
    auc = BinaryClassificationEvaluator(rawPredictionCol="pred", labelCol="y").evaluate(scored)
    assert auc == pytest.approx(0.7)
    lone = M.metrics_by_fold(predictions(spark, 0, 0, 3, 1)).where("Fold = '0'").first()
    assert (lone.Precision, lone.Recall, lone.F1, lone.PRAUC) == (0, 0, 0, 0.625)
    one_class = M.metrics_by_fold(predictions(spark, 2, 0, 0, 1)).first()
    assert one_class.AUC is None


def test_best_and_totals(spark):
    p = predictions(spark, 3, 1, 4, 2, "a").unionByName(predictions(spark, 5, 0, 5, 0, "b"))
    assert M.best_model(M.metrics_by_fold(p)).first().Model == "b"
    assert {r.author: r.n for r in M.predicted_totals(p, "x", "y").collect()} == {"x": 11, "y": 9}


def test_reports(spark):
    df = spark.createDataFrame([("a b", "u"), ("abcd", "v"), ("a", "u")], "text string, who string")
    assert tuple(M.sequence_stats(df).first()) == (3, 4, 1, 2)
    got = {r.measure: r.value for r in M.corpus_report(df, "who").collect()}
    assert got["terms"] == 3 and got["class:u"] == 2 and got["max_len"] == 4
    assert {r.who: round(r.ratio, 3) for r in M.class_balance(df, "who").collect()} == {"u": 0.667, "v": 0.333}
    assert M.vocabulary_size(df, approximate=True).first().terms == 3
