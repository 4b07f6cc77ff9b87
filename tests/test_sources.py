import os

import pytest
from pyspark.sql import functions as F

from quillspark.operators import models
from quillspark.plans import classification as C
from quillspark.sources import constants as K
from quillspark.sources import readers as R
from quillspark.sources import writers as W
from quillspark.streaming.posts import feature_stream, read_post_stream

TRAIN = 'a1\tann\tHello "there\t2016-08-01 10:00:00\tandroid\na2\tbob\tBye #Now\t2016-08-02 11:30:00\tweb\n'


def write(folder, name, text):
    path = os.path.join(str(folder), name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf8") as f:
        f.write(text)
    return path


def test_posts(spark, tmp_path):
    path = write(tmp_path, "my_train.tsv", TRAIN)
    rows = R.read_posts(spark, path).orderBy("tweet_id").collect()
    assert rows[0].tweet_text == 'Hello "there' and rows[1].time_stamp.hour == 11
    extra = write(tmp_path, "x_test.tsv", "ann\thi\t2016-08-01 10:00:00\nbob\tshort\nc\td\te\tf\tg\n")
    got = {r.user_handle: r.time_stamp for r in R.load_text(spark, extra).collect()}
    assert got == {"ann": "2016-08-01 10:00:00", "bob": None}
    quoted = write(tmp_path, "q_test.tsv", 'ann\t"two\nlines\tand tabs"\t2016\nbob\tx\t2017\td\neve\t"a\tb"\n')
    got = {r.user_handle: r.tweet_text for r in R.load_text(spark, quoted).collect()}
    assert got == {"ann": "two\nlines\tand tabs", "eve": "a\tb"}
    long = write(tmp_path, "l_test.tsv", "ann\thi\t2016-08-01 10:00:00\nc\td\t2016-08-01 10:00:00\tf\tg\nbob\tx\n")
    assert sorted(r.user_handle for r in R.read_posts(spark, long).collect()) == ["ann", "bob"]
    assert R.load_dataset(spark, extra).columns == ["user_handle", "tweet_text"]
    with pytest.raises(ValueError):
        R.post_columns("posts.tsv")


def test_corpus_pairs_lists(spark, tmp_path):
    write(tmp_path, "corpus/a.txt", "one\ntwo")
    write(tmp_path, "corpus/deep/b.txt", "three")
    got = sorted(r.text for r in R.read_corpus(spark, str(tmp_path / "corpus")).collect())
    assert got == ["one two", "three"]
    pairs = write(tmp_path, "errors.tsv", "teh\tthe\nct\tcat\nteh\tten\n")
    assert {r.error: r.correct for r in R.read_error_pairs(spark, pairs).collect()} == {"teh": "ten", "ct": "cat"}
    table = write(tmp_path, "conf.tsv", "insertion\t#x\t4\ndeletion\tab\t2\nother\tab\t2\n")
    assert R.read_confusions(spark, table).count() == 2
    assert R.confusion_table(spark, {"insertion": {"ab": 1, "cd": 2}}).count() == 2
    stop = write(tmp_path, "stop.txt", "the\nof\n\nthe\n")
    assert R.word_list(R.read_word_list(spark, stop)) == ["of", "the"]
    assert R.punct_words(spark).count() == len(set(K.PUNCT_WORDS)) == 33


def test_sinks(spark, tmp_path):
    scores = spark.createDataFrame([("m", None), ("n", 1.5)], "Model string, F1 double").coalesce(1)
    for _ in range(2):
        W.write_scores(scores, str(tmp_path / "scores"))
    text = spark.read.text(str(tmp_path / "scores")).collect()
    assert sorted(r.value for r in text).count("m,NA") == 2
    pred = spark.createDataFrame([(i, i % 2) for i in range(20)], "pos int, pred int").repartition(4)
    W.write_predictions(pred, str(tmp_path / "pred"))
    parts = sorted(p for p in os.listdir(tmp_path / "pred") if p.startswith("part"))
    joined = "".join(open(tmp_path / "pred" / p).read() for p in parts)
    assert joined.split() == [str(i % 2) for i in range(20)] and "\n" not in joined
    W.save_stem_counts(scores, str(tmp_path / "stems"))
    assert spark.read.parquet(str(tmp_path / "stems")).count() == 2


def posts(spark, n=60):
    words = F.when(F.col("id") % 2 == 0, "apple pear apple").otherwise("stone metal iron")
    return spark.range(n).select(
        F.col("id").alias("post_id"),
        F.concat(words, F.lit(" w"), (F.col("id") % 5).cast("string")).alias("text"),
        F.expr("timestamp'2024-01-01 10:00:00' + make_interval(0,0,0,0,cast(id as int))").alias("ts"),
        (F.col("id") % 2).cast("int").alias("target"),
    )


def test_train_evaluate_save_predict(spark, tmp_path):
    task = C.Task(max_features=50, max_iter=10)
    data = posts(spark)
    preds = C.train_models(task, data, ["logreg", "svm_linear", "svm_rbf", "nn"], folds=2, seed=1)
    assert preds.count() == 4 * 60
    scores = {(r.Model, r.Fold): r for r in C.evaluate_models(preds).collect()}
    assert scores["logreg", "AVG"].Accuracy == 100 and scores["svm_linear", "AVG"].Accuracy == 100
    assert scores["svm_rbf", "AVG"].Accuracy > 80
    model, width = C.train_best_model(task, data, "logreg")
    path = W.save_model(model, str(tmp_path / "models"), "logreg", width)
    assert path.endswith(f"logreg__{width}")
    _, loaded = W.load_best_model(spark, str(tmp_path / "models"))
    got = C.predict(task, loaded, data).join(data, "post_id").where("pred <> target").count()
    assert got == 0
    leaky = C.train_models(task, data, ["logreg"], folds=2, stratified=False, leaky=True)
    assert leaky.count() == 60


def test_estimators_read_rows_without_vocabulary(spark, monkeypatch):
    """Every task of a fit carries the schema and the lineage of its rows."""
    seen, real = [], models.classifier

    class Spy:
        def __init__(self, *args):
            self.inner = real(*args)

        def fit(self, train):
            seen.append((train.schema["features"].metadata, train._jdf.queryExecution().toString()))
            return self.inner.fit(train)

    monkeypatch.setattr(models, "classifier", Spy)
    task = C.Task(max_iter=2)
    C.train_models(task, posts(spark, 20), ["logreg", "svm_rbf"], folds=2, seed=1)
    C.train_best_model(task, posts(spark, 20), "logreg")
    assert len(seen) == 5
    assert all(metadata == {} and "UDF" not in plan for metadata, plan in seen)


def test_feature_weights_match_the_long_form(spark):
    from quillspark.operators import tfidf as D

    task = C.Task(max_features=50)
    rows = C.prepare(task, posts(spark, 20))
    model = models.fit_features(rows, "terms", task.numeric, 2, 50)
    vocabulary = model.stages[0].vocabulary
    vectors = {r.post_id: r._tfidf for r in model.transform(rows).select("post_id", "_tfidf").collect()}
    weights, _ = D.fit_transform(posts(spark, 20), "post_id", "text", min_df=2)
    for r in weights.collect():
        assert vectors[r.post_id][vocabulary.index(r.term)] == pytest.approx(r.weight)


def test_stream(spark, tmp_path):
    write(tmp_path, "in/a_train.tsv", TRAIN)
    stream = feature_stream(read_post_stream(spark, str(tmp_path / "in")))
    query = (
        stream.select("tweet_id", "i_hash", "i_hours").writeStream.format("memory").queryName("feature_rows")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("feature_rows").collect()} == {("a1", 0, 10), ("a2", 1, 11)}


def test_folds_keep_no_vocabulary_on_the_driver(spark, monkeypatch):
    """Spark ML's counter and assembler keep every term and a name per feature there, for every fold."""

    def refused(*args, **options):
        raise AssertionError("the vocabulary was collected")

    monkeypatch.setattr(models, "CountVectorizer", refused)
    monkeypatch.setattr(models, "VectorAssembler", refused)
    names = ["logreg", "svm_linear", "svm_rbf", "nn"]
    got = C.train_models(C.Task(max_iter=5), posts(spark, 40), names, folds=2, seed=1)
    assert got.count() == 160 and got.where("model = 'logreg' and pred <> y").isEmpty()


def test_features_of_a_fold_match_the_pipeline(spark):
    task = C.Task(min_df=2)
    data = posts(spark, 40).withColumn("fold", F.col("post_id") % 4)
    data = data.withColumn("text", F.concat("text", F.lit(" only"), F.floor(F.col("post_id") / 2).cast("string")))
    rows = C.prepare(task, data)
    fitted = models.fold_terms(rows, "terms", 4, 2)
    for fold in (0, 3, None):
        pipeline = models.fit_features(rows if fold is None else rows.where(F.col("fold") != fold), "terms", task.numeric, 2)
        table, width = models.fold_features(fitted, task.numeric, fold, 2)
        assert width == models.width_of(pipeline, task.numeric)
        want = {r.post_id: r.features for r in pipeline.transform(rows).collect()}
        found = {r.post_id: r.features for r in table.collect()}
        assert len(found) == 40 and table.schema["features"].metadata == {}
        for key, vector in found.items():
            assert sorted(vector.values) == pytest.approx(sorted(v for v in want[key].toArray() if v))


def test_wide_fits_take_turns(spark):
    assert models.folds_at_once("logreg", 10_000, 4) == 4
    assert models.folds_at_once("svm_linear", 500_000, 4) == 1
    assert models.folds_at_once("svm_rbf", 500_000, 4) == 4
