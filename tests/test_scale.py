import itertools

from pyspark.sql import functions as F

from quillspark.operators import scale as S


def test_running_total_and_rank(spark):
    rows = spark.range(500).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise("cold"))
    out = S.running_total(
        rows, F.col("id"), [F.md5(F.col("id").cast("string"))],
        F.substring(F.md5(F.col("id").cast("string")), 1, 4), ["g"],
    ).withColumn("m", F.md5(F.col("id").cast("string"))).collect()
    for g, part in itertools.groupby(sorted(out, key=lambda r: (r.g, r.m)), key=lambda r: r.g):
        total = 0
        for r in part:
            total += r.id
            assert r.running == total
    ranks = S.md5_rank(rows, F.col("id"), ["id"], ["g"]).collect()
    for g in ("hot", "cold"):
        got = sorted(r["rank"] for r in ranks if r.g == g)
        assert got == list(range(1, len(got) + 1))


def test_null_group(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id long, g string")
    got = {r.id: r["rank"] for r in S.md5_rank(rows, F.col("id"), ["id"], ["g"]).collect()}
    assert sorted([got[1], got[2]]) == [1, 2] and got[3] == 1


def test_global_index(spark):
    rows = spark.range(1000).repartition(7)
    assert S.global_index(rows, F.desc("id")).where("id + idx <> 999").count() == 0
    assert S.global_index(rows.where("id < 0"), "id").count() == 0


def test_lookup_join_equals_left_join(spark):
    lookup = spark.createDataFrame(
        [(f"k{i}", i, 5000 if i == 0 else 1) for i in range(2000)], "k string, v int, n int"
    )
    left = spark.range(6000).withColumn(
        "k",
        F.when(F.col("id") % 3 == 0, "k0").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(
            F.concat(F.lit("k"), F.col("id").cast("string"))
        ),
    )
    got = S.lookup_join(left, lookup, ["k"], ["v"], "n", ["id"])
    want = left.join(lookup.select("k", "v"), "k", "left").select("id", "k", "v")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_small_side_hints_only_below_the_limit(spark):
    df = spark.range(10)
    assert "broadcast" in S.small_side(df, 10)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in S.small_side(df, 9)._jdf.queryExecution().logical().toString().lower()


def test_null_keys_do_not_meet(spark):
    """Half of the rows have no key; without adaptive plans and broadcasts they still spread."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(8000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN NULL ELSE concat('k', id % 500) END AS k")
        table = spark.range(500).selectExpr("concat('k', id) AS k", "id AS v", "1L AS n")
        out = S.lookup_join(rows, table, ["k"], ["v"], "n", ["id"], share=0.5)
        sizes = [r[1] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 2 * 8000 / len(sizes) and len(sizes) > 4
        assert out.where("v IS NULL").count() == 4000 and out.where("k = concat('k', v)").count() == 4000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_texts_are_dealt_out_by_their_splits(spark):
    df = spark.range(0, 100, 1, 20)
    assert S.spread_scan(df, "id").rdd.getNumPartitions() == 20
    assert S.spread_texts(df, "id").rdd.getNumPartitions() == 160
    assert sorted(r.id for r in S.spread_texts(df, "id").collect()) == list(range(100))


def test_weights_are_joined_and_sorted_in_parts_that_follow_the_texts(spark):
    """Few texts a part, however few bytes they move: a sort holds several times what was moved."""
    from quillspark.operators import tfidf

    texts = spark.range(40_000).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("each"), F.concat(F.lit("w"), F.col("id") % 900)).alias("text")
    )
    weights, _ = tfidf.fit_transform(texts)
    parts = max(2 * spark.sparkContext.defaultParallelism, 11)
    assert weights.rdd.getNumPartitions() == parts
    assert weights.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 80_000 / parts * 2
    assert weights.count() == 80_000


def test_only_what_may_be_asked_is_moved(spark, monkeypatch):
    """With more keys than a broadcast takes, a bitmap stands before the exchange of the large side."""
    from quillspark.operators import scale

    rows = spark.range(20_000).select(F.col("id").cast("string").alias("ctx"), (F.col("id") * 2).alias("n"))
    asked = spark.range(0, 40_000, 40).select(F.col("id").cast("string").alias("ctx")).unionByName(
        spark.createDataFrame([(None,), ("40",)], "ctx string")
    )
    want = {str(i): 2 * i for i in range(0, 20_000, 40)}
    for few in (10, 10_000):
        got = scale.asked_only(rows, asked, ["ctx"], few)
        assert {r.ctx: r.n for r in got.collect()} == want and got.count() == len(want) and got.columns == ["ctx", "n"]
    plan = scale.asked_only(rows, asked, ["ctx"], 10)._jdf.queryExecution().optimizedPlan().toString()
    # the bitmap is joined below, so deeper in the plan than, the join with the keys
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert len(joins) == 2 and "rightHint" in joins[1] and "_word" in joins[1]
