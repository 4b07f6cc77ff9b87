"""The feed-forward net over sparse rows."""

import numpy as np
from pyspark.ml.linalg import Vectors

from quillspark.operators import models, net

WIDTH = 50_000_000  # dense rows of this width would be 400 MB each


def rows(spark, count):
    """A row of even number has one of the first features, one of odd number one of the last; one feature is in all."""
    data = [
        (i, i % 2, Vectors.sparse(WIDTH, [(i % 3) if i % 2 else WIDTH - 2 - i % 3, WIDTH - 1], [1.0, 0.5]))
        for i in range(count)
    ]
    return spark.createDataFrame(data, ["key", "target", "features"])


def test_rows_as_wide_as_a_vocabulary_stay_sparse(spark):
    data = rows(spark, 240)
    train, test = data.where("key >= 40"), data.where("key < 40")
    got, _ = models.fit_predict("nn", train, test, WIDTH, seed=1)
    assert got.count() == 40 and got.where("pred <> target").isEmpty()


def test_blocks_are_averaged_and_reruns_agree(spark):
    data = rows(spark, 240)
    train, test = data.where("key >= 40").repartition(3, "key"), data.where("key < 40")
    first, again = (net.fit_predict(train, test, WIDTH, seed=1, size=64).select("key", "target", "pred") for _ in range(2))
    assert first.count() == 40 and first.where("pred <> target").isEmpty()
    assert sorted(first.collect()) == sorted(again.collect())


def test_average_is_weighted_by_training_cells(spark):
    def message(block, features, value, share):
        return net._message(block, 0, np.array(features), np.full((len(features), 64), value), np.array(share))

    sent = [message(1, [5, 9], 1.0, [3, 0]), message(2, [5, 9], 5.0, [1, 0]), message(3, [7], 4.0, [2])]
    frame = spark.createDataFrame([tuple(m.values()) for m in sent], net._MESSAGE)
    got = {}
    for r in net.averaged(frame).collect():
        values = np.frombuffer(r.weight, np.float32).reshape(-1, 64)[:, 0]
        got[r.block] = dict(zip(np.frombuffer(r.features, np.int32).tolist(), values.tolist(), strict=True))
    assert got == {1: {5: 2.0, 9: 3.0}, 2: {5: 2.0, 9: 3.0}, 3: {7: 4.0}}


def test_gradients_follow_the_loss():
    draw = np.random.default_rng(3)
    rest = [r.astype(np.float64) for r in net.first_rest(4, 3)]
    z, y = draw.normal(size=(6, 64)), np.array([0, 1, 1, 0, 1, 0], float)

    def loss():
        logit = net._forward(z, rest)[-1][:, 0]
        return float(np.mean(np.logaddexp(0, logit) - y * logit))

    _, grads = net._backward(net._forward(z, rest), y, rest)
    for r, g in zip(rest, grads, strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        before, step = r[at], 1e-6
        r[at] = before + step
        up = loss()
        r[at] = before - step
        down = loss()
        r[at] = before
        assert abs((up - down) / (2 * step) - g[at]) < 1e-6


def test_blocks_keep_every_cell(spark):
    cells = spark.createDataFrame(
        [(i, i % 3 > 0, float(i % 2), [i, i + 7], [1.0, float(i)]) for i in range(25)],
        "id long, trained boolean, y double, indices array<int>, values array<double>",
    )
    found = {}
    for r in net.blocks(cells.repartition(2), 10).collect():
        ids, features = np.frombuffer(r.ids, np.int64), np.frombuffer(r.features, np.int32)
        at, value = np.frombuffer(r["at"], np.int32), np.frombuffer(r.value, np.float32)
        begin = 0
        for i, end in zip(ids.tolist(), np.frombuffer(r.ends, np.int64).tolist(), strict=True):
            found[i] = (features[at[begin:end]].tolist(), value[begin:end].tolist())
            begin = end
        assert len(ids) <= 10
    assert found == {i: ([i, i + 7], [1.0, float(i)]) for i in range(25)}
