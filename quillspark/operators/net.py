"""A feed-forward net over sparse rows: hidden layers of 64, 64 and 16 rectified units, one logit, Adam.

No row is ever made dense, and neither the driver nor one task holds the first layer, which has 64 weights per feature:

1. Rows are dealt into blocks of at most ``BLOCK``; a block keeps its sparse cells and the list of its own features.
2. A round trains every block by itself for ``EPOCHS`` passes in small batches, on the weights of its own features.
3. The blocks' weights meet by feature group and are averaged, in proportion to the training cells a block has of a
   feature (of the later layers: to its training rows), and go back to the blocks that asked for them.

What moves in a round is 64 numbers per feature and block, so it grows with the rows. Adam's moments start anew each
round, and those of a feature stand still while no row of a batch has it. Held-out rows lie in the same blocks without
weight in the training, and are scored by the averaged weights of the last round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import cut_lineage

BLOCK = 1 << 14
EPOCHS = 7
BATCH = 64
RATE = 1e-3
LAYERS = (64, 64, 16, 1)
GROUP = 1 << 16  # weights of so many features meet in one group
REST = -1  # the group of the later layers

_BLOCK = "block long, ids binary, trained binary, y binary, ends binary, features binary, at binary, value binary"
_MESSAGE = "block long, part int, features binary, weight binary, share binary"
_SHAPES = [(LAYERS[0],)] + [s for a, b in zip(LAYERS, LAYERS[1:]) for s in ((a, b), (b,))]


def _array(cell: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(cell.as_py(), kind)


def blocks(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row per block of the rows (id, trained, y, indices, values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], TaskContext.get().partitionId() << 32
        for batch in batches:
            held.append(batch)
            while sum(map(len, held)) >= size:
                table = pa.Table.from_batches(held)
                yield packed(table.slice(0, size), number)
                held, number = table.slice(size).to_batches(), number + 1
        if sum(map(len, held)):
            yield packed(pa.Table.from_batches(held), number)

    def packed(table: pa.Table, number: int) -> pa.RecordBatch:
        column = {c: table.column(c).combine_chunks() for c in table.column_names}
        ends = np.cumsum(column["values"].value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        features, at = np.unique(column["indices"].flatten().to_numpy(), return_inverse=True)
        cells = [
            column["id"].to_numpy().astype(np.int64), column["trained"].to_numpy(zero_copy_only=False).astype(bool),
            column["y"].to_numpy().astype(np.float32), ends, features.astype(np.int32), at.astype(np.int32),
            column["values"].flatten().to_numpy().astype(np.float32),
        ]
        names = ["block", "ids", "trained", "y", "ends", "features", "at", "value"]
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), *[pa.array([c.tobytes()], pa.binary()) for c in cells]], names=names
        )

    return rows.mapInArrow(run, _BLOCK)


class _Block:
    def __init__(self, table: pa.Table):
        cell = lambda name, kind: _array(table.column(name)[0], kind)
        self.number = table.column("block")[0].as_py()
        self.ids, self.trained, self.y = cell("ids", np.int64), cell("trained", bool), cell("y", np.float32)
        self.ends = np.concatenate(([0], cell("ends", np.int64)))
        self.features, self.at, self.value = cell("features", np.int32), cell("at", np.int32), cell("value", np.float32)

    def cells(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the cells of ``rows`` one row after the other, and where each row's begin and end among them."""
        sizes = self.ends[rows + 1] - self.ends[rows]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return np.arange(ends[-1]) + np.repeat(self.ends[rows] - ends[:-1], sizes), ends

    def matrix(self, places: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The features of some rows, and the rows over these features alone."""
        used, at = np.unique(self.at[places], return_inverse=True)
        x = np.zeros((len(ends) - 1, len(used)), np.float32)
        x[np.repeat(np.arange(len(ends) - 1), np.diff(ends)), at] = self.value[places]
        return used, x


def first_weights(features: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Uniform weights of the first layer, drawn from the number of the feature alone."""
    x = features.astype(np.uint64)[:, None] * np.uint64(LAYERS[0]) + np.arange(LAYERS[0], dtype=np.uint64)
    x = x + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    unit = (x ^ (x >> np.uint64(31))) >> np.uint64(11)
    return ((unit * (2.0 / (1 << 53)) - 1) / np.sqrt(width)).astype(np.float32)


def first_rest(width: int, seed: int) -> list[np.ndarray]:
    """The bias of the first layer, and weights and biases of the later ones."""
    draw, fan = np.random.default_rng(seed), [width, *[n for n in LAYERS[:-1] for _ in range(2)]]
    return [(draw.uniform(-1, 1, s) / np.sqrt(n)).astype(np.float32) for s, n in zip(_SHAPES, fan, strict=True)]


def _forward(z: np.ndarray, rest: list[np.ndarray]) -> list[np.ndarray]:
    """Units of every layer; the last are the logits."""
    units = [np.maximum(z + rest[0], 0)]
    for k in range(1, len(rest), 2):
        out = units[-1] @ rest[k] + rest[k + 1]
        units.append(np.maximum(out, 0) if k + 2 < len(rest) else out)
    return units


def _backward(units: list[np.ndarray], y: np.ndarray, rest: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Gradients of the mean cross-entropy by the first layer's sums and by ``rest``."""
    slope = (1 / (1 + np.exp(-np.clip(units[-1], -30, 30))) - y[:, None]) / np.float32(len(y))
    found = []
    for k in range(len(rest) - 2, 0, -2):
        below = units[(k - 1) // 2]
        found = [below.T @ slope, slope.sum(0), *found]
        slope = (slope @ rest[k].T) * (below > 0)
    return slope, [slope.sum(0), *found]


def _adam(grad: np.ndarray, m: np.ndarray, v: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
    change = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return m.astype(np.float32), v.astype(np.float32), change.astype(np.float32)


def train_block(block: _Block, weight: np.ndarray, rest: list[np.ndarray], epochs: int, seed: Sequence[int]) -> None:
    """Trains ``weight`` and ``rest`` in place on the block's training rows."""
    rows = np.flatnonzero(block.trained)
    moments = [np.zeros_like(weight), np.zeros_like(weight)]
    others = [[np.zeros_like(r), np.zeros_like(r)] for r in rest]
    draw, step = np.random.default_rng(list(seed)), 0
    for _ in range(epochs):
        dealt = draw.permutation(rows)
        for begin in range(0, len(dealt), BATCH):
            batch = dealt[begin : begin + BATCH]
            used, x = block.matrix(*block.cells(batch))
            slope, grads = _backward(_forward(x @ weight[used], rest), block.y[batch], rest)
            step += 1
            moments[0][used], moments[1][used], change = _adam(x.T @ slope, moments[0][used], moments[1][used], step)
            weight[used] -= change
            for r, g, o in zip(rest, grads, others, strict=True):
                o[0], o[1], change = _adam(g, o[0], o[1], step)
                r -= change


def _message(number: int, part: int, features: np.ndarray, weight: np.ndarray, share: np.ndarray) -> dict:
    return {
        "block": number, "part": part, "features": features.astype(np.int32).tobytes(),
        "weight": weight.astype(np.float32).tobytes(), "share": share.astype(np.int32).tobytes(),
    }


def _table(messages: list[dict]) -> pa.Table:
    types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.Table.from_pylist(
        messages, pa.schema(list(zip(("block", "part", "features", "weight", "share"), types, strict=True)))
    )


def _flat(rest: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([r.ravel() for r in rest])


def _split(flat: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum([int(np.prod(s)) for s in _SHAPES])[:-1]
    return [a.reshape(s).copy() for a, s in zip(np.split(flat, ends), _SHAPES, strict=True)]


def _received(block: _Block, messages: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    weight, rest = np.zeros((len(block.features), LAYERS[0]), np.float32), []
    for k in range(len(messages)):
        values = _array(messages.column("weight")[k], np.float32)
        if messages.column("part")[k].as_py() == REST:
            rest = _split(values)
        else:
            at = np.searchsorted(block.features, _array(messages.column("features")[k], np.int32))
            weight[at] = values.reshape(-1, LAYERS[0])
    return weight, rest


def averaged(messages: DataFrame) -> DataFrame:
    """The blocks' weights of a feature replaced by their mean in proportion to ``share``."""

    def run(table: pa.Table) -> pa.Table:
        rest = table.column("part")[0].as_py() == REST
        lists = [_array(c, np.int32) for c in table.column("features")]
        wide = len(_flat([np.zeros(s) for s in _SHAPES])) if rest else LAYERS[0]
        known, at = np.unique(np.concatenate(lists), return_inverse=True)
        places = np.split(at, np.cumsum([len(f) for f in lists])[:-1])
        total, shares = np.zeros((len(known), wide)), np.zeros(len(known))
        plain, asked = np.zeros((len(known), wide)), np.zeros(len(known))
        for k, place in enumerate(places):
            values = _array(table.column("weight")[k], np.float32).reshape(-1, wide)
            share = _array(table.column("share")[k], np.int32)
            total[place] += values * share[:, None]
            shares[place] += share
            plain[place] += values
            asked[place] += 1
        # what no training row has keeps the weights it began with, which all blocks share
        mean = np.where(shares[:, None] > 0, total / np.maximum(shares, 1)[:, None], plain / asked[:, None])
        return _table(
            [
                _message(table.column("block")[k].as_py(), table.column("part")[k].as_py(), lists[k], mean[p], np.zeros(0))
                for k, p in enumerate(places)
            ]
        )

    return messages.groupBy("part").applyInArrow(run, _MESSAGE)


def fit_predict(
    train: DataFrame, test: DataFrame, width: int, seed: int = 0, max_iter: int | None = None, size: int = BLOCK
) -> DataFrame:
    """``test`` with the column ``pred`` of a net trained on ``train`` for ``max_iter`` passes (49)."""
    passes = max_iter or 49
    test = cut_lineage(test.withColumn("_id", F.monotonically_increasing_id()))
    cells = F.unwrap_udt("features")
    rows = (
        train.select(F.lit(-1).cast("long").alias("id"), F.lit(True).alias("trained"), "target", "features")
        .unionAll(test.select("_id", F.lit(False), "target", "features"))
        .select("id", "trained", F.coalesce("target", F.lit(0)).cast("double").alias("y"), cells.alias("_f"))
        .select(
            "id", "trained", "y", F.col("_f.values").alias("values"),
            F.coalesce(
                "_f.indices",  # a dense vector has none
                F.transform("_f.values", lambda _, i: i),
            ).alias("indices"),
        )
    )
    rows = cut_lineage(rows)
    packed = cut_lineage(blocks(rows.repartition(rows.count() // size + 1), size))
    # 4 bytes a feature of every block, so the groups are as many as the weights that move ask for
    moved = packed.agg(F.sum(F.length("features"))).first()[0] or 0
    groups = moved // (4 * GROUP) + 1

    def told(block: _Block, weight: np.ndarray, rest: list[np.ndarray]) -> pa.Table:
        trained = np.repeat(block.trained, np.diff(block.ends))
        share = np.bincount(block.at[trained], minlength=len(block.features))
        out = [_message(block.number, REST, np.zeros(1), _flat(rest), np.array([block.trained.sum()]))]
        for part in range(groups):
            own = np.flatnonzero(block.features % groups == part)
            if len(own):
                out.append(_message(block.number, part, block.features[own], weight[own], share[own]))
        return _table(out)

    def begin(epochs: int) -> Callable:
        def run(table: pa.Table) -> pa.Table:
            block = _Block(table)
            weight, rest = first_weights(block.features, width, seed), first_rest(width, seed)
            train_block(block, weight, rest, epochs, [seed, block.number, 0])
            return told(block, weight, rest)

        return run

    def go_on(number: int, epochs: int) -> Callable:
        def run(table: pa.Table, messages: pa.Table) -> pa.Table:
            block = _Block(table)
            weight, rest = _received(block, messages)
            train_block(block, weight, rest, epochs, [seed, block.number, number])
            return told(block, weight, rest)

        return run

    def score(table: pa.Table, messages: pa.Table) -> pa.Table:
        block = _Block(table)
        weight, rest = _received(block, messages)
        held = np.flatnonzero(~block.trained)
        logits = [np.zeros(0, np.float32)]
        for first in range(0, len(held), BATCH):
            used, x = block.matrix(*block.cells(held[first : first + BATCH]))
            logits.append(_forward(x @ weight[used], rest)[-1][:, 0])
        pred = (np.concatenate(logits) > 0).astype(np.int32)
        return pa.table({"_id": block.ids[held], "pred": pred})

    rounds = [min(EPOCHS, passes - done) for done in range(0, passes, EPOCHS)]
    weights = averaged(packed.groupBy("block").applyInArrow(begin(rounds[0]), _MESSAGE))
    for number, epochs in enumerate(rounds[1:], 1):
        met = packed.groupBy("block").cogroup(weights.groupBy("block"))
        weights = averaged(met.applyInArrow(go_on(number, epochs), _MESSAGE))
    found = packed.groupBy("block").cogroup(weights.groupBy("block")).applyInArrow(score, "_id long, pred int")
    return test.join(cut_lineage(found), "_id").drop("_id")
