"""Merkle dataset manifest over concatenated-level strings.

Every row is a leaf: the sha256 of its fields, each written as byte count, colon and value, or ``-`` if null. The
leaves of a group ascend by id; every ``FAN`` consecutive nodes become their hash, up to the group's subroot, and
the subroots in the order of their groups give the root in the same way.

1. Leaves are range-partitioned and sorted by (group, id, leaf) and written once. A leaf's position is its place in
   its sorted part plus the sizes of the group's parts before it, one small row per part.
2. ``FAN ** DEPTH`` (512) consecutive positions are an aligned block: one row with its leaves' hex digests as one
   string. Fixed-width substrings of that string are hashed to the next level's string, up to the block's top node.
3. The tops are the leaves of the next round, so a round divides the table by 512 and nothing grows with it: no
   driver loop over rows, no task that holds more than a block.
4. On the way down, the siblings of a node are the substrings on either side of it in the level strings of its
   block, followed by those of its block's top; a proof is their concatenation.

The strings are held as the bytes of their hex digits, since substrings of bytes start without a scan.

Defined results: null ids come first, a null group before all others; equal ids are ordered by their leaf, and
repeated rows are leaves of their own; a null field counts as ``-``, an empty text as ``0:``; a table of one row has
its leaf as root; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.let import let
from quillspark.llm.common import stored

FAN = 8
DEPTH = 3
BLOCK = FAN**DEPTH
HEX = 64

_PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A nullable value as it enters a leaf."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def fold(path: Column, start: Column) -> Column:
    """The root that ``start`` leads to along the siblings of ``path``."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def siblings(path: Column) -> Column:
    """All siblings of a proof, level by level and left to right, as one string."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def _digits(node: Column) -> Column:
    return F.lower(F.hex(node))


def _placed(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``rows`` with ``at``, the position in their ``grp``, and ``total``, the size of the group."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = stored(
        dealt.select(
            "*",
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("seq"),
        ),
        "leaves",
    )
    runs = held.groupBy("grp", "part").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("grp")
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(
        F.col("grp").alias("of"),
        F.col("part").alias("of_part"),
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("offset"),
        F.sum("n").over(group).alias("total"),
    )
    same = F.col("grp").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part"))
    return held.join(offsets, same).select(*rows.columns, (F.col("seq") + F.col("offset")).alias("at"), "total")


def _parents(level: Column) -> Column:
    """The next level's string: the hash of every run of ``FAN`` digests."""
    width = FAN * HEX
    runs = F.sequence(F.lit(0), F.floor((F.octet_length(level) - 1) / width).cast("int"))
    return F.array_join(
        F.transform(runs, lambda i: F.sha2(F.substring(level, i * width + 1, F.lit(width)), 256)), ""
    ).cast("binary")


def _steps(total: Column) -> Column:
    """Levels above the leaves in a block of a group of ``total`` nodes."""
    steps = F.lit(DEPTH)
    for k in reversed(range(DEPTH)):
        steps = F.when(total <= FAN**k, F.lit(k)).otherwise(steps)
    return steps


def _blocks(nodes: DataFrame) -> DataFrame:
    """(grp, total, block, members, levels, top) from (grp, total, at, node, carry)."""
    member = F.struct((F.col("at") % BLOCK).cast("int").alias("at"), "node", "carry")
    packed = nodes.groupBy("grp", "total", F.floor(F.col("at") / BLOCK).alias("block")).agg(
        F.array_sort(F.collect_list(member), lambda a, b: a["at"] - b["at"]).alias("members")
    )
    level = F.array_join(F.transform("members", lambda m: _digits(m["node"])), "").cast("binary")
    packed = packed.withColumn("level_0", level)
    for k in range(DEPTH):
        above = F.when(_steps(F.col("total")) > k, _parents(F.col(f"level_{k}")))
        packed = packed.withColumn(f"level_{k + 1}", above)
    top = F.coalesce(*[F.col(f"level_{k}") for k in reversed(range(DEPTH + 1))])
    return packed.withColumn("top", F.unhex(top.cast("string")))


def _own_path(at: Column) -> Column:
    """Siblings of the member ``at`` inside its block, from its own level up."""
    parts = []
    for k in range(DEPTH):
        place = F.shiftright(at, 3 * k)
        inside, level = place.bitwiseAND(F.lit(FAN - 1)), F.col(f"level_{k}")
        left = F.substring(level, (place - inside) * HEX + 1, inside * HEX)
        right = F.substring(level, (place + 1) * HEX + 1, (FAN - 1 - inside) * HEX)
        parts.append(F.struct(left.cast("string").alias("left"), right.cast("string").alias("right")))
    return F.slice(F.array(*parts), F.lit(1), _steps(F.col("total")))


def _tree(nodes: DataFrame, above: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(grp, at, node, carry, path, subroot, root) from (grp, total, at, node, carry); ``above`` turns the groups'
    subroots (grp, subroot) into what stands above them (grp, subroot, root, path)."""
    rounds = []
    while True:
        blocks = stored(_blocks(nodes), "blocks")
        rounds.append(blocks)
        if (blocks.agg(F.max("total")).first()[0] or 0) <= BLOCK:
            break
        nodes = blocks.select(
            "grp", F.ceil(F.col("total") / BLOCK).alias("total"), F.col("block").alias("at"), F.col("top").alias("node"),
            F.lit(None).cast("binary").alias("carry"),
        )
    # the last round has one block per group
    upper = above(rounds[-1].select("grp", _digits(F.col("top")).alias("subroot"))).withColumn("at", F.lit(0).cast("long"))
    for number, blocks in reversed(list(enumerate(rounds))):
        known = upper.select(F.col("grp").alias("of"), F.col("at").alias("of_at"), F.col("path").alias("upper"), "subroot", "root")
        same = F.col("grp").eqNullSafe(F.col("of")) & (F.col("block") == F.col("of_at"))
        carry = blocks.schema["members"].dataType.elementType["carry"].dataType
        rows = blocks.join(known, same).select(
            "grp", "block", "subroot", "root",
            F.explode(
                F.transform(
                    "members",
                    lambda m: F.struct(
                        m["at"].alias("at"), m["node"].alias("node"), m["carry"].alias("carry"),
                        F.concat(_own_path(m["at"]), F.col("upper")).alias("path"),
                    ),
                )
            ).alias("m"),
        )
        upper = rows.select(
            "grp", (F.col("block") * BLOCK + F.col("m.at")).alias("at"), "m.node", F.col("m.carry").cast(carry).alias("carry"),
            "m.path", "subroot", "root",
        )
        if number:
            upper = stored(upper, "paths")
    return upper


def _over_groups(subroots: DataFrame) -> DataFrame:
    """What stands above each group: the tree over the subroots in the order of their groups."""
    rows = subroots.select(
        F.lit(0).alias("grp"), F.unhex("subroot").alias("node"), F.struct(F.col("grp").alias("group")).alias("carry")
    )
    placed = _placed(rows, [F.col("carry.group").asc_nulls_first()])
    empty = F.array().cast(_PATH)
    tree = _tree(placed, lambda top: top.select("grp", "subroot", F.col("subroot").alias("root"), empty.alias("path")))
    return tree.select(F.col("carry.group").alias("grp"), _digits(F.col("node")).alias("subroot"), "root", "path")


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    group: str = "lang",
    id: str = "doc_id",
    other: Column | None = None,
) -> DataFrame:
    """(id, group, leaf, other, subroot, root, path) for every row. ``path`` holds the siblings of each level,
    left and right of the node, from the leaf to the root; ``other`` is a second digest to carry along, such as
    the leaf of a changed copy."""
    other = F.lit(None).cast("string") if other is None else other
    rows = docs.select(
        F.col(group).alias("grp"),
        F.unhex(leaf(*[F.col(c) for c in fields])).alias("node"),
        F.struct(F.col(id).alias("id"), F.unhex(other).alias("other")).alias("carry"),
    )
    order = [F.col("grp").asc_nulls_first(), F.col("carry.id").asc_nulls_first(), F.col("node").asc()]
    return _tree(_placed(rows, order), _over_groups).select(
        F.col("carry.id").alias("id"),
        F.col("grp").alias("group"),
        _digits(F.col("node")).alias("leaf"),
        _digits(F.col("carry.other")).alias("other"),
        "subroot",
        "root",
        "path",
    )


def verified(found: DataFrame) -> DataFrame:
    """``found`` with ``folded_root``, the root recomputed from ``other`` where there is one, else from the leaf, and
    ``verified``: whether it is the root."""
    rows = found.withColumn("folded_root", let(F.coalesce("other", "leaf"), lambda h: fold(F.col("path"), h)))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
