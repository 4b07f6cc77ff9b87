"""Connected components by repeated contraction.

Each round every node hooks onto its smallest neighbour, one pointer jump shortens the hooks, and the
edges are rewritten to the hooks' targets. Nodes that still have an edge at least halve each round, so
the number of rounds is logarithmic. Everything stays in Spark tables; the driver sees one flag a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import cut_lineage


def _renamed(edges: DataFrame, hooks: DataFrame) -> DataFrame:
    left = hooks.select(F.col("node").alias("a"), F.col("to").alias("ta"))
    right = hooks.select(F.col("node").alias("b"), F.col("to").alias("tb"))
    return (
        edges.join(left, "a")
        .join(right, "b")
        .where(F.col("ta") != F.col("tb"))
        .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edge table (a, b); the root is one node of its component."""
    edges = cut_lineage(
        edges.where("a != b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    found = None
    while found is None or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(
            F.least(F.first("a"), F.min("b")).alias("to")
        )
        jump = hooks.select(F.col("node").alias("to"), F.col("to").alias("next"))
        hooks = cut_lineage(hooks.join(jump, "to").select("node", F.col("next").alias("to")))
        edges = cut_lineage(_renamed(edges, hooks))
        if found is None:
            found = hooks.select("node", F.col("to").alias("root"))
        else:
            step = hooks.select(F.col("node").alias("root"), F.col("to").alias("next"))
            found = found.join(step, "root", "left").select(
                "node", F.coalesce("next", "root").alias("root")
            )
    return found
