"""Connected components of an edge table, by contraction in rounds.

In a round each node points to its least neighbour (or itself), pointers are followed until they settle, and
edges are redrawn between the nodes they lead to; nodes that nothing joins any more leave. Each round at least
halves what is left of a path-like component, and a star is gone after two. All state is in scratch tables, so
a lost executor costs a re-read; both sides of every join are plain exchanges, which adaptive execution splits
where a hub makes them uneven.

Defined cases: edges from a node to itself and repeated edges count for nothing; a node without an edge to another
one is in no row; null ends are in no edge; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: (a, b). Returns (node, component), component the least node, for every node that has an edge."""
    left = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).select("node", F.least("node", "up").alias("up"))
        up = materialize(up, "cc-up")
        while True:  # pointer doubling: pointers only ever go down, so this ends
            of = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            further = materialize(up.join(of, "up", "left").select("node", F.coalesce("top", "up").alias("up"), (F.col("top") < F.col("up")).alias("moved")), "cc-up")
            moved = not further.where("moved").isEmpty()
            release(up)
            up = further
            if not moved:
                break
        up = _slim(up)
        if labels is None:
            new = up.select("node", F.col("up").alias("component"))
        else:
            new = labels.join(up.select(F.col("node").alias("component"), "up"), "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        new = materialize(new, "cc-labels")
        a = up.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        b = up.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        redrawn = left.join(a, "a").join(b, "b").where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct()
        redrawn = materialize(redrawn, "cc-edges")
        release(left, up, *([labels] if labels is not None else []))
        left, labels = redrawn, new
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels


def _slim(up: DataFrame) -> DataFrame:
    out = up.select("node", "up")
    out.scratch_path = up.scratch_path
    return out
