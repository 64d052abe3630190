"""Connected components by repeated contraction; links never reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import sized, small, written

#: Nodes up to which a round's moves are broadcast (16 bytes each); beyond it they are shuffled.
NODE_BOUND = 1_000_000


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each node's component. ``links``: long columns a, b.

    In each round a node moves to its neighbour of the most links (ties by a hash of that round),
    if that comes before itself; the links between what remains are the next round's input.
    A star goes in one round, and a constant share of the nodes whatever the shape of the graph.
    Repeated links and loops count once and not at all, links with a null neither; no links give
    no rows.
    """
    left = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    n, moves = left.count(), []
    while n:
        both = left.select("a", "b").union(left.select("b", "a"))
        degree = written(sized(both.groupBy("a").agg(F.count("*").alias("d")).select(F.col("a").alias("node"), F.struct((-F.col("d")).alias("d"), F.xxhash64("a", F.lit(len(moves))).alias("h"), F.col("a").alias("n")).alias("r")), n), "degrees")
        near = small(degree, NODE_BOUND)
        best = both.join(near.toDF("b", "rb"), "b").groupBy("a").agg(F.min("rb").alias("rb")).join(near.toDF("a", "ra"), "a")
        move = written(sized(best.select(F.col("a").alias("node"), F.least("ra", "rb")["n"].alias("to")), n), "moves")
        moves.append(move)
        near = small(move, NODE_BOUND)
        step = left.join(near.toDF("a", "ta"), "a").join(near.toDF("b", "tb"), "b").where("ta <> tb")
        left = written(sized(step.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), n), "links")
        n = left.count()
    if not moves:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    label, size = moves[0], moves[0].count()
    for move in moves[1:]:
        label = written(sized(label.join(small(move.toDF("to", "next"), NODE_BOUND), "to", "left").select("node", F.coalesce("next", "to").alias("to")), size), "labels")
    least = written(sized(label.groupBy("to").agg(F.min("node").alias("component")), size), "roots")
    return written(sized(label.join(small(least, NODE_BOUND), "to").select("node", "component"), size), "components")


def extended(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` (of ``components``) after ``links`` between its components, or nodes without a label."""
    moved = components(links)
    if moved.isEmpty():
        return label
    near = small(moved.toDF("component", "to"), NODE_BOUND)
    old = label.join(near, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    new = moved.join(small(label.select("node"), NODE_BOUND), "node", "left_anti")
    return written(old.union(new), "components")
