"""Bounded traversal, redirect resolution and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lineage actions under which a relationship is an edge.
AFFIRMING = ("assert", "correct", "reinstate", "invalidate")
MAX_DEPTH, MAX_HOPS = 5, 32


def stored(rows: DataFrame) -> DataFrame:
    """``rows`` computed once: a checkpoint in the cluster's shared folder, or as it is where none is set."""
    sc = rows.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = rows.sparkSession.conf.get("spark.checkpoint.dir", "")
        if not folder:
            return rows
        sc.setCheckpointDir(folder)
    return rows.checkpoint()


def affirmed(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("lineage_action").isin(*AFFIRMING))


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """(seq, predicate, here, there): both directions are a union of two, so that hops stay equi-joins."""
    out = edges.select("seq", "predicate", F.col("src").alias("here"), F.col("dst").alias("there"))
    back = edges.select("seq", "predicate", F.col("dst").alias("here"), F.col("src").alias("there"))
    return {"outbound": out, "inbound": back, "both": out.union(back)}[direction]


def neighbors(edges: DataFrame, starts: DataFrame, direction: str = "outbound", predicates: tuple[str, ...] = (), max_depth: int = 1, page_size: int | None = None) -> DataFrame:
    """Edges by breadth-first search from ``starts`` (origin, node): origin, depth, seq, here, there.

    Each edge is found once an origin, at its least depth. A page takes the first edges by
    depth and ``seq``. The loop is over at most five levels.
    """
    if not 1 <= max_depth <= MAX_DEPTH:
        raise ValueError("depth out of range")
    steps = directed(affirmed(edges), direction)
    if predicates:
        steps = steps.where(F.col("predicate").isin(*predicates))
    front, found = starts.select("origin", "node"), None
    for depth in range(1, max_depth + 1):
        if depth > 2:  # later levels would compute the earlier ones again
            front, found = stored(front), stored(found)
        hop = front.join(steps, front["node"] == steps["here"]).select("origin", F.lit(depth).alias("depth"), "seq", "here", "there")
        hop = hop.dropDuplicates(["origin", "seq"])
        if found is not None:
            hop = hop.join(found.select("origin", "seq"), ["origin", "seq"], "left_anti")
        found = hop if found is None else found.unionByName(hop)
        front = hop.select("origin", F.col("there").alias("node")).distinct()
    if page_size is not None:
        rank = F.row_number().over(Window.partitionBy("origin").orderBy("depth", "seq"))
        found = found.withColumn("rank", rank).where(F.col("rank") <= page_size).drop("rank")
    return found


def traverse(edges: DataFrame, starts: DataFrame, max_depth: int = 2) -> DataFrame:
    """The older traversal: nodes reached in either direction with the least depth, origins excluded."""
    hops = neighbors(edges, starts, "both", (), max_depth)
    nodes = hops.groupBy("origin", F.col("there").alias("node")).agg(F.min("depth").alias("depth"))
    return nodes.where("origin <> node")


def resolve(rows: DataFrame, ids: DataFrame, live: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """Follows ``mapped`` redirects by pointer jumping: id, target, outcome.

    Doublings follow chains of up to ``hops`` rows, a power of two; what still moves is a cycle or too deep.
    """
    if hops < 1 or hops & (hops - 1):
        raise ValueError("hops not a power of two")
    mapped = rows.where("disposition = 'mapped'").select(F.col("old_id").alias("k"), F.col("new_id").alias("v"))
    jump = mapped
    for _ in range(hops.bit_length() - 1):
        jump = jump.alias("a").join(jump.alias("b"), F.col("a.v") == F.col("b.k"), "left").select(F.col("a.k"), F.coalesce("b.v", "a.v").alias("v"))
    at = ids.join(jump, ids["id"] == jump["k"], "left").select("id", F.coalesce("v", "id").alias("target"))
    last = rows.select(F.col("old_id").alias("target"), "disposition")
    seen = live.select(F.col("id").alias("target"), F.lit(True).alias("live"))
    outcome = (
        F.when(F.col("disposition") == "mapped", "cycle-or-depth").when(F.col("disposition").isNotNull(), F.col("disposition"))
        .when(F.coalesce("live", F.lit(False)), F.when(F.col("id") == F.col("target"), "current").otherwise("redirected")).otherwise("dangling")
    )
    return at.join(last, "target", "left").join(seen, "target", "left").select("id", "target", outcome.alias("outcome"))


def replay_resolutions(decisions: DataFrame) -> DataFrame:
    """Ordered merges and splits of each authority folded into a redirect map.

    ``decisions``: authority, pos, decision (merge or split), member, into. A merge that would
    close a cycle is rejected; a split removes the member's redirect. Order matters, so an
    authority is one group.
    """
    import pandas as pd

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        to: dict[str, str] = {}
        for r in group.sort_values(["pos", "member", "into"]).itertuples():
            if r.decision == "split":
                to.pop(r.member, None)
                continue
            at, hops = r.into, 0
            while at in to and at != r.member and hops <= MAX_HOPS:
                at, hops = to[at], hops + 1
            if at != r.member:
                to[r.member] = r.into
        return pd.DataFrame({"authority": group["authority"].iloc[0], "member": list(to), "into": list(to.values())})

    return decisions.groupBy("authority").applyInPandas(fold, "authority long, member string, into string")


def timeline(rows: DataFrame, dates: dict[str, str], low: str | None = None, high: str | None = None) -> DataFrame:
    """Each object's date fields as rows (id, field, day), within ``[low, high]``, empty ones dropped."""
    pairs = [x for field, column in dates.items() for x in (F.lit(field), F.col(column))]
    out = rows.select("id", F.stack(F.lit(len(dates)), *pairs).alias("field", "day")).where("day IS NOT NULL")
    if low is not None:
        out = out.where(F.col("day") >= low)
    return out.where(F.col("day") <= high) if high is not None else out
