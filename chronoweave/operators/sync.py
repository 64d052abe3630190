"""Sync tables, reconciliation joins and batch packing."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.graph import stored

#: Most sets of traits made of one id.
MAX_SETS = 200


def committed_objects(objects: DataFrame, batches: DataFrame, after: int, upto: int) -> DataFrame:
    """Objects of committed batches in a range of generations."""
    done = batches.where("status = 'committed'").select("generation")
    return objects.where((F.col("generation") > after) & (F.col("generation") <= upto)).join(done, "generation")


def committed_counts(objects: DataFrame, batches: DataFrame) -> DataFrame:
    """How many objects belong to committed batches."""
    return objects.join(batches.where("status = 'committed'"), "generation", "left_semi").agg(F.count("*").alias("n"))


def latest(objects: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    return objects.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def pull_page(batches: DataFrame, after: int, max_objects: int) -> DataFrame:
    """Committed batches after a generation while their objects fit, the first one in any case."""
    w = Window.partitionBy(F.lit(0)).orderBy("generation")
    some = batches.where((F.col("status") == "committed") & (F.col("generation") > after)).orderBy("generation").limit(50)
    run = some.withColumn("total", F.sum("object_count").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rank", F.row_number().over(w))
    return run.where((F.col("rank") == 1) | (F.col("total") <= max_objects)).drop("rank")


def full_compare(left: DataFrame, right: DataFrame, key: str, digest: str) -> DataFrame:
    """One row a key: identical, divergent, left-only or right-only."""
    a, b = left.select(key, F.col(digest).alias("a")), right.select(key, F.col(digest).alias("b"))
    state = F.when(F.col("a").isNull(), "right-only").when(F.col("b").isNull(), "left-only").when(F.col("a") == F.col("b"), "identical").otherwise("divergent")
    return a.join(b, key, "full").select(key, state.alias("state"))


def ancestors(paths: DataFrame, path: str = "path") -> DataFrame:
    """Each path with itself and all its ancestor paths."""
    parts = F.split(F.col(path), "/")
    return paths.select(path, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("ancestor"))


def reidentify(observed: DataFrame, known: DataFrame, minimum: int = 2) -> DataFrame:
    """Entities that share ``minimum`` traits: none mints, one carries, more are ambiguous.

    Both sides are (id, trait, value) rows; known rows without an id are no entity. Two ids share ``minimum``
    traits if they share a set of so many, so each set keeps its least and greatest entity and no pairs are made.
    Ids with more rows than have ``MAX_SETS`` sets are paired with all others by trait and value instead.
    """
    least = max(minimum, 1)
    width = least
    while comb(width + 1, least) <= MAX_SETS:
        width += 1
    ids = observed.select("id").distinct()
    sides = [rows.where("id IS NOT NULL AND trait IS NOT NULL AND value IS NOT NULL").select("id", "trait", "value") for rows in (observed, known)]
    wide = [rows.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > width).select("id") for rows in sides]
    if all(w.isEmpty() for w in wide):
        found = _by_sets(*sides, least)
    else:
        (o, k), (few_o, few_k) = sides, [rows.join(w, "id", "left_anti") for rows, w in zip(sides, wide, strict=True)]
        pairs = _by_pairs(o.join(wide[0], "id", "left_semi"), k, least).union(_by_pairs(few_o, k.join(wide[1], "id", "left_semi"), least))
        found = _by_sets(few_o, few_k, least).union(pairs)
    per = found.groupBy("id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    one = F.col("low") == F.col("high")
    return ids.join(per, "id", "left").select("id", F.when(F.col("low").isNull(), "mint").when(one, "carry").otherwise("ambiguous").alias("decision"), F.when(one, F.col("low")).alias("entity"))


def _by_sets(observed: DataFrame, known: DataFrame, size: int) -> DataFrame:
    """(id, low, high): the least and greatest entity of each set of ``size`` traits that an id shares."""

    def sets(rows: DataFrame) -> DataFrame:
        traits = rows.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("trait", "value"))).alias("traits"))
        return traits.select("id", F.explode(_subsets(F.col("traits"), size)).alias("key"))

    held = sets(known).groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    digest = F.xxhash64("key").alias("digest")  # dealt anew by it for the join, so that Spark can split a key that many ids have
    return sets(observed).select("*", digest).join(held.select("*", digest), ["digest", "key"]).select("id", "low", "high")


def _by_pairs(observed: DataFrame, known: DataFrame, least: int) -> DataFrame:
    """(id, low, high): each entity that shares ``least`` traits with an id, by all pairs that share one."""
    k = known.select(F.col("id").alias("entity"), "trait", "value").distinct()
    shared = observed.distinct().join(k, ["trait", "value"]).groupBy("id", "entity").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return shared.select("id", F.col("entity").alias("low"), F.col("entity").alias("high"))


def _subsets(items: Column, size: int) -> Column:
    """All choices of ``size`` items in their order, null of fewer items."""
    n = F.size(items)

    def longer(picks: Column, last: Column) -> Column:
        return F.flatten(F.transform(picks, lambda p: F.transform(F.sequence(F.element_at(p, -1) + 1, last), lambda i: F.concat(p, F.array(i)))))

    picks = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.array(i))
    for k in range(2, size + 1):
        picks = longer(picks, n - size + k)
    return F.when(n >= size, F.transform(picks, lambda p: F.transform(p, lambda i: F.element_at(items, i))))


def unique_titles(rows: DataFrame, group: tuple[str, ...], key: str) -> DataFrame:
    """Titles that name exactly one object."""
    return rows.groupBy(*group).agg(F.count_distinct(key).alias("n"), F.min(key).alias(key)).where("n = 1").drop("n")


def packed(items: DataFrame, group: str, order: tuple[str, ...], size: str, limit: int) -> DataFrame:
    """The next batch: the longest prefix whose sizes fit; one oversized first item goes alone."""
    w = Window.partitionBy(group).orderBy(*order)
    run = items.withColumn("total", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rank", F.row_number().over(w))
    return run.where((F.col("total") <= limit) | (F.col("rank") == 1)).drop("rank")


def stride_sample(rows: DataFrame, order: str, n: int, total: int) -> DataFrame:
    """Rows at positions ``floor(i * total / n)`` of the order, found by range ranks, not one sort task."""
    i = F.ceil(F.col("rank") * n / total)
    return global_rank(rows, order).where((i < n) & (F.floor(i * total / n) == F.col("rank")))


def global_rank(rows: DataFrame, order: str) -> DataFrame:
    """``rank`` from 0 over the whole order: range partitions, ranks within them, offsets by their sizes."""
    parts = stored(rows.repartitionByRange(order).withColumn("_p", F.spark_partition_id()))  # both uses must see the same ranges
    sizes = parts.groupBy("_p").agg(F.count("*").alias("c"))
    before = sizes.select("_p", (F.sum("c").over(Window.orderBy("_p")) - F.col("c")).alias("o"))
    return parts.join(F.broadcast(before), "_p").withColumn("rank", F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1 + F.col("o")).drop("_p", "o")


def sequencer(batches: DataFrame) -> DataFrame:
    """Outcome of each submitted batch of an authority, in order.

    ``batches``: authority, pos, batch_id, base, target. A batch on the current generation is
    accepted and moves it; a known id is a duplicate; an older base is stale, a newer one a gap.
    """
    import pandas as pd

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        now, seen, out = 0, set(), []
        for r in group.sort_values(["pos", "batch_id"]).itertuples():
            if r.batch_id in seen:
                out.append("duplicate")
            elif r.base < now:
                out.append("stale-generation")
            elif r.base > now or r.target != r.base + 1:
                out.append("generation-gap")
            else:
                out.append("accepted")
                now = r.target
                seen.add(r.batch_id)
        return group.sort_values(["pos", "batch_id"]).assign(outcome=out)[["authority", "pos", "batch_id", "outcome"]]

    return batches.groupBy("authority").applyInPandas(fold, "authority long, pos long, batch_id long, outcome string")


def sync_plan(local: Column, remote: Column, base: Column) -> Column:
    """What to do next: idle, push, pull, or recover when both sides moved."""
    return F.when((local == base) & (remote == base), "idle").when(remote == base, "push").when(local == base, "pull").otherwise("recover")
