"""Writing redirects: merges, splits, dispositions and renames, refused before they could close a cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.graph import resolve


#: Refusals that an earlier request of the same batch cannot change.
FINAL = ("merge-into-self", "split-needs-two-candidates", "alias-already-redirected")


def verdicts(rows: DataFrame, live: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` with ``verdict``, and ``target``: the live entity a merge ends at.

    ``requests``: pos, action (merge, split or disposition), old_id, into, candidates (number of entities
    a split names), missing (whether one of them is not held). ``rows``: old_id, new_id, disposition; ``live``: id.
    All are judged against the rows as they stand. Of requests that touch each other (the same id,
    or one's id is where another ends) only the first is judged, the others are ``deferred`` to the next
    batch unless their refusal is final; so accepted rows cannot close a cycle together, and each batch settles its first request.
    """
    asked = requests.where("action = 'merge'").select(F.col("into").alias("id")).distinct()
    ends = resolve(rows, asked, live).select(F.col("id").alias("into"), F.col("target"), F.col("outcome"))
    held = rows.select("old_id", F.lit(True).alias("redirected")).distinct()
    merge = F.col("action") == "merge"
    found = requests.join(ends, "into", "left").join(held, "old_id", "left")
    found = found.withColumn("target", F.when(merge & F.col("outcome").isin("current", "redirected"), F.col("target")))
    verdict = (
        F.when(merge & (F.col("old_id") == F.col("into")), "merge-into-self").when((F.col("action") == "split") & (F.coalesce("candidates", F.lit(0)) < 2), "split-needs-two-candidates")
        .when(F.col("redirected"), "alias-already-redirected").when((F.col("action") == "split") & F.col("missing"), "split-candidate-unresolvable")
        .when(merge & F.col("target").isNull(), "merge-target-unresolvable").when(merge & (F.col("target") == F.col("old_id")), "merge-would-create-cycle").otherwise("accepted")
    )
    judged = found.withColumn("verdict", verdict)
    ok = judged.where("verdict = 'accepted'")
    sources = ok.groupBy("old_id").agg(F.min("pos").alias("p"))
    sinks = ok.where("target IS NOT NULL").groupBy("target").agg(F.min("pos").alias("p"))
    as_ = lambda side, key, name, p: side.select(F.col(key).alias(name), F.col("p").alias(p))
    # the first positions at which the request's id is redirected, its end is redirected, or its id is an end
    met = judged.join(as_(sources, "old_id", "old_id", "p1"), "old_id", "left").join(as_(sources, "old_id", "target", "p2"), "target", "left").join(as_(sinks, "target", "old_id", "p3"), "old_id", "left")
    late = ~F.col("verdict").isin(*FINAL) & (F.coalesce(F.least("p1", "p2", "p3"), F.col("pos")) < F.col("pos"))
    return met.select(*requests.columns, F.when(late, "deferred").otherwise(F.col("verdict")).alias("verdict"), "target")


def redirects(judged: DataFrame) -> DataFrame:
    """The rows that accepted requests append: old_id, new_id, disposition."""
    kind = F.when(F.col("action") == "merge", "mapped").when(F.col("action") == "split", "ambiguous-split").otherwise("terminal")
    return judged.where("verdict = 'accepted'").select("old_id", F.when(F.col("action") == "merge", F.col("into")).alias("new_id"), kind.alias("disposition"))


def renamed(entities: DataFrame, names: DataFrame) -> DataFrame:
    """Entities after renames (entity_id, name, pos; the last counts): the name before becomes an alias, ids stay."""
    last = names.groupBy("entity_id").agg(F.max_by("name", "pos").alias("new"))
    rows = entities.join(last, "entity_id", "left")
    changed = F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("display_name"))
    aliases = F.array_sort(F.array_distinct(F.array_append("aliases", F.col("display_name"))))
    return rows.select("entity_id", F.when(changed, F.col("new")).otherwise(F.col("display_name")).alias("display_name"), F.when(changed, aliases).otherwise(F.col("aliases")).alias("aliases"))
