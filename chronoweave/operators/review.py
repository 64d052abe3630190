"""Review of proposals: how an item can be resolved, decisions, references, parity and readiness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONFIDENCE = ("low", "medium", "high")
SETTLED = ("auto-applied", "resolved")


def dead_references(references: DataFrame, live: DataFrame) -> DataFrame:
    """(kind, dead) of references (kind, id) that name nothing live; kinds without any are 0."""
    gone = references.join(live.select("kind", "id"), ["kind", "id"], "left_anti").groupBy("kind").agg(F.count("*").alias("dead"))
    return references.select("kind").distinct().join(gone, "kind", "left").select("kind", F.coalesce("dead", F.lit(0)).alias("dead"))


def aborted_commits(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Commits with an assertion that supersedes an unknown one: commit_id, and the least such id.

    ``rows``: commit_id, assertion_id, supersedes. Assertions of the same commit are known to each other.
    """
    named = rows.where("supersedes IS NOT NULL").select("commit_id", "supersedes")
    inner = rows.select("commit_id", F.col("assertion_id").alias("supersedes"))
    lost = named.join(known.select(F.col("assertion_id").alias("supersedes")), "supersedes", "left_anti").join(inner, ["commit_id", "supersedes"], "left_anti")
    return lost.groupBy("commit_id").agg(F.min("supersedes").alias("unknown"))


def typed_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (seq, src, predicate, dst) with the types of both ends, or the refusal of a dangling one."""
    end = lambda side: nodes.select(F.col("entity_id").alias(side), F.col("type").alias(f"{side}_type"))
    out = edges.join(end("src"), "src", "left").join(end("dst"), "dst", "left")
    a, b = F.col("src_type").isNull(), F.col("dst_type").isNull()
    refusal = F.when(a & b, "both-endpoints-missing").when(a, "source-missing").when(b, "target-missing")
    return out.select("seq", "predicate", "src_type", "dst_type", refusal.alias("refusal"))


def parity_faults(parity: DataFrame, objects: DataFrame, reviews: DataFrame) -> DataFrame:
    """(fault, key): represented records whose object is missing, reviews that no parity record covers, reviews without an observation.

    ``parity``: key, coverage, object_id (one row an object, null where none). ``objects``: object_id, kind. ``reviews``: key, object_id.
    """
    have = objects.select("object_id").distinct()
    lost = parity.where("coverage = 'represented'").join(have, "object_id", "left_anti").select(F.lit("object-missing").alias("fault"), "key")
    open_ = reviews.select("key").join(parity.where("coverage = 'needs-review'").select("key"), "key", "left_anti").select(F.lit("review-not-covered"), "key")
    seen = reviews.join(objects.where("kind = 'observation'").select("object_id"), "object_id", "left_semi").select("key")
    bare = reviews.select("key").join(seen, "key", "left_anti").select(F.lit("review-without-observation"), "key")
    return lost.union(open_).union(bare).distinct()


def resolution_states(resolutions: DataFrame, groups: DataFrame) -> DataFrame:
    """(state, n): groups matched or unresolved; resolutions for unknown groups, and those beyond the first of a group."""
    r = resolutions.groupBy("key").agg(F.count("*").alias("n"))
    both = r.join(groups.select("key", F.lit(True).alias("known")).distinct(), "key", "full")
    n = F.col("n")
    per = both.agg(
        F.count_if(n.isNotNull() & F.col("known").isNotNull()).alias("matched"), F.count_if(F.col("known").isNull()).alias("unknown"),
        F.coalesce(F.sum(n - 1), F.lit(0)).alias("duplicate"), F.count_if(n.isNull()).alias("unresolved"),
    )
    return per.select(F.stack(F.lit(4), *(x for c in per.columns for x in (F.lit(c), F.col(c)))).alias("state", "n"))


def resolution_modes(items: DataFrame, proposals: DataFrame, parity: DataFrame, units: DataFrame) -> DataFrame:
    """How each item can be resolved: review_id, mode (rich, legacy or incomplete), reason (the first that applies).

    ``items``: review_id, exact_preserved, missing_references, unmapped, units (their number). ``proposals``: review_id,
    object_id, kind, found. ``parity``: review_id, coverage, representation, object_id. ``units``: review_id, unit,
    has_evidence, observation_id. Every check is one aggregate over (item, object) or over the item.
    """
    mark = lambda rows, key, tag: rows.select("review_id", F.col(key).alias("object_id"), F.lit(tag).alias("tag"))
    seen = proposals.where("found AND kind = 'observation'")
    marks = mark(seen, "object_id", "o").union(mark(parity.where("object_id IS NOT NULL"), "object_id", "p")).union(mark(units.where("observation_id IS NOT NULL"), "observation_id", "u"))
    at = lambda tag: F.bool_or(F.col("tag") == tag)
    per = marks.groupBy("review_id", "object_id").agg(at("o").alias("o"), at("p").alias("p"), at("u").alias("u")).groupBy("review_id").agg(
        F.count_if("o").alias("observations"), F.bool_or(F.col("o") != F.col("p")).alias("uneven"), F.bool_or((F.col("o") | F.col("p")) & ~F.col("u")).alias("unaccounted")
    )
    made = proposals.groupBy("review_id").agg(F.count("*").alias("proposed"), F.count_if("found").alias("found"))
    shape = (F.col("coverage") == "represented") & (F.col("representation") == "observation") & F.col("object_id").isNotNull()
    covered = parity.groupBy("review_id").agg(F.bool_and(F.coalesce(shape, F.lit(False))).alias("shaped"))
    each = units.groupBy("review_id", "unit").agg(F.bool_or("has_evidence").alias("e"), F.bool_or(F.col("observation_id").isNotNull()).alias("m"))
    mapped = each.groupBy("review_id").agg(F.count("*").alias("mapped"), F.bool_or("e").alias("any_evidence"), F.bool_and(F.col("e") & F.col("m")).alias("complete"))
    rows = reduce(lambda a, b: a.join(b, "review_id", "left"), (per, made, covered, mapped), items)
    n = lambda c: F.coalesce(c, F.lit(0))
    yes = lambda c: F.coalesce(c, F.lit(False))
    reason = (
        F.when(~F.col("exact_preserved"), "exact-source-unavailable").when(n("proposed") != n("found"), "destination-unavailable").when(F.col("missing_references") > 0, "reference-unavailable")
        .when(~yes("shaped") | yes("uneven") | (n("observations") == 0), "coverage-mismatch").when(F.col("unmapped") > 0, "destination-unmapped")
        .when(yes("any_evidence"), F.when((F.col("units") == 0) | (n("mapped") != F.col("units")) | ~yes("complete"), "fragment-incomplete").when(yes("unaccounted"), "coverage-not-accounted").otherwise("rich"))
        .when((n("found") == 1) & (n("observations") == 1), "legacy").otherwise("unsupported-mapping")
    )
    mode = F.when(F.col("reason").isin("rich", "legacy"), F.col("reason")).otherwise("incomplete")
    return rows.withColumn("reason", reason).select("review_id", mode.alias("mode"), "reason")


def decisions(items: DataFrame, action: Column) -> DataFrame:
    """The review image that a decision writes: review_id, state, recommendation, version; none for what cannot be decided.

    ``items``: review_id, mode, exact_preserved, version. Keeping needs the exact source; incomplete items take no decision.
    """
    ok = (F.col("mode") != "incomplete") & action.isin("keep", "research", "defer") & (F.col("exact_preserved") | (action != "keep"))
    state = F.when(action == "keep", "resolved").when(action == "research", "research").otherwise("deferred-unknown")
    recommendation = F.when(action == "research", "research").otherwise("owner-review")
    return items.where(ok).select("review_id", state.alias("state"), recommendation.alias("recommendation"), (F.col("version") + 1).alias("version"))


def exact_preservation(items: DataFrame) -> DataFrame:
    """What may be applied without an owner: review_id, route (auto or manual), fingerprint of what was judged.

    ``items``: review_id, state, mode, exact_preserved, version. Settled items are in neither.
    """
    auto = (F.col("mode") == "rich") & F.col("exact_preserved")
    print_ = F.sha2(F.concat_ws("\n", "review_id", "version", "mode"), 256)
    return items.where(~F.col("state").isin(*SETTLED)).select("review_id", F.when(auto, "auto").otherwise("manual").alias("route"), F.when(auto, print_).alias("fingerprint"))


def lowest_confidence(results: DataFrame) -> DataFrame:
    """Of each proposal the lowest confidence of its results, and how many there are: proposal, confidence, results.

    ``results``: proposal, confidence. One without results has no row; an unknown confidence counts as low.
    """
    rank = F.greatest(F.array_position(F.array(*(F.lit(x) for x in CONFIDENCE)), F.coalesce("confidence", F.lit("low"))), F.lit(1))
    per = results.groupBy("proposal").agg(F.min(rank).alias("r"), F.count("*").alias("results"))
    return per.select("proposal", F.element_at(F.array(*(F.lit(x) for x in CONFIDENCE)), F.col("r").cast("int")).alias("confidence"), "results")


def readiness(components: DataFrame, expected: tuple[str, ...], required: tuple[str, ...]) -> DataFrame:
    """(component, verdict): ready, failed, synced (a local check must not have synced), missing or gap.

    ``components``: component, complete, synced. A component that was not given is a gap, or missing where it is required.
    """
    all_ = components.sparkSession.createDataFrame([(x, x in required) for x in sorted({*expected, *required})], "component string, required boolean")
    verdict = (
        F.when(F.col("complete").isNull(), F.when(F.col("required"), "missing").otherwise("gap")).when(~F.col("complete"), "failed").when(F.col("synced"), "synced").otherwise("ready")
    )
    return all_.join(components, "component", "left").select("component", verdict.alias("verdict"))
