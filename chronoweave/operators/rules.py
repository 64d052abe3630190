"""Vocabulary, policy and classification rules as column expressions and small lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AGENT = ("person", "organization")
ANY = ("person", "organization", "location", "occurrence", "item", "offering", "project", "topic")
#: Canonical edge predicates: category, domain, range, required attributes (fixed values).
PREDICATES = {
    "employed-by": ("employment", ("person",), ("organization",), ("valid_from",)),
    "member-of": ("affiliation", AGENT, ("organization",), ()),
    "part-of": ("structural", ("occurrence", "project"), ("occurrence", "project"), ()),
    "contained-in": ("geography", ("location",), ("location",), ()),
    "has-type": ("taxonomy", ANY, ("topic",), ()),
    "operated-by": ("structural", ("location",), ("organization",), ()),
    "based-in": ("geography", AGENT, ("location",), ()),
    "occurred-at": ("occurrence", ("occurrence",), ("location",), ()),
    "participant-in": ("occurrence", AGENT, ("occurrence", "project"), ()),
    "connects": ("network", AGENT, AGENT, ()),
    "owns": ("commerce", AGENT, ("item", "offering", "organization"), ()),
    "offered-by": ("commerce", ("offering", "occurrence"), ("organization",), ()),
    "sold-by": ("commerce", ("item", "offering", "occurrence"), ("organization",), ()),
    "purchased": ("commerce", ("person",), ("item", "offering", "occurrence"), ()),
    "customer-of": ("customer", AGENT, ("organization",), ()),
    "founder-of": ("employment", ("person",), ("organization",), ("valid_from",)),
    "acquired-by": ("structural", ("organization",), ("organization",), ("valid_from",)),
    "invests-in": ("capital", AGENT, ("organization",), ("amount", "investment_status")),
    "about": ("taxonomy", ANY, ("topic", "project"), ()),
    "parent-of": ("personal", ("person",), ("person",), ()),
    "spouse-of": ("personal", ("person",), ("person",), ()),
    "sibling-of": ("personal", ("person",), ("person",), ()),
    "estranged-from": ("personal", ("person",), ("person",), ()),
    "introduced-by": ("network", ("person",), ("person",), ()),
    "created": ("creation", AGENT, ("item", "offering"), ()),
}
#: Spellings that mean a canonical predicate with the same direction (fixed values).
SAFE_ALIASES = {
    "works-at": "employed-by", "works-for": "employed-by", "employee-of": "employed-by", "investor-in": "invests-in", "backs": "invests-in", "client-of": "customer-of",
    "provided-by": "offered-by", "purchased-item": "purchased", "made": "created", "made-by": "created", "co-founded": "founder-of", "married-to": "spouse-of", "knows": "connects",
    "connected-to": "connects", "classified-as": "has-type", "part-of-trip": "part-of", "located-within": "contained-in",
}
#: Spellings whose ends would have to be swapped (fixed values).
DIRECTION_UNSAFE = ("manages", "acquired", "bought", "led-by", "board-includes", "employs", "portfolio-company-of", "funded-by", "operator-of", "sells", "sold-to", "contains")
#: Predicates that were accepted once (fixed values).
RETIRED = (
    "reports-to", "board-member-of", "advises", "advisor-to", "advisor", "sits-on-board-of", "alumnus-of", "engaged", "merged-with", "intro-path-to", "hosted", "discussed-at",
    "instance-of", "model-of", "purchased-from", "bought-from", "created-for", "made-for", "related-topic", "part-of-topic", "partner-of", "mentor-of", "related-to",
)


def vocabulary(spark: SparkSession) -> DataFrame:
    """(name, canonical, source): one row a known spelling."""
    rows = [(p, p, "canonical") for p in PREDICATES] + [(a, p, "safe-alias") for a, p in SAFE_ALIASES.items()]
    rows += [(p, None, "direction-unsafe") for p in DIRECTION_UNSAFE] + [(p, None, "retired") for p in RETIRED]
    return spark.createDataFrame(rows, "name string, canonical string, source string")


def canonical_predicates(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``canonical`` and ``source``; other spellings are ``unknown``."""
    words = F.broadcast(vocabulary(rows.sparkSession).withColumnRenamed("name", column))
    return rows.join(words, column, "left").withColumn("source", F.coalesce("source", F.lit("unknown")))


def endpoint_violations(edges: DataFrame) -> DataFrame:
    """``violations`` of each edge (predicate, source_type, target_type): domain, range, same kind."""
    spark = edges.sparkSession
    rules = spark.createDataFrame([(p, list(d), list(r)) for p, (_, d, r, _) in PREDICATES.items()], "predicate string, domain array<string>, range array<string>")
    checks = F.array(
        F.when(F.col("domain").isNull(), "unknown-predicate"),
        F.when(~F.array_contains("domain", F.col("source_type")), "domain"),
        F.when(~F.array_contains("range", F.col("target_type")), "range"),
        F.when((F.col("predicate") == "part-of") & (F.col("source_type") != F.col("target_type")), "same-kind"),
    )
    found = F.array_join(F.array_compact(checks), ",")
    return edges.join(F.broadcast(rules), "predicate", "left").withColumn("violations", found).drop("domain", "range")


def first_match(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The reason of the first rule that applies."""
    out = None
    for test, reason in rules:
        out = F.when(test, reason) if out is None else out.when(test, reason)
    return out.otherwise(otherwise) if out is not None else F.lit(otherwise)


def recommendation(results: DataFrame) -> DataFrame:
    """Research advice for each proposal from its results, counted by independent groups.

    ``results``: proposal, independence_key, connector_kind, stance, identity_band, hash_ok.
    """
    supports = F.col("stance") == "supports"
    public = F.bool_or(supports & F.col("connector_kind").isin("public-web", "organization"))
    linked = F.bool_or(supports & (F.col("connector_kind") == "linkedin"))
    groups = results.groupBy("proposal", "independence_key").agg(public.alias("public"), linked.alias("linked"), F.bool_or(F.col("identity_band") != "high").alias("ambiguous"), F.bool_or(~F.col("hash_ok")).alias("conflict"), F.bool_or(F.col("stance") == "refutes").alias("refuted"))
    per = groups.groupBy("proposal").agg(F.count("*").alias("independent_groups"), F.count_if("public").alias("n_public"), F.count_if(F.col("linked") & ~F.col("public")).alias("n_linked"), *(F.bool_or(c).alias(c) for c in ("ambiguous", "conflict", "refuted")))
    reason = first_match([
        (F.col("ambiguous"), "identity-ambiguous"), (F.col("conflict"), "proposal-conflict"), (F.col("refuted"), "evidence-conflict"), (F.col("n_public") >= 2, "qualifies-two-independent-public"),
        ((F.col("n_public") >= 1) & (F.col("n_linked") >= 1), "qualifies-linkedin-plus-independent"),
    ], "insufficient-evidence")
    advice = F.when(F.col("reason").startswith("qualifies"), "auto-apply").when(F.col("reason") == "insufficient-evidence", "research").otherwise("owner-review")
    return per.withColumn("reason", reason).select("proposal", "independent_groups", "reason", advice.alias("recommendation"))
