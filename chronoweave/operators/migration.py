"""Certifying a migration: the closure gate over a plan, and faithfulness of the store that came of it.

A plan is four relations, so that every check is a join or an aggregate:

``outcomes``  legacy_id, category, disposition, reason, alias_kind       one row a source object
``claims``    legacy_id, record_key                                      the records an object became
``aliases``   legacy_id, record_key                                      the records its alias row names
``records``   record_key, kind, slot, source_slot, target_slot, retracts, from_legacy, scheme, name, mechanism
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Finding codes that do not stop a plan, record kinds, and the mechanism of topics the source itself holds.
TOLERATED = ("duplicate-source-topic", "cross-scheme-topic-homonym", "unmodelled-record-carried")
ENTITIES = ("entity", "minted-entity")
RELATIONSHIPS = ("relationship", "minted-relationship")
KINDS = (*ENTITIES, *RELATIONSHIPS, "retraction", "observation", "evidence", "provisional-block")
FROM_CORPUS = "projected-from-corpus"
#: The alias disposition that each kind of planned alias must have in the store.
DISPOSITIONS = {"record": "mapped", "ambiguous-split": "ambiguous-split", "terminal": "terminal"}
LISTED = 20


@dataclass(frozen=True)
class Plan:
    outcomes: DataFrame
    claims: DataFrame
    aliases: DataFrame
    records: DataFrame


def flagged(rows: DataFrame, subject: str, **conditions: Column) -> DataFrame:
    """(code, subject, n) of each condition that holds, in one pass; ``_`` in names stands for ``-``."""
    codes = [F.when(c, F.lit(k.replace("_", "-"))) for k, c in conditions.items()]
    return rows.select(F.explode(F.array_compact(F.array(*codes))).alias("code"), F.col(subject).alias("subject"), F.lit(1).cast("long").alias("n"))


def outcome_faults(plan: Plan) -> DataFrame:
    refused = F.col("disposition") == "refused"
    named = flagged(
        plan.outcomes, "legacy_id",
        unclassified_source_category=(F.col("category") == "other") | (refused & (F.col("reason") == "unclassified-source-category")),
        unnamed_refusal_reason=refused & (F.col("reason") == "other"),
        unnamed_source_disposition=F.col("disposition") == "other",
        alias_row_missing=F.col("alias_kind").isNull(),
    )
    broken = plan.aliases.join(plan.records.select("record_key"), "record_key", "left_anti").select("legacy_id").distinct()
    return named.union(flagged(broken, "legacy_id", alias_target_missing_record=F.lit(True)))


def accounting_faults(plan: Plan) -> DataFrame:
    """Records with the same key, and records that are not claimed by just one outcome (minted ones: by none)."""
    made = plan.records.groupBy("record_key").agg(F.count("*").alias("made"), F.count_if("from_legacy").alias("legacy"))
    claimed = plan.claims.groupBy("record_key").agg(F.count("*").alias("claims"))
    both = made.join(claimed, "record_key", "full").na.fill(0, ["made", "legacy", "claims"])
    wrong = (
        F.greatest(F.col("claims") - 1, F.lit(0))  # claimed twice
        + F.when(F.col("made") == 0, F.col("claims")).otherwise(0)  # claimed, but not there
        + F.when(F.col("claims") == 0, F.col("legacy")).otherwise(F.col("made") - F.col("legacy"))  # unclaimed, or minted and claimed
    )
    found = both.select(
        F.explode(F.array(
            F.struct(F.lit("duplicate-idempotency-key").alias("code"), F.greatest(F.col("made") - 1, F.lit(0)).alias("n")),
            F.struct(F.lit("record-not-accounted").alias("code"), wrong.alias("n")),
        )).alias("f"), "record_key",
    )
    gone = plan.records.where("kind = 'retraction'").join(plan.records.select(F.col("record_key").alias("retracts")), "retracts", "left_anti")
    return found.select("f.code", F.col("record_key").alias("subject"), "f.n").where("n > 0").union(flagged(gone, "record_key", retraction_target_missing=F.lit(True)))


def endpoint_faults(plan: Plan) -> DataFrame:
    slots = plan.records.where(F.col("kind").isin(*ENTITIES)).select("slot").distinct()
    ends = plan.records.where(F.col("kind").isin(*RELATIONSHIPS)).select("record_key", "source_slot", "target_slot")
    known = lambda side: slots.select(F.col("slot").alias(side), F.lit(True).alias(f"{side}_known"))
    both = ends.join(known("source_slot"), "source_slot", "left").join(known("target_slot"), "target_slot", "left")
    return flagged(both, "record_key", dangling_projected_endpoint=F.col("source_slot_known").isNull() | F.col("target_slot_known").isNull())


def topic_faults(plan: Plan) -> DataFrame:
    """Words that a scheme holds twice (minted by the migration, or the corpus' own), and words of several schemes."""
    topics = plan.records.where(F.col("kind").isin(*ENTITIES) & F.col("scheme").isNotNull())
    word = F.lower(F.trim(F.regexp_replace("name", r"\s+", " ")))
    nodes = topics.where("name IS NOT NULL").groupBy(word.alias("word"), "slot").agg(F.min(F.struct("scheme", "mechanism")).alias("m")).select("word", "slot", "m.*")
    groups = nodes.groupBy("word", "scheme").agg(F.count("*").alias("same"), F.bool_or(F.col("mechanism") != FROM_CORPUS).alias("minted"))
    spread = groups.groupBy("word").agg(F.count("*").alias("schemes"))
    odd = groups.join(spread, "word").where("same > 1 OR schemes > 1")
    shared = nodes.join(odd, ["word", "scheme"])
    twice = F.col("same") > 1
    return flagged(
        shared, "slot", duplicate_minted_topic=twice & F.col("minted"), duplicate_source_topic=twice & ~F.col("minted"), cross_scheme_topic_homonym=F.col("schemes") > 1
    ).union(flagged(topics, "slot", unnamed_topic_scheme=F.col("scheme") == "other"))


def shape_faults(plan: Plan) -> DataFrame:
    kind = F.col("kind")
    lacks = lambda *names: reduce(lambda a, b: a | b, (F.col(n).isNull() for n in names))
    bad = (
        F.when(~F.coalesce(kind.isin(*KINDS), F.lit(False)) | lacks("record_key", "from_legacy"), True)
        .when(kind.isin(*ENTITIES), lacks("slot", "name")).when(kind.isin(*RELATIONSHIPS), lacks("source_slot", "target_slot"))
        .when(kind == "retraction", lacks("retracts")).otherwise(False)
    )
    return flagged(plan.records, "record_key", invalid_record_shape=bad, unmodelled_record_carried=kind == "provisional-block")


def tally(plan: Plan) -> DataFrame:
    """One row: sources, projected, refused, and refused with a reason."""
    d = F.col("disposition")
    return plan.outcomes.agg(
        F.count("*").alias("sources"), F.count_if(d == "projected").alias("projected"), F.count_if(d == "refused").alias("refused"),
        F.count_if((d == "refused") & F.col("reason").isNotNull()).alias("reasons"), F.count("category").alias("categories"), F.count("disposition").alias("dispositions"),
    )


def arithmetic_faults(plan: Plan, summary: dict[str, int] | None, expected_sources: int | None) -> DataFrame:
    """What does not add up, without subjects; ``summary`` is what the plan says of itself."""
    c = F.col
    off = [c("projected") + c("refused") != c("sources"), (c("categories") != c("sources")) | (c("dispositions") != c("sources")), c("reasons") != c("refused")]
    if expected_sources is not None:
        off.append(c("sources") != expected_sources)
    codes = [F.when(x, F.lit("closure-arithmetic-mismatch")) for x in off]
    if summary is not None:
        codes.append(F.when(reduce(lambda a, b: a | b, (c(k) != v for k, v in summary.items())), F.lit("breakdown-mismatch")))
    return tally(plan).select(F.explode(F.array_compact(F.array(*codes))).alias("code"), F.lit(None).cast("string").alias("subject"), F.lit(0).cast("long").alias("n"))


def plan_digest(plan: Plan) -> str:
    """A digest of the plan's content, whatever the order of its rows."""
    parts = []
    for name in ("outcomes", "claims", "aliases", "records"):
        rows = getattr(plan, name)
        h = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
        words = [F.sum(F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")) for k in range(4)]
        parts.append(rows.select(F.concat_ws("-", F.lit(name), F.count("*"), *words).alias("p")))
    return reduce(DataFrame.union, parts).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("p")), "\n"), 256)).first()[0]


def closure_findings(plan: Plan, summary: dict[str, int] | None = None, expected_sources: int | None = None, digest: str | None = None) -> DataFrame:
    """Findings of the gate: code, severity, subject_count, and the 20 smallest subjects.

    Checks arithmetic, the digest of the reviewed plan, record shapes, named categories, accounting,
    retraction targets, endpoints, topics and alias rows. Every subject counts; only the list is short.
    """
    found = [outcome_faults(plan), accounting_faults(plan), endpoint_faults(plan), topic_faults(plan), shape_faults(plan), arithmetic_faults(plan, summary, expected_sources)]
    if digest is not None and digest != plan_digest(plan):
        found.append(plan.outcomes.sparkSession.createDataFrame([("plan-digest-mismatch", None, 0)], "code string, subject string, n long"))
    # partial sums and a rank with a limit: no code's subjects ever come together in one task
    per = reduce(DataFrame.union, found).groupBy("code", "subject").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("code").orderBy("subject"))
    first = per.where("subject IS NOT NULL").withColumn("r", rank).where(F.col("r") <= LISTED).groupBy("code").agg(F.array_sort(F.collect_list("subject")).alias("subjects"))
    severity = F.when(F.col("code").isin(*TOLERATED), "tolerated").otherwise("failure")
    totals = per.groupBy("code").agg(F.sum("n").alias("subject_count"))
    return totals.join(first, "code", "left").select("code", severity.alias("severity"), "subject_count", F.coalesce("subjects", F.array().cast("array<string>")).alias("subjects"))


def certified(findings: DataFrame) -> bool:
    """Whether a plan may be applied: failures stop it, tolerated findings do not."""
    return findings.where("severity = 'failure'").isEmpty()


def faithfulness(outcomes: DataFrame, records: DataFrame, stored: DataFrame, dispositions: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """What of a plan did not arrive as planned: check, code, field, n.

    ``stored``: record_key, kind, text and ``fields`` of what the store holds; ``dispositions``:
    legacy_id, disposition of its alias rows. Keys count once each. All fields of all records are
    compared, not a sample. Blocks are compared by number, length and as a multiset of their texts.
    """
    want = F.coalesce(*(F.when(F.col("alias_kind") == k, F.lit(v)) for k, v in DISPOSITIONS.items()))
    held = dispositions.groupBy("legacy_id").agg(F.max("disposition").alias("held"))
    ids = outcomes.where("alias_kind IS NOT NULL").join(held, "legacy_id", "left")
    lost = F.when(F.col("held").isNull(), "legacy-id-missing").when(F.col("held") != want, "legacy-id-class-mismatch")
    found = [ids.select(F.lit("legacy-id-resolution").alias("check"), lost.alias("code"), F.lit("").alias("field"))]

    one = lambda rows, tag: rows.groupBy("record_key").agg(F.min(F.struct("kind", *fields)).alias(tag))  # noqa: E731  of repeated keys the least
    both = one(records, "a").join(one(stored, "b"), "record_key", "full")
    count = F.when(F.col("b").isNull(), "record-missing").when(F.col("a").isNull(), "record-unplanned")
    found.append(both.select(F.lit("record-counts"), count, F.coalesce("a.kind", F.lit(""))))
    differing = F.array(*(F.when(~F.col(f"a.{x}").eqNullSafe(F.col(f"b.{x}")), F.lit(x)) for x in ("kind", *fields)))
    found.append(both.where("a IS NOT NULL AND b IS NOT NULL").select(F.lit("field-comparison"), F.lit("field-mismatch"), F.explode(F.array_compact(differing))))

    side = lambda rows, k: rows.where("kind = 'provisional-block'").select(F.sha2("text", 256).alias("t"), F.length("text").alias("len"), F.lit(k).alias("side"))
    blocks = side(records, 1).union(side(stored, -1))
    over = blocks.groupBy("t").agg(F.sum("side").alias("n")).where("n > 0")
    totals = blocks.agg(F.coalesce(F.sum("side"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("side") * F.col("len")), F.lit(0)).alias("len"))
    counts = reduce(DataFrame.union, found).where("code IS NOT NULL").groupBy("check", "code", "field").agg(F.count("*").alias("n"))
    texts = over.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("block-digest-mismatch").alias("code"), "n")
    sums = totals.select(F.stack(F.lit(2), F.lit("block-count-mismatch"), F.abs("n"), F.lit("block-text-length-mismatch"), F.abs("len")).alias("code", "n"))
    return counts.union(texts.union(sums).where("n <> 0").select(F.lit("provisional-blocks"), "code", F.lit(""), "n"))
