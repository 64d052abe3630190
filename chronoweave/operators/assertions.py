"""Queries over the assertion log: belief time, world time, coverage, paging, access."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions import access
from chronoweave.functions.world_time import contains, fidelity

#: Predicates of which a subject can have one value at a time.
FUNCTIONAL = ("job-title",)
PAGE_DEFAULT, PAGE_MAX = 50, 200


class QueryRefused(ValueError):
    """A query that is answered with a reason instead of rows."""


@dataclass(frozen=True)
class AssertionQuery:
    """Filters of one assertion query; unset ones do not apply."""

    subject: int | None = None
    predicate: str | None = None
    target: int | None = None
    kind: str | None = None
    as_of_recorded: str | None = None
    as_of_valid: str | None = None
    include_superseded: bool = False


def considered(log: DataFrame, q: AssertionQuery) -> DataFrame:
    """Rows that pass the subject and predicate filters: those counted as evaluated."""
    for name in ("subject", "predicate"):
        if getattr(q, name) is not None:
            log = log.where(F.col(name) == getattr(q, name))
    return log


def believed(log: DataFrame, at: str | None, include_superseded: bool = False) -> DataFrame:
    """Belief-time as-of; with ``include_superseded`` only the recording time counts."""
    if at is not None:
        log = log.where(F.col("recorded_at") <= at)
    if include_superseded:
        return log
    return log.where(F.col("superseded_at").isNull() if at is None else F.col("superseded_at").isNull() | (F.col("superseded_at") > at))


def refuse_before_floor(q: AssertionQuery, floor: str) -> None:
    """Belief before the history floor cannot be answered."""
    if q.as_of_recorded is not None and q.as_of_recorded < floor:
        raise QueryRefused("as-of-before-history-floor")


def valid_at(log: DataFrame, at: str) -> DataFrame:
    """World-time as-of: rows that certainly or possibly hold at the probe, with ``match``."""
    match = contains(*(F.col(c) for c in ("from_kind", "from_value", "to_kind", "to_value")), at)
    return log.withColumn("match", match).where(F.col("match").isNotNull())


def query(log: DataFrame, q: AssertionQuery, floor: str = "") -> DataFrame:
    """All matching rows, in no order; ``match`` is ``certain`` without a world-time probe."""
    refuse_before_floor(q, floor)
    out = believed(considered(log, q), q.as_of_recorded, q.include_superseded)
    out = valid_at(out, q.as_of_valid) if q.as_of_valid is not None else out.withColumn("match", F.lit("certain"))
    for name in ("target", "kind"):
        if getattr(q, name) is not None:
            out = out.where(F.col(name) == getattr(q, name))
    return out


def coverage(log: DataFrame, q: AssertionQuery, grant: access.Grant) -> DataFrame:
    """One row of counts that reconcile: evaluated, matched, withheld, and by world-time fidelity."""
    kind = fidelity(F.col("from_kind"), F.col("to_kind"))
    hits = query(log, q).withColumn("fidelity", kind)
    shown = access.allowed(grant, F.col("tier"), F.col("withheld"))
    known = F.col("fidelity").isin("exact", "approximate")
    counts = hits.agg(F.count("*").alias("matched"), F.count_if(~shown).alias("withheld"), F.count_if(known).alias("with_valid_time"), F.count_if(~known).alias("unknown_or_absent"), (F.count_distinct("client_id") > 1).alias("mixed_clients"))
    return counts.crossJoin(considered(log, q).agg(F.count("*").alias("evaluated")))  # two single rows


def with_access(rows: DataFrame, grant: access.Grant, columns: tuple[str, ...], record_id: str = "assertion_id") -> DataFrame:
    """Unreachable rows become stubs: their columns are null, the row stays."""
    shown = access.allowed(grant, F.col("tier"), F.col("withheld"))
    stub = [F.when(~shown, access.stub_id(grant, F.col(record_id))).alias("stub_id"), F.when(~shown, access.disclosure(grant, F.col("tier_rank"))).alias("disclosure_level")]
    return rows.select("seq", shown.alias("allowed"), *stub, *(F.when(shown, F.col(c)).alias(c) for c in columns))


def page(rows: DataFrame, after: int | None, size: int = PAGE_DEFAULT, grant_max: int = PAGE_MAX, watermark: int | None = None) -> DataFrame:
    """The next rows by ``seq`` after a cursor, under a snapshot pin; sizes are clamped."""
    size = max(1, min(size, PAGE_MAX, grant_max))
    if after is not None:
        rows = rows.where(F.col("seq") > after)
    if watermark is not None:
        rows = rows.where(F.col("seq") <= watermark)
    return rows.orderBy("seq").limit(size)


def contested(rows: DataFrame, digest: Column, predicates: tuple[str, ...] = FUNCTIONAL) -> DataFrame:
    """Groups of live rows of functional predicates with two members or more."""
    some = rows.where(F.col("predicate").isin(*predicates)).groupBy("subject", "predicate")
    out = some.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("assertion_id")), ",").alias("ids"), F.count_distinct(digest).alias("digests"))
    return out.where("n >= 2")


def registry(log: DataFrame) -> DataFrame:
    """Vocabulary in use: predicates of all rows, relational if any row has a target."""
    return log.groupBy("predicate").agg(F.bool_or(F.col("target").isNotNull()).alias("relational"), F.lit("multi-valued").alias("cardinality"))


def read_many(log: DataFrame, ids: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows of ``ids`` (pos, id) in request order, duplicates kept; a missing one is ``unknown-id``."""
    wanted = ids.join(log.select(F.col(key).alias("id"), *columns, F.lit(True).alias("found")), "id", "left")
    return wanted.select("pos", "id", F.when(F.col("found"), "ok").otherwise("unknown-id").alias("outcome"), *columns)


def reclamation(ids: DataFrame, log: DataFrame, reclaimed: DataFrame) -> DataFrame:
    """Whether each id is present, was reclaimed, or never existed."""
    here, gone = log.select(F.col("assertion_id").alias("id"), F.lit(1).alias("h")), reclaimed.select("id", F.lit(1).alias("g"))
    state = F.when(F.col("h") == 1, "present").when(F.col("g") == 1, "reclaimed").otherwise("never-existed")
    return ids.join(here, "id", "left").join(gone, "id", "left").select("id", state.alias("state"))


def lineage(log: DataFrame) -> DataFrame:
    """Each superseded row with the row that supersedes it."""
    newer = log.select(F.col("seq").alias("superseded_by"), F.col("assertion_id").alias("by_id"), F.col("lineage_action").alias("by_action"))
    return log.join(newer, "superseded_by").select("assertion_id", "lineage_action", "by_id", "by_action")


def canonical_projection(log: DataFrame, known_at: str, include_retracted: bool = False, include_invalidated: bool = False) -> DataFrame:
    """The older rule: supersession is recomputed from the rows known at the time, then retractions are hidden."""
    known = log.where(F.col("recorded_at") <= known_at)
    over = known.join(known.select(F.col("seq").alias("by")), known["superseded_by"] == F.col("by"), "left_semi").select("seq")
    left = known.join(over, "seq", "left_anti")
    hidden = [x for x, keep in (("retract", include_retracted), ("invalidate", include_invalidated)) if not keep]
    return left.where(~F.col("lineage_action").isin(*hidden)) if hidden else left


def gapless_seq(rows: DataFrame, group: str, order: tuple[str, ...], start: int = 0) -> DataFrame:
    """Consecutive numbers within each feed; one writer a feed, so a group is one ordered task."""
    return rows.withColumn("seq_no", F.lit(start) + F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def receipts_outcome(proposals: DataFrame, receipts: DataFrame) -> DataFrame:
    """Idempotent commit: ``fresh``, ``replay`` (same request) or ``conflict`` (same key, other request)."""
    known = receipts.select("client_id", "idempotency_key", F.col("request_digest").alias("known"))
    outcome = F.when(F.col("known").isNull(), "fresh").when(F.col("known") == F.col("request_digest"), "replay").otherwise("conflict")
    return proposals.join(known, ["client_id", "idempotency_key"], "left").withColumn("outcome", outcome).drop("known")
