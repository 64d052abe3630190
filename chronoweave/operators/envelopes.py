"""The envelope store: transactions with optimistic generations and versions, compaction, receipts.

A transaction is validated as a whole against the current images, and one at most moves an
authority from a generation to the next. All transactions at hand are decided together: of each
authority the first valid one by position commits, and those behind it find a newer generation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_faults(objects: DataFrame, writes: DataFrame) -> DataFrame:
    """``writes`` with ``reason``: why the write cannot be made, null if it can.

    ``objects``: authority, object_id, version, tombstone. ``writes``: tx, authority, item, kind
    (create or update), object_id, object_authority, expected_version (may be null), new_version.
    """
    now = objects.select("authority", "object_id", F.col("version").alias("held"), F.col("tombstone").alias("dead"))
    again = F.row_number().over(Window.partitionBy("tx", "object_id").orderBy("item")) > 1
    held, new = F.col("held"), F.col("new_version")
    reason = (
        F.when(F.col("object_id").isNull() | new.isNull() | ~F.coalesce(F.col("kind").isin("create", "update"), F.lit(False)), "invalid-object")
        .when(~F.col("object_authority").eqNullSafe(F.col("authority")), "object-authority-mismatch").when(F.col("again"), "object-already-exists")
        .when(F.col("kind") == "create", F.when(held.isNotNull(), "object-already-exists"))
        .when(held.isNull(), "object-missing").when(F.col("dead"), "object-already-tombstoned")
        .when((F.col("expected_version") != held) | (new != held + 1), "version-conflict")
    )
    return writes.withColumn("again", again).join(now, ["authority", "object_id"], "left").withColumn("reason", reason).drop("again", "dead")


def transactions(objects: DataFrame, writes: DataFrame, requests: DataFrame, records: DataFrame, generations: DataFrame) -> DataFrame:
    """Outcome of each request: tx, authority, outcome, generation (of the record, or the current one).

    ``requests``: tx, authority, pos, idempotency_key, fingerprint, expected_generation. ``records``:
    authority, idempotency_key, fingerprint, generation of what was committed. A known key is replayed, or
    refused if its fingerprint differs. A request for the generation that this batch makes is ``deferred``.
    """
    bad = write_faults(objects, writes).groupBy("tx").agg(F.count("*").alias("items"), F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("item"))).alias("reason"))
    done = records.select("authority", "idempotency_key", F.col("fingerprint").alias("done_print"), F.col("generation").alias("done_generation"))
    current = generations.select("authority", F.col("generation").alias("now"))
    rows = requests.join(bad, "tx", "left").join(done, ["authority", "idempotency_key"], "left").join(current, "authority", "left").withColumn("now", F.coalesce("now", F.lit(0)))
    first = (
        F.when(F.col("done_generation").isNotNull(), F.when(F.col("fingerprint").eqNullSafe(F.col("done_print")), "replayed").otherwise("idempotency-conflict"))
        .when(F.col("expected_generation") != F.col("now"), "generation-conflict").when(F.coalesce("items", F.lit(0)) == 0, "invalid-object")
        .otherwise(F.coalesce("reason", F.lit("committed")))
    )
    rows = rows.withColumn("first", first)
    # the winner is an aggregate that combines before the shuffle, so a busy authority is no window in one task
    place = F.struct("pos", "tx")
    won = rows.where("first = 'committed'").groupBy("authority").agg(F.min(F.struct("pos", "tx", "idempotency_key", "fingerprint")).alias("w"))
    w = F.struct("w.pos", "w.tx")
    behind = F.col("w").isNotNull() & (place > w) & ~F.col("first").isin("replayed", "idempotency-conflict")
    outcome = (
        F.when(~behind, F.col("first"))
        .when(F.col("idempotency_key") == F.col("w.idempotency_key"), F.when(F.col("fingerprint").eqNullSafe(F.col("w.fingerprint")), "replayed").otherwise("idempotency-conflict"))
        .when(F.col("expected_generation") == F.col("now") + 1, "deferred").otherwise("generation-conflict")
    )
    made = F.when(F.col("first").isin("replayed", "idempotency-conflict"), F.col("done_generation")).when(F.col("w").isNotNull() & (place >= w), F.col("now") + 1).otherwise(F.col("now"))
    return rows.join(won, "authority", "left").select("tx", "authority", "idempotency_key", outcome.alias("outcome"), made.alias("generation"))


def changes(outcomes: DataFrame, writes: DataFrame) -> DataFrame:
    """The change rows of the committed transactions: change_id, tx, authority, generation, object_id, operation, base_version, new_version."""
    done = outcomes.where("outcome = 'committed'").select("tx", "generation")
    seed = F.concat_ws(":", F.lit("transaction"), "tx", "object_id", "generation")
    base = F.when(F.col("kind") == "update", F.col("new_version") - 1)
    return writes.join(done, "tx").select(
        F.concat(F.lit("la_change_"), F.substring(F.sha2(seed, 256), 1, 32)).alias("change_id"), "tx", "authority", "generation", "object_id",
        F.col("kind").alias("operation"), base.alias("base_version"), "new_version",
    )


def compacted(snapshot: DataFrame, journal: DataFrame) -> DataFrame:
    """The new snapshot, with which the journal starts anew: of each object the newest image, tombstones too."""
    rows = snapshot.unionByName(journal)
    rest = [c for c in rows.columns if c not in ("authority", "object_id", "version")]
    return rows.groupBy("authority", "object_id").agg(F.max(F.struct("version", *rest)).alias("m")).select("authority", "object_id", "m.*")


def receipts(outcomes: DataFrame, made: DataFrame, audit: DataFrame | None, outbox: DataFrame | None) -> DataFrame:
    """What of an applied resolution stands beside its commit: tx, audit, sync_queue.

    The commit is never undone. An audit row that is not there, or a change that did not reach the
    outbox, is ``reconciliation-required``; asking again with the same key mends it. ``made``:
    change_id and tx. ``audit``: idempotency_key. ``outbox``: change_id; None where there is none.
    """
    rows = outcomes.where("outcome IN ('committed', 'replayed')").select("tx", "idempotency_key")
    seen = F.lit("reconciliation-required")
    if audit is not None:
        rows = rows.join(audit.select("idempotency_key", F.lit(True).alias("heard")).distinct(), "idempotency_key", "left")
        seen = F.when(F.col("heard"), "recorded").otherwise(seen)
    queue = F.lit("not-configured")
    if outbox is not None:
        sent = made.join(outbox.select("change_id", F.lit(1).alias("sent")).distinct(), "change_id", "left")
        rows = rows.join(sent.groupBy("tx").agg(F.count_if(F.col("sent").isNull()).alias("unsent")), "tx", "left")
        queue = F.when(F.coalesce("unsent", F.lit(0)) == 0, "queued").otherwise("reconciliation-required")
    return rows.select("tx", seen.alias("audit"), queue.alias("sync_queue"))
