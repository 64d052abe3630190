"""Structured Streaming forms of the change feed, idempotent commits and rate limits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.assertions import receipts_outcome


def changes(log: DataFrame, epoch: str) -> DataFrame:
    """Change records of a (streaming) log."""
    return log.select("seq", F.concat(F.lit(f"change_{epoch}_"), F.col("seq").cast("string")).alias("change_id"), "assertion_id")


def read_changes(log: DataFrame, cursor: int, limit: int, epoch: str, expected: str | None = None, floor: int = 0) -> DataFrame:
    """A bounded page of the feed after ``cursor``; one more row tells whether there are more."""
    if expected is not None and expected != epoch:
        raise ValueError("feed-epoch-mismatch")
    if cursor < floor:
        raise ValueError("cursor-below-retention-floor")
    return changes(log.where(F.col("seq") > cursor), epoch).orderBy("seq").limit(limit + 1)


def committer(receipts_path: str, outcomes_path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: proposals are fresh, replays or conflicts against all receipts so far.

    Within a batch the first proposal of a key (by event_id) is the one that may be fresh. A
    batch that is run again finds its own receipts and writes to the same place.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        have = spark.read.schema("client_id string, idempotency_key string, request_digest string, batch long").parquet(receipts_path).where(F.col("batch") != batch_id)
        first = batch.groupBy("client_id", "idempotency_key").agg(F.min(F.struct("event_id", "request_digest")).alias("f"))
        fresh = first.join(have, ["client_id", "idempotency_key"], "left_anti").select("client_id", "idempotency_key", F.col("f.request_digest").alias("request_digest"), F.col("f.event_id").alias("event_id"))
        seen = have.select("client_id", "idempotency_key", "request_digest").unionByName(fresh.drop("event_id"))
        out = receipts_outcome(batch, seen)
        own = fresh.select("event_id", F.lit(True).alias("own"))
        out = out.join(own, "event_id", "left").withColumn("outcome", F.when(F.col("own"), "fresh").otherwise(F.col("outcome"))).drop("own")
        out.write.mode("overwrite").parquet(f"{outcomes_path}/batch={batch_id}")
        fresh.select("client_id", "idempotency_key", "request_digest").write.mode("overwrite").parquet(f"{receipts_path}/batch={batch_id}")

    return commit


def rate_windows(requests: DataFrame, limit: int, lateness: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Calls of each client in tumbling windows of event time, final once the watermark passes."""
    calls = requests.withWatermark("ts", lateness).groupBy("client_id", F.window("ts", width)).agg(F.count("*").alias("calls"))
    return calls.select("client_id", F.col("window.start").alias("window_start"), "calls", (F.col("calls") > limit).alias("limited"))
