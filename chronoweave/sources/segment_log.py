"""The append-only log as JSON-lines segments: writing groups, and reading them back.

A record carries its segment and position, so reading needs no order of files or lines. The
rows of a commit count only if the log has the ``submission`` row that closes the commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = "record string, segment int, pos long, submission_id string, assertion_id string, seq long, subject long, predicate string, recorded_at string, superseded_at string, superseded_by string, client_id string, idempotency_key string"
KINDS = ("header", "assertion", "supersession", "submission", "watermark", "history-floor", "compaction", "repair")


class LogDamaged(RuntimeError):
    """The log holds something that must not be skipped."""


def append(records: DataFrame, path: str) -> None:
    """Append one group; Spark's commit protocol makes it visible as a whole."""
    records.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records. A line that is no record may only be the torn end of the last segment."""
    lines = spark.read.text(path).where("value <> ''")
    rows = lines.select(F.from_json("value", RECORD).alias("r"), F.length("value").alias("n")).select("r.*", "n")
    checks = rows.agg(F.count_if(F.col("record").isNull()).alias("torn"), F.collect_set(F.when(~F.col("record").isin(*KINDS), F.col("record"))).alias("unknown")).first()
    if checks.unknown:
        raise LogDamaged(f"unknown record kinds: {sorted(checks.unknown)[:5]}")
    if checks.torn > 1:
        raise LogDamaged("more than the last line is torn")
    return rows.where("record IS NOT NULL").drop("n")


def committed(records: DataFrame) -> DataFrame:
    """Rows of commits that were closed by their receipt, and the rows that need none."""
    done = records.where("record = 'submission'").select("submission_id").distinct()
    grouped = F.col("record").isin("assertion", "supersession")
    return records.where(grouped).join(done, "submission_id", "left_semi").unionByName(records.where(~grouped))


def folded(records: DataFrame) -> DataFrame:
    """Assertions with their first supersession stamp; a later, different one is reported."""
    closed = committed(records)
    place = F.struct("segment", "pos")
    stamps = closed.where("record = 'supersession'").groupBy("assertion_id").agg(F.min_by(F.struct("superseded_at", "superseded_by"), place).alias("stamp"), (F.count_distinct("superseded_by") > 1).alias("conflicting"))
    rows = closed.where("record = 'assertion'").drop("superseded_at", "superseded_by")
    out = rows.join(stamps, "assertion_id", "left")
    return out.select("assertion_id", "seq", "subject", "predicate", "recorded_at", "segment", F.col("stamp.superseded_at").alias("superseded_at"), F.col("stamp.superseded_by").alias("superseded_by"), F.coalesce("conflicting", F.lit(False)).alias("conflicting"))


def latest_images(rows: DataFrame, key: str) -> DataFrame:
    """The last image of each key by its place in the log."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("segment"), F.desc("pos")))
    return rows.withColumn("_r", last).where("_r = 1").drop("_r")


def compactable(records: DataFrame, floor: str, watermark: int) -> DataFrame:
    """(segment, reason): ``reclaim``, or why a segment has to stay, the first reason that applies."""
    state = folded(records)
    per = state.groupBy("segment").agg(F.max("seq").alias("top"), F.bool_or(F.col("superseded_at").isNull()).alias("live"), F.bool_or(F.col("superseded_at") > floor).alias("recent"))
    all_ = records.groupBy("segment").agg(F.bool_or(F.col("record") == "repair").alias("repair"))
    open_ = all_.agg(F.max("segment")).first()[0]
    reason = F.when(F.col("segment") == open_, "open").when(F.col("repair"), "holds-repair").when(F.col("top") > watermark, "unpublished").when(F.col("live"), "still-believed").when(F.col("recent"), "after-floor").otherwise("reclaim")
    return all_.join(per, "segment", "left").select("segment", reason.alias("reason"))
