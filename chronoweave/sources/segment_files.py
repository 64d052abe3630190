"""Segment files: the append-only log as one JSON-lines file a segment, written whole and read with all checks.

A segment is ``segment=<ordinal>/<one file>``; it rolls before it would exceed ``ROLL_BYTES``, so a
file fits a row. Its first line is a header that names format, epoch and ordinal. Only the end of
the last segment can be damaged by a crash: a torn last line, or a commit without its receipt.
Those are reported as repairs and left out; anything else is refused with its code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.sources.segment_log import KINDS, RECORD, LogDamaged

FORMAT = "segment-log-1"
ROLL_BYTES = 8 * 1024 * 1024
#: Codes of a refusal, in the order in which they are looked for within a segment (fixed values).
CODES = (
    "empty-segment", "torn-record-mid-log", "corrupt-record", "unknown-record-kind", "missing-header", "format-mismatch", "ordinal-mismatch", "feed-epoch-mismatch", "incomplete-commit-mid-log", "other",
)
HEADER = "record string, log_format string, feed_epoch string, segment_ordinal int"
#: Fields without which a record of the kind means nothing.
NEEDED = {"assertion": ("assertion_id", "seq"), "supersession": ("assertion_id", "superseded_at"), "submission": ("submission_id",)}


def write_segments(records: DataFrame, path: str, epoch: str, roll_bytes: int = ROLL_BYTES) -> None:
    """``records`` (``pos`` is their order) as segment files of at most ``roll_bytes``, a longer record alone.

    Positions are summed by ranges of records first, so that no task orders the whole log.
    """
    lines = records.select("pos", F.to_json(F.struct(*(c for c in records.columns if c not in ("pos", "segment")), "pos")).alias("line")).withColumn("size", F.octet_length("line") + 1)
    lines = lines.withColumn("range", F.floor(F.col("pos") / 100_000))
    sums = lines.groupBy("range").agg(F.sum("size").alias("bytes"))
    before = sums.withColumn("before", F.coalesce(F.sum("bytes").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("bytes")  # a row for each 100,000 records
    at = F.col("before") + F.sum("size").over(Window.partitionBy("range").orderBy("pos"))
    room = max(1, roll_bytes - 512)  # for the header
    body = lines.join(F.broadcast(before), "range").withColumn("segment", F.floor((at - F.col("size")) / room).cast("int"))
    # ordinals without gaps: a record longer than a segment skips some
    used = body.select("segment").distinct()
    number = used.withColumn("ordinal", F.row_number().over(Window.orderBy("segment")))  # a row a segment
    body = body.join(F.broadcast(number), "segment").select("ordinal", F.col("pos").alias("at"), "line")
    head = F.to_json(F.struct(F.lit("header").alias("record"), F.lit(FORMAT).alias("log_format"), F.lit(epoch).alias("feed_epoch"), F.col("ordinal").alias("segment_ordinal")))
    heads = number.select("ordinal", F.lit(-1).cast("long").alias("at"), head.alias("line"))
    out = body.union(heads).repartition("ordinal").sortWithinPartitions("ordinal", "at")
    out.select(F.col("ordinal").alias("segment"), F.col("line").alias("value")).write.mode("append").partitionBy("segment").text(path)


def empty_segments(spark: SparkSession, path: str) -> list[int]:
    """Ordinals of the files without a byte, which Spark's readers pass over; from the listing of the log's own file system."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/segment=*/[!_.]*")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return [int(x.getPath().getParent().getName().split("=")[1]) for x in found if x.getLen() == 0]


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(segment, size, pos, line, torn) of every segment file; an empty file has one row with a null line."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!_.]*").load(path)
    files = files.select(F.regexp_extract("path", r"segment=(\d+)", 1).cast("int").alias("segment"), F.col("length").cast("long").alias("size"), F.col("content").cast("string").alias("text"))
    whole = F.endswith("text", F.lit("\n"))
    parts = files.select("segment", "size", whole.alias("whole"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("last", F.max("pos").over(Window.partitionBy("segment")))
    torn = (F.col("pos") == F.col("last")) & ~F.col("whole")
    out = parts.where("line <> ''").select("segment", "size", "pos", "line", torn.alias("torn"))
    empty = [(n, 0, 0, None, False) for n in empty_segments(spark, path)]
    return out.unionByName(spark.createDataFrame(empty, "segment int, size long, pos int, line string, torn boolean")) if empty else out


def findings(lines: DataFrame, epoch: str | None = None) -> DataFrame:
    """(segment, code, pos): every reason to refuse the log. ``lines``: as ``lines_of`` gives them."""
    last = F.max("segment").over(Window.partitionBy(F.lit(0)))
    ends = lines.groupBy("segment").agg(F.max("size").alias("size"), F.bool_or("torn").alias("torn")).withColumn("final", F.col("segment") == last)  # a row a segment
    rows = lines.where("NOT torn AND line IS NOT NULL").withColumn("r", F.from_json("line", RECORD)).withColumn("h", F.from_json("line", HEADER))
    rows = rows.withColumn("json", F.try_parse_json("line").isNotNull()).withColumn("first", F.col("pos") == 0)
    kind = F.col("r.record")
    needed = F.lit(False)
    for k, fields in NEEDED.items():
        for f in fields:
            needed = needed | ((kind == k) & F.col(f"r.{f}").isNull())
    head = F.col("first") & (kind == "header")
    code = (
        F.when(~F.col("json"), "corrupt-record").when(kind.isNull() | ~kind.isin(*KINDS), "unknown-record-kind").when(needed, "corrupt-record").when(F.col("first") & (kind != "header"), "missing-header")
        .when(head & ~F.col("h.log_format").eqNullSafe(F.lit(FORMAT)), "format-mismatch").when(head & ~F.col("h.segment_ordinal").eqNullSafe(F.col("segment")), "ordinal-mismatch")
    )
    if epoch is not None:
        code = code.when(head & ~F.col("h.feed_epoch").eqNullSafe(F.lit(epoch)), "feed-epoch-mismatch")
    found = rows.select("segment", code.alias("code"), "pos").where("code IS NOT NULL")
    whole = ends.select("segment", F.when(F.col("size") == 0, "empty-segment").when(F.col("torn") & ~F.col("final"), "torn-record-mid-log").alias("code"), F.lit(0).alias("pos")).where("code IS NOT NULL")
    headless = ends.where("size > 0").join(rows.where("first").select("segment"), "segment", "left_anti").where("NOT (torn AND final)").select("segment", F.lit("missing-header").alias("code"), F.lit(0).alias("pos"))
    # commits without a receipt may only be the last of the log
    groups = rows.where(kind.isin("assertion", "supersession", "submission")).groupBy(F.col("r.submission_id").alias("submission")).agg(
        F.max(F.struct("segment", "pos")).alias("end"), F.bool_or(kind == "submission").alias("closed"))
    later = groups.agg(F.max("end").alias("top"))
    cut = groups.where("NOT closed").crossJoin(later).where("end < top").select(F.col("end.segment").alias("segment"), F.lit("incomplete-commit-mid-log").alias("code"), F.col("end.pos").alias("pos"))  # one row
    return found.unionByName(whole).unionByName(headless).unionByName(cut)


def scan_segments(spark: SparkSession, path: str, epoch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, repairs) of a log, or ``LogDamaged`` with the first code by segment.

    Records are those of closed commits and those that need none. Repairs: (segment, reason,
    discarded_bytes, discarded_digest) of a torn tail, and an open last commit without its bytes.
    """
    lines = lines_of(spark, path)
    order = F.array_position(F.array(*map(F.lit, CODES)), F.col("code"))
    worst = findings(lines, epoch).agg(F.min(F.struct("segment", order.alias("o"), "pos", "code")).alias("f")).first().f
    if worst is not None:
        raise LogDamaged(f"{worst.code}: segment {worst.segment}, line {worst.pos}")
    rows = lines.where("NOT torn AND line IS NOT NULL").select("segment", F.col("pos").alias("line_no"), F.from_json("line", RECORD).alias("r")).select("r.*", F.col("segment").alias("in_segment"), "line_no").drop("segment").withColumnRenamed("in_segment", "segment")
    rows = rows.where("record <> 'header'")
    grouped = F.col("record").isin("assertion", "supersession")
    done = rows.where("record = 'submission'").select("submission_id").distinct()
    kept = rows.where(grouped).join(done, "submission_id", "left_semi").unionByName(rows.where(~grouped))
    open_ = rows.where(grouped).join(done, "submission_id", "left_anti").groupBy("segment").agg(F.lit("incomplete-commit").alias("reason"), F.lit(None).cast("long").alias("discarded_bytes"), F.lit(None).cast("string").alias("discarded_digest"))
    torn = lines.where("torn").select("segment", F.lit("torn-tail").alias("reason"), F.octet_length("line").cast("long").alias("discarded_bytes"), F.concat(F.lit("sha256:"), F.sha2("line", 256)).alias("discarded_digest"))
    return kept, torn.unionByName(open_)


def compacted(records: DataFrame, verdict: DataFrame) -> DataFrame:
    """The records to write anew after compaction: all but the assertions and stamps of reclaimed segments.

    ``verdict``: (segment, reason) as ``segment_log.compactable`` gives it. Receipts of reclaimed
    segments are carried forward, since a retry must still find them; for each reclaimed
    assertion a ``compaction`` record says that it existed.
    """
    gone = F.broadcast(verdict.where("reason = 'reclaim'").select("segment"))  # a row a segment
    kept = records.join(gone, "segment", "left_anti")
    inside = records.join(gone, "segment", "left_semi")
    receipts = inside.where("record = 'submission'")
    notes = inside.where("record = 'assertion'").withColumns({"record": F.lit("compaction"), "subject": F.lit(None).cast("long"), "predicate": F.lit(None).cast("string")})
    return kept.unionByName(receipts).unionByName(notes.select(*kept.columns))
