"""Further tables of a store: control tables, JSON-lines ledgers, carried blocks, outboxes and activity sinks."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from chronoweave.sources.segment_log import LogDamaged

# The control tables' columns; those of the first list may not be null.
CONTROL = {
    "sync_batches": ("batch_id string, idempotency_key string, batch_hash string, authority_ref string, operation_id string, submitted_at string, staged_at string, base_generation long, target_generation long, status string, object_count long, change_count long, estimated_batch_bytes long, withheld_plaintext_count long", "committed_at string, failure_reason string"),
    "sync_objects": ("object_ref string, batch_id string, authority_ref string, version long, envelope_hash string, payload_hash string, envelope_r2_key string, recorded_at string", "ciphertext_r2_path_hash string"),
    "sync_changes": ("change_ref string, batch_id string, authority_ref string, operation_id string, recorded_at string, object_ref string, operation string, new_version long, content_hash string, generation long, actor_ref string", "base_version long"),
    "sync_conflicts": ("conflict_id string, authority_ref string, detected_at string, base_generation long, conflict_type string, status string, redacted_summary string", "local_generation long, remote_generation long"),
}
KEYS = {"sync_batches": (("batch_id",), ("authority_ref", "idempotency_key")), "sync_objects": (("object_ref", "version"),), "sync_changes": (("change_ref",),), "sync_conflicts": (("conflict_id",),)}
STATUS = {"sync_batches": ("staged", "committed", "failed")}
LIMIT, LIMIT_MAX = 100, 1000


class TableDamaged(RuntimeError):
    """A control table breaks one of its constraints."""


def schema(name: str) -> StructType:
    return _parse_datatype_string(", ".join(CONTROL[name]))


def required(name: str) -> list[str]:
    return [x.strip().split(" ")[0] for x in CONTROL[name][0].split(",")]


def violations(rows: DataFrame, name: str) -> DataFrame:
    """(rule, n): null columns, unknown statuses and repeated keys of a control table; no rows if it is sound."""
    checks = [F.count_if(F.col(c).isNull()).alias(f"{c} is null") for c in required(name)]
    if name in STATUS:
        checks.append(F.count_if(~F.col("status").isin(*STATUS[name])).alias("unknown status"))
    counts = rows.agg(*checks)
    names = [x for c in counts.columns for x in (F.lit(c), F.col(f"`{c}`"))]
    found = [counts.select(F.stack(F.lit(len(counts.columns)), *names).alias("rule", "n"))]
    for key in KEYS[name]:
        again = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in key)).groupBy(*key).agg(F.count("*").alias("c")).where("c > 1")
        found.append(again.agg(F.lit(f"{', '.join(key)} is not unique").alias("rule"), F.count("*").alias("n")))
    return reduce(DataFrame.union, found).where("n > 0")


def control_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A control table from Parquet, refused if it breaks its constraints."""
    rows = spark.read.schema(schema(name)).parquet(path)
    bad = violations(rows, name).orderBy("rule").limit(5).collect()
    if bad:
        raise TableDamaged(f"{name}: " + "; ".join(f"{r.rule} ({r.n})" for r in bad))
    return rows


def write_lines(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines; the commit of the write shows them all at once."""
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"})).write.mode("append").text(path)


def ledger(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A JSON-lines ledger. Empty lines are skipped; a line that is no such record refuses the ledger."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    rows = lines.select(F.from_json("value", f"{columns}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = rows.where("r IS NULL OR r._bad IS NOT NULL").count()
    if bad:
        raise LogDamaged(f"{bad} lines are no records")
    return rows.select("r.*").drop("_bad")


def carried_blocks(spark: SparkSession, path: str, columns: str) -> tuple[DataFrame, int]:
    """Records of the carried blocks' file, and the bytes of its torn tail (what follows the last newline)."""
    files = spark.read.format("binaryFile").load(path).select("path", F.substring(F.col("content"), -1, 1).alias("end"))
    open_ = files.where(F.octet_length("end") > 0).where(F.col("end") != F.lit(b"\n")).select("path")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"))
    last = lines.join(F.broadcast(open_), "path").groupBy("path").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))
    torn = last.agg(F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("n")).first().n
    whole = lines.join(last.select("path", "at"), ["path", "at"], "left_anti").where("trim(value) <> ''")
    rows = whole.select(F.from_json("value", f"{columns}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = rows.where("r IS NULL OR r._bad IS NOT NULL").count()
    if bad:
        raise LogDamaged(f"{bad} carried blocks are not readable; a partial count would look like lost records")
    return rows.select("r.*").drop("_bad"), torn


def queued(path_column: str = "path"):
    """Whether a file waits in the outbox: a JSON file that is neither accepted nor failed."""
    name = F.element_at(F.split(F.col(path_column), "/"), -1)
    return name.endswith(".json") & ~name.contains(".accepted.") & ~name.contains(".failed.")


def outbox(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Queued mutations (file, item and their columns), in the order of file names when sorted by these two.

    A file holds one object, a list of them, or ``{"objects": [...]}``.
    """
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path")).where(queued())
    return unpacked(files, columns)


def outbox_stream(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """The outbox as a stream: each new file once."""
    files = spark.readStream.option("wholetext", "true").format("text").load(path).select("value", F.col("_metadata.file_path").alias("path")).where(queued())
    return unpacked(files, columns)


def unpacked(files: DataFrame, columns: str) -> DataFrame:
    many = f"array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in columns.split(','))}>>"
    body = F.ltrim("value")
    objects = F.get_json_object("value", "$.objects")
    items = F.from_json(F.when(body.startswith("["), F.col("value")).when(objects.isNotNull(), objects).otherwise(F.concat(F.lit("["), F.col("value"), F.lit("]"))), many)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("file"), F.posexplode(items).alias("item", "x")).select("file", "item", "x.*")


def bounded_limit(n, most: int = LIMIT_MAX):
    """A requested number of rows: 100 where none is asked for, within 1 and ``most``."""
    return F.greatest(F.least(F.coalesce(n, F.lit(LIMIT)), F.lit(most)), F.lit(1))


def recent(rows: DataFrame, order: tuple[str, ...], limit: int | None = None) -> DataFrame:
    """The last entries of a sink, oldest first."""
    n = min(max(LIMIT if limit is None else limit, 1), LIMIT_MAX)
    return rows.orderBy(*(F.desc(c) for c in order)).limit(n).orderBy(*order)


def pull_pages(objects: DataFrame, batches: DataFrame, after: int, page: int = LIMIT) -> DataFrame:
    """Objects of the next committed batches after a cursor, with the page's ``cursor`` and ``has_more``."""
    page = min(max(page, 1), 250)
    done = batches.where((F.col("status") == "committed") & (F.col("generation") > after)).select("generation")
    ahead = done.orderBy("generation").limit(page + 1).withColumn("r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("generation")))
    ends = ahead.agg(F.max(F.when(F.col("r") <= page, F.col("generation"))).alias("cursor"), (F.count("*") > page).alias("has_more"))
    return objects.join(F.broadcast(ahead.where(F.col("r") <= page).select("generation")), "generation").crossJoin(F.broadcast(ends))  # at most 250 rows, and one


def migration_index(entities: DataFrame, receipts: DataFrame, aliases: DataFrame, client_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A finished store by key: entity of a record key, assertions of an idempotency key, disposition of a legacy id."""
    mine = F.col("client_id") == client_id
    by_key = entities.where(mine & F.col("basis").isNotNull()).groupBy(F.col("basis").alias("record_key")).agg(F.max_by("entity_id", "seq").alias("entity_id"))
    answers = receipts.where(mine).groupBy("idempotency_key").agg(F.max_by("assertion_ids", "seq").alias("assertion_ids"))
    ends = aliases.groupBy(F.col("old_id").alias("legacy_id")).agg(F.max_by("disposition", "seq").alias("disposition"))
    return by_key, answers, ends


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared one; a local master alone may use a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", "") or None
    set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
    if base is None and set_.isDefined():
        base = set_.get()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set")
        import tempfile

        base = tempfile.mkdtemp()
    return f"{base}/{name}-{uuid.uuid4().hex}"
