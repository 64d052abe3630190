"""Exact deduplication as a stateful stream with disk-backed keyed state that never expires.

State, in RocksDB and checkpointed to the shared folder: for each digest the stable identifier
and content locator of the row that stays, and the number of rows. Rows are combined before
the shuffle, so a text with any number of copies sends one row per task. Each batch of the
stream updates the state; the final state is read back with the state data source.

A digest that has been hit is not trusted: the full bytes of all its rows are compared, again
as a combinable aggregate (smallest and largest text of the digest). Digests whose texts
differ are then grouped by the texts themselves.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import ascii_lower, fresh_path, small, written

#: State on disk, without space set aside for each of many small stores.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # one bound for all stores of an executor
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
}
HIT_BOUND = 1_000_000


def located(docs: DataFrame) -> DataFrame:
    """``docs`` as rows of files, so that each has a place; written to the shared folder if they are not."""
    try:
        docs.select("_metadata.row_index").schema
    except AnalysisException as e:  # the hidden column exists on file scans only
        if "_metadata" not in str(e):
            raise
        return written(docs, "dedup-input")
    return docs


def locator() -> Column:
    """Where a row's content is: its file and row number."""
    return F.concat_ws("#", "_metadata.file_path", F.col("_metadata.row_index").cast("string"))


def run_state(rows_path: str, rows: DataFrame, batch_bytes: int) -> DataFrame:
    """(digest, kept, n) after the stream over the Parquet files in ``rows_path`` has ended."""
    spark = rows.sparkSession
    state = fresh_path(spark, "dedup-state")
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        source = spark.readStream.schema(rows.schema).option("maxBytesPerTrigger", batch_bytes).parquet(rows_path)
        # no watermark: the state has no expiry
        kept = source.groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("kept"), F.count("*").alias("n"))
        query = kept.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).format("noop")
        query.start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    stored = spark.read.format("statestore").load(state)
    value = next(f.dataType.fieldNames() for f in stored.schema.fields if f.name == "value")
    return stored.select(F.col("key")[stored.schema["key"].dataType.fieldNames()[0]].alias("digest"), F.col("value")[value[0]].alias("kept"), F.col("value")[value[1]].alias("n"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Column | None = None, batch_bytes: int = 1 << 33) -> DataFrame:
    """Which row of equal texts (A-Z lower-cased, nothing else) stays: that of the largest id.

    Returns doc_id, keep_id, group_size, kept, text_sha256, locator, one row per row of ``docs``. Null
    counts as empty; empty texts are equal. Of repeated rows with the largest id the one with
    the last locator stays; a null id comes before all others. Long texts are taken whole. Other columns are ignored; no rows give no rows. ``digest`` (a
    column of the normalised text ``norm``) is the state's key, SHA-256 unless given.
    """
    spark = docs.sparkSession
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    docs = located(docs)
    full = docs.select(F.col(id_col).cast("long").alias("doc_id"), locator().alias("locator"), norm.alias("norm"))
    path = fresh_path(spark, "dedup-rows")
    sha = F.sha2("norm", 256)
    hashed = full.select("doc_id", "locator", sha.alias("text_sha256"), (sha if digest is None else digest).alias("digest"))
    hashed.write.parquet(path)
    rows = spark.read.schema(hashed.schema).parquet(path)
    if rows.isEmpty():
        return rows.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "locator")
    state = written(run_state(path, rows, batch_bytes), "dedup-groups")

    # full bytes of every digest with more than one row
    hits = written(state.where("n > 1").select("digest"), "dedup-hits")
    keyed = full.withColumn("digest", sha if digest is None else digest)
    texts = keyed.join(small(hits, HIT_BOUND), "digest", "left_semi")
    odd = texts.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).where("low <> high").select("digest")
    odd = written(odd, "dedup-collisions")
    if odd.isEmpty():
        groups = state.select("digest", "kept", "n")
        joined = rows.join(groups, "digest")
    else:
        collided = keyed.join(small(odd, HIT_BOUND), "digest", "left_semi")
        by_text = written(collided.groupBy("digest", "norm").agg(F.max(F.struct("doc_id", "locator")).alias("kept"), F.count("*").alias("n")), "dedup-texts")
        apart = collided.join(by_text, ["digest", "norm"]).select("doc_id", "locator", sha.alias("text_sha256"), "kept", "n")
        plain = rows.join(odd, "digest", "left_anti").join(state, "digest")
        joined = plain.select("doc_id", "locator", "text_sha256", "kept", "n").union(apart)
    return joined.select("doc_id", F.col("kept.doc_id").alias("keep_id"), F.col("n").cast("long").alias("group_size"), (F.struct("doc_id", "locator") == F.col("kept")).alias("kept"), "text_sha256", "locator")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_duplicates`` does not keep; columns may have any names and are passed on."""
    docs = located(docs)
    gone = written(exact_duplicates(docs, id_col, text_col).where("NOT kept").select("locator"), "dropped")
    marked = docs.select(locator().alias("locator"), F.struct("*").alias("row"))
    return marked.join(small(gone, HIT_BOUND), "locator", "left_anti").select("row.*")
