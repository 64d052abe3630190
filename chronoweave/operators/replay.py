"""Audit and activity replay, usage roll-ups, budgets and rate limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Flags of an operation with the code and severity of their findings (fixed values).
FINDINGS = {
    "activity-without-audit": ("missing-durable-audit", "warn"), "audit-without-activity": ("audit-without-activity", "info"), "operational-only": ("operational-only", "info"),
    "policy-denied": ("policy-denied", "info"), "operational-error": ("operational-error", "error"), "remote-sensitive-touch": ("remote-sensitive-touch", "error"),
}


def operations(records: DataFrame) -> DataFrame:
    """One row an operation: its span, distinct sorted attributes, and one boolean a flag."""
    sets = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    has = lambda s: F.bool_or(F.col("stream") == s)
    error = (F.col("stream") == "operational") & ((F.col("severity") == "error") | (F.col("outcome") == "server-error"))
    out = records.groupBy("operation_id").agg(
        F.min("recorded_at").alias("first_at"), F.max("recorded_at").alias("last_at"), F.count("*").alias("n"), sets("stream").alias("streams"), sets("plane").alias("planes"),
        sets("touched").alias("touched"), sets("policy_decision").alias("decisions"), sets("outcome").alias("outcomes"), F.bool_or("contains_sensitive").alias("sensitive"),
        F.count_if("redacted").alias("redacted"), has("audit").alias("_audit"), has("activity").alias("_activity"), has("operational").alias("_operational"),
        F.bool_or(F.coalesce(F.col("policy_decision") == "deny", F.lit(False))).alias("policy-denied"), F.bool_or(F.coalesce(error, F.lit(False))).alias("operational-error"),
        F.bool_or((F.col("plane") == "remote") & F.col("contains_sensitive") & ~F.col("redacted")).alias("remote-sensitive-touch"),
    )
    a, b, c = F.col("_audit"), F.col("_activity"), F.col("_operational")
    return out.withColumns({"activity-without-audit": b & ~a, "audit-without-activity": a & ~b, "operational-only": c & ~a & ~b}).drop("_audit", "_activity", "_operational")


def findings(ops: DataFrame) -> DataFrame:
    """One row a set flag: operation_id, flag, code, severity."""
    rows = F.array(*(F.struct(F.lit(k).alias("flag"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col(f"`{k}`").alias("on")) for k, (code, severity) in FINDINGS.items()))
    return ops.select("operation_id", F.inline(rows)).where("on").drop("on")


def report(records: DataFrame) -> DataFrame:
    """Counts by stream, plane, action and outcome in one pass of grouping sets."""
    dims = ["stream", "plane", "action", "outcome"]
    out = records.groupingSets([[F.col(d)] for d in dims], *dims).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    name = F.element_at(F.array(*(F.lit(d) for d in dims)), F.when(F.col("g") == 7, 1).when(F.col("g") == 11, 2).when(F.col("g") == 13, 3).otherwise(4))
    return out.select(name.alias("dimension"), F.coalesce(*dims, F.lit("none")).alias("member"), "n")


def request_rollup(requests: DataFrame) -> DataFrame:
    """Counts by status class, total and mean duration."""
    between = lambda a: F.count_if((F.col("status") >= a) & (F.col("status") < a + 100))
    return requests.agg(F.count("*").alias("requests"), between(200).alias("ok"), between(400).alias("client_errors"), between(500).alias("server_errors"), F.round(F.sum("duration_ms"), 2).alias("total_ms"), F.round(F.coalesce(F.avg("duration_ms"), F.lit(0.0)), 4).alias("mean_ms"))


def top_routes(requests: DataFrame, limit: int = 25) -> DataFrame:
    return requests.groupBy("route").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "route").limit(limit)


def client_usage(requests: DataFrame) -> DataFrame:
    """Calls, refusals and sums a client."""
    return requests.groupBy("client_id").agg(F.count("*").alias("calls"), F.count_if(F.col("status") == 403).alias("refusals"), F.round(F.sum("duration_ms"), 2).alias("total_ms"))


def reconcile_usage(audited: DataFrame, metered: DataFrame, tolerance: int = 0) -> DataFrame:
    """Audited calls against metered ones, null-safe on the client."""
    m = metered.select(F.col("client_id").alias("m_id"), F.col("calls").alias("metered"))
    out = audited.join(m, F.col("client_id").eqNullSafe(F.col("m_id")), "left")
    delta = F.col("calls") - F.coalesce("metered", F.lit(0))
    return out.select("client_id", "calls", F.coalesce("metered", F.lit(0)).alias("metered"), delta.alias("delta"), (F.abs(delta) <= tolerance).alias("reconciled"))


def rate_limited(requests: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """Calls of each client in fixed windows, and whether they exceed the limit."""
    start = (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / seconds) * seconds).cast("long")
    return requests.groupBy("client_id", start.alias("window_start")).agg(F.count("*").alias("calls")).withColumn("limited", F.col("calls") > limit)


def budget_ratios(usage: DataFrame, budgets: dict[str, float]) -> DataFrame:
    """Unpivoted metrics of one row against their budgets: metric, used, budget, ratio, within."""
    rows = F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("used"), F.lit(float(b)).alias("budget")) for k, b in budgets.items()))
    out = usage.select(F.inline(rows))
    return out.withColumn("ratio", F.round(F.col("used") / F.col("budget"), 6)).withColumn("within", F.col("used") <= F.col("budget"))


def sampled(records: DataFrame, trace: str, rate: float) -> DataFrame:
    """Traces whose last eight hex digits, as a share of their range, are at most ``rate``."""
    return records.where(F.conv(F.right(F.col(trace), F.lit(8)), 16, 10).cast("double") / 4294967295 <= rate)


def keyset_page(records: DataFrame, before: tuple[str, str] | None, limit: int) -> DataFrame:
    """Newest first by (recorded_at, source_event_id), strictly before the cursor; one more row tells whether there is a next page."""
    if before is not None:
        at, key = before
        records = records.where((F.col("recorded_at") < at) | ((F.col("recorded_at") == at) & (F.col("source_event_id") < key)))
    return records.orderBy(F.desc("recorded_at"), F.desc("source_event_id")).limit(limit + 1)


def uncovered(ranges: DataFrame, group: str) -> DataFrame:
    """Gaps between (start, end) ranges of a group: the running maximum of the ends before each start."""
    w = Window.partitionBy(group).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("covered", F.max("end").over(w)).where("start > covered").select(group, F.col("covered").alias("gap_start"), F.col("start").alias("gap_end"))
