"""One query for each operator, and its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import access
from chronoweave.functions import world_time as wt
from chronoweave.operators import assertions as asr
from chronoweave.operators import graph, replay, rules, search, sync
from chronoweave.operators.assertions import AssertionQuery
from chronoweave.plans.views import duck, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
READER = access.Grant("reader", ("open",))


def query(sql: str | None = None, *views: str):
    """Register a query (named like its function) with the SQL over these views."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = duck(sql, *views) if views else sql
        return fn

    return add


def log(spark, d):
    return view(spark, d, "v_assertions")


# belief and world time ------------------------------------------------------------------------

AT, PROBE = "1998-06-01", "1997-03"
LIVE = f"recorded_at <= '{AT}' AND (superseded_at IS NULL OR superseded_at > '{AT}')"


def bound(kind: str, value: str) -> str:
    """DuckDB SQL of ``lower_bound``."""
    back = lambda n: f"CASE WHEN {kind} = 'approximate' AND length({value}) = {n} THEN 1 ELSE 0 END"
    part = lambda a, n: f"coalesce(TRY_CAST(substr({value}, {a}, {n}) AS INT), 1)"
    return f"CAST(make_date({part(1, 4)} - {back(4)}, 1, 1) + to_months({part(6, 2)} - 1 - {back(7)}) + to_days({part(9, 2)} - 1 - {back(10)}) AS DATE)"


WORLD = f"""(from_kind IS NOT NULL OR to_kind IS NOT NULL) AND coalesce(from_kind, '') <> 'unknown' AND coalesce(to_kind, '') <> 'unknown'
    AND (from_kind IS NULL OR DATE '1997-04-01' > {bound('from_kind', 'from_value')}) AND (to_kind IS NULL OR DATE '1997-03-01' < {bound('to_kind', 'to_value')})"""
FIDELITY = "CASE WHEN from_kind IS NULL AND to_kind IS NULL THEN 'absent' WHEN from_kind = 'unknown' OR to_kind = 'unknown' THEN 'unknown' WHEN from_kind = 'approximate' OR to_kind = 'approximate' THEN 'approximate' ELSE 'exact' END"


@query("SELECT seq, assertion_id FROM v_assertions WHERE subject = 7 AND predicate = 'worked-at'", "v_assertions")
def f1_subject_predicate(s, d):
    return asr.considered(log(s, d), AssertionQuery(subject=7, predicate="worked-at")).select("seq", "assertion_id")


@query(f"SELECT seq, assertion_id, subject, predicate FROM v_assertions WHERE {LIVE}", "v_assertions")
def f2_belief_as_of(s, d):
    return asr.believed(log(s, d), AT).select("seq", "assertion_id", "subject", "predicate")


@query(f"SELECT seq, coalesce(superseded_by, -1) AS superseded_by FROM v_assertions WHERE recorded_at <= '{AT}'", "v_assertions")
def f3_include_superseded(s, d):
    return asr.believed(log(s, d), AT, True).select("seq", F.coalesce("superseded_by", F.lit(-1)).alias("superseded_by"))


@query("SELECT 'as-of-before-history-floor' AS refusal")
def f4_history_floor(s, d):
    try:
        return asr.query(log(s, d), AssertionQuery(as_of_recorded="1990-01-01"), floor="1995-01-01").select(F.lit("answered").alias("refusal")).limit(1)
    except asr.QueryRefused as e:
        return s.range(1).select(F.lit(str(e)).alias("refusal"))


@query(f"SELECT seq, subject, predicate, CASE WHEN 'approximate' IN (coalesce(from_kind, ''), coalesce(to_kind, '')) THEN 'possible' ELSE 'certain' END AS match FROM v_assertions WHERE {LIVE} AND {WORLD}", "v_assertions")
def f5_world_as_of(s, d):
    return asr.query(log(s, d), AssertionQuery(as_of_recorded=AT, as_of_valid=PROBE)).select("seq", "subject", "predicate", "match")


@query("SELECT seq, target FROM v_assertions WHERE superseded_at IS NULL AND kind = 'relationship' AND target = 9", "v_assertions")
def f6_target_kind(s, d):
    return asr.query(log(s, d), AssertionQuery(target=9, kind="relationship")).select("seq", "target")


@query("SELECT seq, assertion_id, predicate, value FROM v_assertions WHERE assertion_id = 'as123'", "v_assertions")
def f7_read_by_id(s, d):
    return log(s, d).where("assertion_id = 'as123'").select("seq", "assertion_id", "predicate", "value")


@query("WITH i AS (SELECT 'as' || (n * 3000)::VARCHAR AS id FROM range(8) t(n)) SELECT i.id, CASE WHEN a.seq IS NOT NULL THEN 'present' WHEN i.id = 'as18000' THEN 'reclaimed' ELSE 'never-existed' END AS state FROM i LEFT JOIN v_assertions a ON a.assertion_id = i.id", "v_assertions")
def f8_reclamation(s, d):
    ids = s.range(8).select(F.concat(F.lit("as"), (F.col("id") * 3000).cast("string")).alias("id"))
    return asr.reclamation(ids, log(s, d), s.range(1).select(F.lit("as18000").alias("id")))


@query("WITH i AS (SELECT n AS pos, 'as' || ((n * 7919) % 20000)::VARCHAR AS id FROM range(100) t(n)) SELECT pos, id, CASE WHEN a.seq IS NULL THEN 'unknown-id' ELSE 'ok' END AS outcome, predicate, value FROM i LEFT JOIN v_assertions a ON a.assertion_id = i.id", "v_assertions")
def f9_read_many(s, d):
    ids = s.range(100).select(F.col("id").alias("pos"), F.concat(F.lit("as"), ((F.col("id") * 7919) % 20000).cast("string")).alias("id"))
    return asr.read_many(log(s, d), ids, "assertion_id", ("predicate", "value"))


@query("WITH i AS (SELECT n AS pos, 'c' || (n * 37)::VARCHAR AS id FROM range(60) t(n)) SELECT pos, id, CASE WHEN e.entity_id IS NULL THEN 'unknown-id' ELSE 'ok' END AS outcome, type, display_name FROM i LEFT JOIN v_entities e ON e.entity_id = i.id", "v_entities")
def f10_read_entities(s, d):
    ids = s.range(60).select(F.col("id").alias("pos"), F.concat(F.lit("c"), (F.col("id") * 37).cast("string")).alias("id"))
    return asr.read_many(view(s, d, "v_entities"), ids, "entity_id", ("type", "display_name"))


@query("SELECT seq, CAST(CAST(recorded_at AS DATE) + INTERVAL 30 DAY AS DATE)::VARCHAR AS expires, CAST(CAST(recorded_at AS DATE) + INTERVAL 30 DAY AS DATE) < DATE '1998-06-01' AS expired FROM v_assertions WHERE client_id = 'client1'", "v_assertions")
def f11_submission_expiry(s, d):
    end = F.date_add(F.col("recorded_at").cast("date"), 30)
    return log(s, d).where("client_id = 'client1'").select("seq", end.cast("string").alias("expires"), (end < F.lit(AT).cast("date")).alias("expired"))


@query(f"SELECT a.seq, a.lineage_action FROM v_assertions a WHERE a.recorded_at <= '{AT}' AND a.lineage_action NOT IN ('retract', 'invalidate') AND NOT EXISTS (SELECT 1 FROM v_assertions b WHERE b.seq = a.superseded_by AND b.recorded_at <= '{AT}')", "v_assertions")
def f13_canonical_projection(s, d):
    return asr.canonical_projection(log(s, d), AT).select("seq", "lineage_action")


@query("SELECT seq FROM v_assertions WHERE from_kind IS NULL OR (from_kind <> 'unknown' AND from_value <= '1997-03' AND (to_value IS NULL OR to_value > '1997-03'))", "v_assertions")
def f14_valid_at_older_rule(s, d):
    return log(s, d).where("from_kind IS NULL OR (from_kind <> 'unknown' AND from_value <= '1997-03' AND (to_value IS NULL OR to_value > '1997-03'))").select("seq")


@query("SELECT object_ref, version, size FROM v_objects WHERE tombstone = 0 AND payload <> 'ciphertext'", "v_objects")
def f15_remote_readable(s, d):
    return view(s, d, "v_objects").where((F.col("tombstone") == 0) & (F.col("payload") != "ciphertext")).select("object_ref", "version", "size")


@query("SELECT ordinal, version, object_ref FROM v_objects QUALIFY row_number() OVER (PARTITION BY ordinal ORDER BY version DESC, object_ref DESC, tombstone DESC) = 1 AND tombstone = 0", "v_objects")
def f16_latest_objects(s, d):
    return sync.latest(view(s, d, "v_objects"), "ordinal", "version", "object_ref", "tombstone").where("tombstone = 0").select("ordinal", "version", "object_ref")


@query("SELECT ordinal, max(version) AS version, arg_max(object_ref, version) AS object_ref FROM v_objects WHERE ordinal = 33 GROUP BY ordinal", "v_objects")
def f17_latest_one(s, d):
    return view(s, d, "v_objects").where("ordinal = 33").groupBy("ordinal").agg(F.max("version").alias("version"), F.max_by("object_ref", "version").alias("object_ref"))


@query("SELECT count(*) FILTER (NOT withheld AND tier = 'open') AS listed, count(*) FILTER (withheld OR tier <> 'open') AS withheld_count FROM v_assertions", "v_assertions")
def f18_list_with_policy(s, d):
    ok = access.allowed(READER, F.col("tier"), F.col("withheld"))
    return log(s, d).agg(F.count_if(ok).alias("listed"), F.count_if(~ok).alias("withheld_count"))


@query("SELECT source_event_id, operation_id FROM v_replay WHERE stream = 'audit' AND policy_decision = 'deny' AND recorded_at >= '2024-01-05'", "v_replay")
def f19_audit_filters(s, d):
    return view(s, d, "v_replay").where("stream = 'audit' AND policy_decision = 'deny' AND recorded_at >= '2024-01-05'").select("source_event_id", "operation_id")


@query("SELECT source_event_id, recorded_at FROM v_replay WHERE (recorded_at, source_event_id) < ('2024-01-20 00:00:00', 'ev') ORDER BY recorded_at DESC, source_event_id DESC LIMIT 51", "v_replay")
def l5_keyset_page(s, d):
    return replay.keyset_page(view(s, d, "v_replay"), ("2024-01-20 00:00:00", "ev"), 50).select("source_event_id", "recorded_at")


@query("SELECT object_ref FROM v_objects WHERE payload <> 'plaintext' AND (key_ref IS NULL OR key_ref NOT IN ('key0', 'key1', 'key2', 'key3', 'key4', 'key5', 'key6'))", "v_objects")
def f21_orphan_ciphertext(s, d):
    ring = s.range(7).select(F.concat(F.lit("key"), F.col("id").cast("string")).alias("key_ref"))
    return view(s, d, "v_objects").where("payload <> 'plaintext'").join(F.broadcast(ring), "key_ref", "left_anti").select("object_ref")


@query("SELECT object_ref, version FROM v_objects WHERE version <> 4 ORDER BY object_ref LIMIT 100", "v_objects")
def f22_stale_keys(s, d):
    return view(s, d, "v_objects").where("version <> 4").orderBy("object_ref").limit(100).select("object_ref", "version")


@query("SELECT generation, status FROM v_batches WHERE (status = 'staged' AND generation < 40) OR (status = 'committed' AND generation < 10)", "v_batches")
def f23_retention(s, d):
    keep = s.createDataFrame([("staged", 40), ("committed", 10)], "status string, before long")
    return view(s, d, "v_batches").join(F.broadcast(keep), "status").where("generation < before").select("generation", "status")


@query("SELECT generation, CASE WHEN generation % 30 = 0 THEN 'full' WHEN generation % 5 = 0 THEN 'differential' ELSE 'none' END AS due FROM v_batches", "v_batches")
def f24_due_levels(s, d):
    g = F.col("generation")
    return view(s, d, "v_batches").select("generation", rules.first_match([(g % 30 == 0, "full"), (g % 5 == 0, "differential")], "none").alias("due"))


@query("WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS t FROM documents) SELECT doc_id FROM k WHERE r IN (SELECT (i * t) // 17 FROM range(17) x(i), (SELECT DISTINCT t FROM k) y)")
def f25_stride_sample(s, d):
    docs = view(s, d, "documents").select("doc_id")
    return sync.stride_sample(docs, "doc_id", 17, docs.count()).select("doc_id")


@query("SELECT source_event_id FROM (SELECT *, right(md5(operation_id), 8) AS h FROM v_replay) WHERE ('0x' || h)::UBIGINT / 4294967295.0 <= 0.25", "v_replay")
def f27_trace_sample(s, d):
    return replay.sampled(view(s, d, "v_replay").withColumn("trace", F.md5(F.col("operation_id").cast("binary"))), "trace", 0.25).select("source_event_id")


# projections ----------------------------------------------------------------------------------


@query(f"SELECT seq, {FIDELITY} AS fidelity FROM v_assertions", "v_assertions")
def p1_fidelity(s, d):
    return log(s, d).select("seq", wt.fidelity(F.col("from_kind"), F.col("to_kind")).alias("fidelity"))


@query("SELECT seq, NOT withheld AND tier = 'open' AS allowed, CASE WHEN withheld OR tier <> 'open' THEN 'redaction_' || substr(sha256('reader' || chr(0) || assertion_id), 1, 32) END AS stub_id, CASE WHEN withheld OR tier <> 'open' THEN CASE WHEN tier_rank - 10 <= 1 THEN 'shape' ELSE 'existence-only' END END AS disclosure_level, CASE WHEN NOT withheld AND tier = 'open' THEN predicate END AS predicate, CASE WHEN NOT withheld AND tier = 'open' THEN value END AS value FROM v_assertions", "v_assertions")
def p3_redaction_stubs(s, d):
    return asr.with_access(log(s, d), READER, ("predicate", "value"))


@query("SELECT seq, client_id = 'client2' AS may_supersede FROM v_assertions", "v_assertions")
def p4_may_supersede(s, d):
    return log(s, d).select("seq", access.may_supersede(access.Grant("client2"), F.col("client_id")).alias("may_supersede"))


@query("SELECT seq, CASE WHEN withheld THEN 'sensitivity-withheld' WHEN tier = 'restricted' THEN 'tier-not-granted' WHEN lineage_action = 'retract' THEN 'retracted' ELSE 'allowed' END AS reason FROM v_assertions", "v_assertions")
def p5_policy_reason(s, d):
    c = F.col
    return log(s, d).select("seq", rules.first_match([(c("withheld"), "sensitivity-withheld"), (c("tier") == "restricted", "tier-not-granted"), (c("lineage_action") == "retract", "retracted")], "allowed").alias("reason"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN '[redacted]' ELSE props END AS props FROM events")
def p7_field_redaction(s, d):
    return view(s, d, "events").select("event_id", F.when(F.col("event_type") == "error", "[redacted]").otherwise(F.col("props")).alias("props"))


@query("SELECT seq, 'change_1_' || seq::VARCHAR AS change_id, CASE WHEN withheld OR tier <> 'open' THEN NULL ELSE assertion_id END AS record FROM v_assertions", "v_assertions")
def p10_change_records(s, d):
    shown = access.allowed(READER, F.col("tier"), F.col("withheld"))
    return log(s, d).select("seq", F.concat(F.lit("change_1_"), F.col("seq").cast("string")).alias("change_id"), F.when(shown, F.col("assertion_id")).alias("record"))


@query(f"SELECT seq, CASE WHEN from_kind IN ('exact', 'approximate') THEN CAST({bound('from_kind', 'from_value')} AS VARCHAR) END AS lower, CASE WHEN to_kind IS NOT NULL THEN CAST({bound('to_kind', 'to_value')} AS VARCHAR) END AS upper FROM v_assertions", "v_assertions")
def p11_world_bounds(s, d):
    low = lambda k, v: wt.lower_bound(F.col(k), F.col(v)).cast("string")
    return log(s, d).select("seq", low("from_kind", "from_value").alias("lower"), low("to_kind", "to_value").alias("upper"))


VOCAB = "(VALUES " + ", ".join([f"('{p}', '{p}', 'canonical')" for p in rules.PREDICATES] + [f"('{a}', '{p}', 'safe-alias')" for a, p in rules.SAFE_ALIASES.items()] + [f"('{p}', NULL, 'direction-unsafe')" for p in rules.DIRECTION_UNSAFE] + [f"('{p}', NULL, 'retired')" for p in rules.RETIRED]) + ")"
SPELLINGS = [*rules.PREDICATES, *rules.SAFE_ALIASES, *rules.DIRECTION_UNSAFE, *rules.RETIRED, "no-such-predicate"]


def spelled(s, d):
    """A spelling for each order, so that all occur."""
    return view(s, d, "orders").select("o_orderkey", F.element_at(F.array(*map(F.lit, SPELLINGS)), (F.col("o_orderkey") % len(SPELLINGS) + 1).cast("int")).alias("name"))


@query(f"SELECT o.o_orderkey, o.name, v.c AS canonical, coalesce(v.s, 'unknown') AS source FROM (SELECT o_orderkey, [{', '.join(repr(x) for x in SPELLINGS)}][o_orderkey % {len(SPELLINGS)} + 1] AS name FROM orders) o LEFT JOIN {VOCAB} v(n, c, s) ON v.n = o.name")
def p13_canonical_predicates(s, d):
    return rules.canonical_predicates(spelled(s, d), "name").select("o_orderkey", "name", "canonical", "source")


@query("SELECT o_orderkey, [CASE WHEN o_orderkey % 2 = 0 THEN 'person' ELSE 'project' END][1] AS source_type, CASE WHEN o_orderkey % 3 = 0 THEN 'organization' ELSE 'occurrence' END AS target_type, CASE o_orderkey % 4 WHEN 0 THEN 'member-of' WHEN 1 THEN 'part-of' WHEN 2 THEN 'nonsense' ELSE 'participant-in' END AS predicate, array_to_string(list_filter([CASE WHEN o_orderkey % 4 = 2 THEN 'unknown-predicate' END, CASE WHEN (o_orderkey % 4 = 0 AND o_orderkey % 2 = 1) OR (o_orderkey % 4 = 1 AND o_orderkey % 2 = 0) OR (o_orderkey % 4 = 3 AND o_orderkey % 2 = 1) THEN 'domain' END, CASE WHEN (o_orderkey % 4 = 0 AND o_orderkey % 3 <> 0) OR (o_orderkey % 4 IN (1, 3) AND o_orderkey % 3 = 0) THEN 'range' END, CASE WHEN o_orderkey % 4 = 1 THEN 'same-kind' END], lambda x: x IS NOT NULL), ',') AS violations FROM orders")
def p14_endpoint_checks(s, d):
    k = F.col("o_orderkey")
    edges = view(s, d, "orders").select("o_orderkey", F.when(k % 2 == 0, "person").otherwise("project").alias("source_type"), F.when(k % 3 == 0, "organization").otherwise("occurrence").alias("target_type"), F.when(k % 4 == 0, "member-of").when(k % 4 == 1, "part-of").when(k % 4 == 2, "nonsense").otherwise("participant-in").alias("predicate"))
    return rules.endpoint_violations(edges)


@query("SELECT doc_id, CASE WHEN n <= 4096 THEN 'tiny' WHEN n <= 64000 THEN 'small' WHEN n <= 512000 THEN 'medium' WHEN n <= 5000000 THEN 'large' ELSE 'huge' END AS size_class FROM (SELECT doc_id, strlen(text) AS n FROM documents)")
def p21_size_class(s, d):
    return view(s, d, "documents").select("doc_id", search.size_class(F.octet_length("text")).alias("size_class"))


@query("SELECT subject, count(*) AS n, CASE WHEN count(*) = 1 THEN '1' WHEN count(*) <= 3 THEN '2-3' WHEN count(*) <= 10 THEN '4-10' ELSE '11+' END AS bucket, CAST(ceil(count(*) / 10.0) * 10 AS BIGINT) AS rounded FROM v_assertions GROUP BY subject", "v_assertions")
def p22_count_buckets(s, d):
    n = F.col("n")
    out = log(s, d).groupBy("subject").agg(F.count("*").alias("n"))
    return out.select("subject", "n", rules.first_match([(n == 1, "1"), (n <= 3, "2-3"), (n <= 10, "4-10")], "11+").alias("bucket"), access.bucket_count(n).alias("rounded"))


@query("SELECT doc_id, 'ref:' || substr(sha256('secret:' || source), 1, 16) AS source_ref, 'sha256:' || sha256(text) AS content_digest FROM documents")
def p24_opaque_refs(s, d):
    return view(s, d, "documents").select("doc_id", F.concat(F.lit("ref:"), F.substring(F.sha2(F.concat(F.lit("secret:"), "source"), 256), 1, 16)).alias("source_ref"), F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("content_digest"))


@query("SELECT seq, CASE WHEN tier_rank <= 50 THEN 'served' ELSE 'refused' END AS decision FROM v_assertions", "v_assertions")
def p27_tier_ceiling(s, d):
    return log(s, d).select("seq", F.when(F.coalesce("tier_rank", F.lit(99)) <= access.TIER_RANK["restricted"], "served").otherwise("refused").alias("decision"))


# aggregations ---------------------------------------------------------------------------------


@query(f"WITH h AS (SELECT *, {FIDELITY} AS f FROM v_assertions WHERE predicate = 'worked-at' AND {LIVE}) SELECT count(*) AS matched, count(*) FILTER (withheld OR tier <> 'open') AS withheld, count(*) FILTER (f IN ('exact', 'approximate')) AS with_valid_time, count(*) FILTER (f IN ('unknown', 'absent')) AS unknown_or_absent, count(DISTINCT client_id) > 1 AS mixed_clients, (SELECT count(*) FROM v_assertions WHERE predicate = 'worked-at') AS evaluated FROM h", "v_assertions")
def a1_coverage(s, d):
    return asr.coverage(log(s, d), AssertionQuery(predicate="worked-at", as_of_recorded=AT), READER)


@query(f"SELECT subject, predicate, count(*) AS n, string_agg(assertion_id, ',' ORDER BY assertion_id) AS ids, count(DISTINCT value) AS digests FROM v_assertions WHERE recorded_at <= '{AT}' AND predicate = 'job-title' GROUP BY ALL HAVING count(*) >= 2", "v_assertions")
def a3_contested(s, d):
    return asr.contested(asr.believed(log(s, d), AT, True), F.col("value"))


@query("SELECT predicate, bool_or(target IS NOT NULL) AS relational, 'multi-valued' AS cardinality FROM v_assertions GROUP BY predicate", "v_assertions")
def a4_registry(s, d):
    return asr.registry(log(s, d))


@query("SELECT DISTINCT predicate, kind FROM v_assertions", "v_assertions")
def a5_subtypes(s, d):
    return log(s, d).select("predicate", "kind").distinct()


@query("SELECT max(seq) AS watermark, count(*) AS rows FROM v_assertions", "v_assertions")
def a6_watermark(s, d):
    return log(s, d).agg(F.max("seq").alias("watermark"), F.count("*").alias("rows"))


@query("SELECT count(*) AS requests, count(*) FILTER (status BETWEEN 200 AND 299) AS ok, count(*) FILTER (status BETWEEN 400 AND 499) AS client_errors, count(*) FILTER (status BETWEEN 500 AND 599) AS server_errors, round(sum(duration_ms), 2) AS total_ms, round(avg(duration_ms), 4) AS mean_ms FROM v_requests", "v_requests")
def a7_request_rollup(s, d):
    return replay.request_rollup(view(s, d, "v_requests"))


@query("SELECT route, count(*) AS n FROM v_requests GROUP BY route ORDER BY n DESC, route LIMIT 25", "v_requests")
def a8_top_routes(s, d):
    return replay.top_routes(view(s, d, "v_requests"))


@query("SELECT status, sum(object_count)::BIGINT AS objects, sum(bytes)::BIGINT AS bytes, count(*) AS batches FROM v_batches WHERE generation >= 10 GROUP BY status", "v_batches")
def a9_batch_sums(s, d):
    return view(s, d, "v_batches").where("generation >= 10").groupBy("status").agg(F.sum("object_count").alias("objects"), F.sum("bytes").alias("bytes"), F.count("*").alias("batches"))


@query("WITH u AS (SELECT count(*)::DOUBLE AS requests, count(*) FILTER (status >= 500)::DOUBLE AS errors FROM v_requests) SELECT m AS metric, used, budget, round(used / budget, 6) AS ratio, used <= budget AS within FROM (SELECT 'requests' AS m, requests AS used, 8000.0::DOUBLE AS budget FROM u UNION ALL SELECT 'errors', errors, 1500.0 FROM u)", "v_requests")
def a10_budget_ratios(s, d):
    used = view(s, d, "v_requests").agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 500).alias("errors"))
    return replay.budget_ratios(used, {"requests": 8000, "errors": 1500})


@query("SELECT client_id, count(*) AS calls, count(*) FILTER (status = 403) AS refusals, round(sum(duration_ms), 2) AS total_ms FROM v_requests GROUP BY client_id", "v_requests")
def a12_client_usage(s, d):
    return replay.client_usage(view(s, d, "v_requests"))


OPS = """WITH o AS (SELECT operation_id, min(recorded_at) AS first_at, max(recorded_at) AS last_at, count(*) AS n, string_agg(DISTINCT stream, ',' ORDER BY stream) AS streams,
    coalesce(string_agg(DISTINCT touched, ',' ORDER BY touched), '') AS touched, bool_or(contains_sensitive) AS sensitive, count(*) FILTER (redacted) AS redacted,
    bool_or(stream = 'audit') AS au, bool_or(stream = 'activity') AS ac, bool_or(stream = 'operational') AS op, bool_or(coalesce(policy_decision = 'deny', false)) AS denied,
    bool_or(coalesce(stream = 'operational' AND (severity = 'error' OR outcome = 'server-error'), false)) AS failed, bool_or(plane = 'remote' AND contains_sensitive AND NOT redacted) AS remote FROM v_replay GROUP BY operation_id)"""


@query(OPS + ' SELECT operation_id, first_at, last_at, n, streams, touched, sensitive, redacted, denied AS "policy-denied", failed AS "operational-error" FROM o', "v_replay")
def a13_replay_operations(s, d):
    return replay.operations(view(s, d, "v_replay")).select("operation_id", "first_at", "last_at", "n", "streams", "touched", "sensitive", "redacted", "`policy-denied`", "`operational-error`")


FLAGS = " UNION ALL ".join(f"SELECT operation_id, '{flag}' AS flag, '{code}' AS code, '{severity}' AS severity FROM o WHERE {test}" for (flag, (code, severity)), test in zip(replay.FINDINGS.items(), ("ac AND NOT au", "au AND NOT ac", "op AND NOT au AND NOT ac", "denied", "failed", "remote")))


@query(f"{OPS} {FLAGS}", "v_replay")
def a14_replay_findings(s, d):
    return replay.findings(replay.operations(view(s, d, "v_replay")))


@query(" UNION ALL ".join(f"SELECT '{c}' AS dimension, coalesce({c}, 'none') AS member, count(*) AS n FROM v_replay GROUP BY {c}" for c in ("stream", "plane", "action", "outcome")), "v_replay")
def a15_replay_report(s, d):
    return replay.report(view(s, d, "v_replay"))


@query('WITH r AS (SELECT authority, ordinal AS "start", ordinal + size AS "end" FROM v_objects), m AS (SELECT *, max("end") OVER (PARTITION BY authority ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM r) SELECT authority, c AS gap_start, "start" AS gap_end FROM m WHERE "start" > c', "v_objects")
def a42_uncovered_ranges(s, d):
    ranges = view(s, d, "v_objects").select("authority", F.col("ordinal").alias("start"), (F.col("ordinal") + F.col("size")).alias("end"))
    return replay.uncovered(ranges, "authority")


@query('WITH r AS (SELECT authority, ordinal AS "start", ordinal + size AS "end" FROM v_objects), m AS (SELECT *, max("end") OVER (PARTITION BY authority ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM r) SELECT authority, count(*) AS gaps FROM m WHERE "start" > c GROUP BY authority', "v_objects")
def a20_gap_count(s, d):
    return a42_uncovered_ranges(s, d).groupBy("authority").agg(F.count("*").alias("gaps"))


@query("SELECT event_type, count(*) FILTER (status = 200) AS ok, count(*) FILTER (status <> 200) AS failed FROM v_requests GROUP BY event_type", "v_requests")
def a21_connector_coverage(s, d):
    return view(s, d, "v_requests").groupBy("event_type").agg(F.count_if(F.col("status") == 200).alias("ok"), F.count_if(F.col("status") != 200).alias("failed"))


@query("SELECT lang, count(*) - count(DISTINCT text) AS duplicate_texts, count(*) AS n FROM documents GROUP BY lang")
def a22_duplicates_by_dimension(s, d):
    digest = F.sha2("text", 256)  # a digest is counted, not the text
    return view(s, d, "documents").groupBy("lang").agg((F.count("*") - F.count_distinct(digest)).alias("duplicate_texts"), F.count("*").alias("n"))


@query("WITH e AS (SELECT subject, value, count(*) AS c FROM v_assertions GROUP BY ALL) SELECT subject, arg_max(value, (c, -ascii(value))) AS dominant, max(c) AS n FROM e GROUP BY subject", "v_assertions")
def a26_dominant_value(s, d):
    counts = log(s, d).groupBy("subject", "value").agg(F.count("*").alias("c"))
    return counts.groupBy("subject").agg(F.max_by("value", F.struct("c", (-F.ascii("value")).alias("a"))).alias("dominant"), F.max("c").alias("n"))


@query("""WITH r AS (SELECT user_id AS proposal, event_id % 6 AS g, event_id % 200 <> 7 AS high, event_id % 300 <> 11 AS ok, CASE event_id % 250 WHEN 3 THEN 'refutes' ELSE CASE WHEN event_id % 4 = 0 THEN 'supports' ELSE 'context' END END AS stance, CASE event_id % 40 WHEN 4 THEN 'public-web' WHEN 8 THEN 'linkedin' ELSE 'calendar' END AS kind FROM events),
    g AS (SELECT proposal, g, bool_or(stance = 'supports' AND kind = 'public-web') AS p, bool_or(stance = 'supports' AND kind = 'linkedin') AS l, bool_or(NOT high) AS a, bool_or(NOT ok) AS c, bool_or(stance = 'refutes') AS r FROM r GROUP BY ALL),
    x AS (SELECT proposal, count(*) AS independent_groups, CASE WHEN bool_or(a) THEN 'identity-ambiguous' WHEN bool_or(c) THEN 'proposal-conflict' WHEN bool_or(r) THEN 'evidence-conflict' WHEN count(*) FILTER (p) >= 2 THEN 'qualifies-two-independent-public' WHEN count(*) FILTER (p) >= 1 AND count(*) FILTER (l AND NOT p) >= 1 THEN 'qualifies-linkedin-plus-independent' ELSE 'insufficient-evidence' END AS reason FROM g GROUP BY proposal)
    SELECT *, CASE WHEN starts_with(reason, 'qualifies') THEN 'auto-apply' WHEN reason = 'insufficient-evidence' THEN 'research' ELSE 'owner-review' END AS recommendation FROM x""")
def a32_recommendation(s, d):
    e = F.col("event_id")
    stance = F.when(e % 250 == 3, "refutes").when(e % 4 == 0, "supports").otherwise("context")
    kind = F.when(e % 40 == 4, "public-web").when(e % 40 == 8, "linkedin").otherwise("calendar")
    rows = view(s, d, "events").select(F.col("user_id").alias("proposal"), (e % 6).alias("independence_key"), kind.alias("connector_kind"), stance.alias("stance"), F.when(e % 200 == 7, "low").otherwise("high").alias("identity_band"), (e % 300 != 11).alias("hash_ok"))
    return rules.recommendation(rows)


@query("SELECT tombstone = 1 AS tombstoned, count(*) AS n FROM v_objects GROUP BY ALL", "v_objects")
def a34_status_counts(s, d):
    return view(s, d, "v_objects").groupBy((F.col("tombstone") == 1).alias("tombstoned")).agg(F.count("*").alias("n"))


@query("SELECT tier, count(*) AS n, count(*) FILTER (withheld) AS withheld FROM v_assertions GROUP BY tier", "v_assertions")
def a35_tier_counts(s, d):
    return log(s, d).groupBy("tier").agg(F.count("*").alias("n"), F.count_if("withheld").alias("withheld"))


@query("SELECT sha256(text) AS digest, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def a37_duplicate_refs(s, d):
    return view(s, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT authority, greatest(max(generation) - max(CASE WHEN version <= 2 THEN generation ELSE 0 END), 0)::BIGINT AS lag FROM v_objects GROUP BY authority", "v_objects")
def a39_replication_lag(s, d):
    ack = F.max(F.when(F.col("version") <= 2, F.col("generation")).otherwise(0))
    return view(s, d, "v_objects").groupBy("authority").agg(F.greatest(F.max("generation") - ack, F.lit(0)).cast("long").alias("lag"))


@query("SELECT client_id, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS window_start, count(*) AS calls, count(*) > 3 AS limited FROM v_requests GROUP BY ALL", "v_requests")
def a41_rate_limit(s, d):
    return replay.rate_limited(view(s, d, "v_requests"), 3, 3600)


# joins and sets -------------------------------------------------------------------------------


@query("SELECT o.object_ref, o.generation FROM v_objects o JOIN v_batches b USING (generation) WHERE b.status = 'committed' AND generation > 12 AND generation <= 30", "v_batches")
def j1_committed_objects(s, d):
    return sync.committed_objects(view(s, d, "v_objects"), view(s, d, "v_batches"), 12, 30).select("object_ref", "generation")


@query("SELECT count(*) AS n FROM v_objects WHERE generation IN (SELECT generation FROM v_batches WHERE status = 'committed')", "v_batches")
def j3_committed_count(s, d):
    return sync.committed_counts(view(s, d, "v_objects"), view(s, d, "v_batches"))


@query("SELECT a.assertion_id, a.lineage_action, b.assertion_id AS by_id, b.lineage_action AS by_action FROM v_assertions a JOIN v_assertions b ON a.superseded_by = b.seq", "v_assertions")
def g9_lineage(s, d):
    return asr.lineage(log(s, d))


@query("WITH a AS (SELECT client_id, count(*) AS calls FROM v_requests GROUP BY 1), m AS (SELECT client_id, count(*) AS metered FROM v_requests WHERE request_id % 17 <> 0 GROUP BY 1) SELECT a.client_id, calls, coalesce(metered, 0) AS metered, calls - coalesce(metered, 0) AS delta, abs(calls - coalesce(metered, 0)) <= 4 AS reconciled FROM a LEFT JOIN m ON a.client_id IS NOT DISTINCT FROM m.client_id", "v_requests")
def j8_usage_reconciliation(s, d):
    r = view(s, d, "v_requests")
    count = lambda x: x.groupBy("client_id").agg(F.count("*").alias("calls"))
    return replay.reconcile_usage(count(r), count(r.where("request_id % 17 <> 0")), 4)


PRIOR, CURRENT = "doc_id % 10 <> 3", "doc_id % 10 <> 7"
CHANGED = "CASE WHEN doc_id % 10 = 5 THEN sha256(text || '!') ELSE sha256(text) END"


@query(f"WITH a AS (SELECT doc_id, sha256(text) AS x FROM documents WHERE {PRIOR}), b AS (SELECT doc_id, {CHANGED} AS x FROM documents WHERE {CURRENT}) SELECT doc_id, CASE WHEN a.x IS NULL THEN 'right-only' WHEN b.x IS NULL THEN 'left-only' WHEN a.x = b.x THEN 'identical' ELSE 'divergent' END AS state FROM a FULL JOIN b USING (doc_id)")
def j12_full_compare(s, d):
    docs = view(s, d, "documents")
    new = F.when(F.col("doc_id") % 10 == 5, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256))
    return sync.full_compare(docs.where(PRIOR).select("doc_id", F.sha2("text", 256).alias("x")), docs.where(CURRENT).select("doc_id", new.alias("x")), "doc_id", "x")


@query(f"WITH a AS (SELECT doc_id, sha256(text) AS x FROM documents WHERE {PRIOR}), b AS (SELECT doc_id, {CHANGED} AS x FROM documents WHERE {CURRENT}), c AS (SELECT CASE WHEN a.x IS NULL THEN 'right-only' WHEN b.x IS NULL THEN 'left-only' WHEN a.x = b.x THEN 'identical' ELSE 'divergent' END AS state FROM a FULL JOIN b USING (doc_id)) SELECT state, count(*) AS n FROM c GROUP BY state")
def j14_tree_compare(s, d):
    return j12_full_compare(s, d).groupBy("state").agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT route AS path FROM v_requests GROUP BY 1) SELECT x.path, y.path AS ancestor FROM p x JOIN (SELECT '/' || event_type AS path FROM v_requests GROUP BY 1) y ON starts_with(x.path, y.path || '/')", "v_requests")
def j15_ancestor_paths(s, d):
    r = view(s, d, "v_requests")
    tops = r.select(F.concat(F.lit("/"), "event_type").alias("ancestor")).distinct()
    return sync.ancestors(r.select(F.col("route").alias("path")).distinct()).where("path <> ancestor").join(F.broadcast(tops), "ancestor").select("path", "ancestor")


@query("(SELECT 'missing-in-index' AS side, doc_id FROM documents WHERE doc_id % 9 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels)) UNION ALL (SELECT 'missing-in-store', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 9 <> 0))")
def j16_drift(s, d):
    docs, labels = view(s, d, "documents").where("doc_id % 9 <> 0").select("doc_id"), view(s, d, "labels").select("doc_id")
    side = lambda a, b, name: a.join(b, "doc_id", "left_anti").select(F.lit(name).alias("side"), "doc_id")
    return side(docs, labels, "missing-in-index").union(side(labels, docs, "missing-in-store"))


@query("SELECT lower(display_name) AS title, type, min(entity_id) AS entity_id FROM v_entities GROUP BY 1, 2 HAVING count(DISTINCT entity_id) = 1", "v_entities")
def j20_unique_titles(s, d):
    return sync.unique_titles(view(s, d, "v_entities").withColumn("title", F.lower("display_name")), ("title", "type"), "entity_id")


TRAITS = "SELECT 'p' || p_partkey::VARCHAR AS id, t.trait, t.value FROM part, LATERAL (SELECT unnest(['name', 'brand', 'type', 'size']) AS trait, unnest([p_name, p_brand, p_type, p_size::VARCHAR]) AS value) t"


@query(f"WITH t AS ({TRAITS}), k AS (SELECT * FROM t WHERE substr(id, 2)::INT % 2 = 1), o AS (SELECT * FROM t WHERE substr(id, 2)::INT % 2 = 0), m AS (SELECT o.id, k.id AS entity FROM o JOIN k USING (trait, value) GROUP BY 1, 2 HAVING count(*) >= 3), c AS (SELECT id, count(*) AS n, min(entity) AS entity FROM m GROUP BY 1) SELECT i.id, CASE WHEN n IS NULL THEN 'mint' WHEN n = 1 THEN 'carry' ELSE 'ambiguous' END AS decision, CASE WHEN n = 1 THEN entity END AS entity FROM (SELECT DISTINCT id FROM o) i LEFT JOIN c USING (id)")
def j24_reidentify(s, d):
    parts = view(s, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.stack(F.lit(4), F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string")).alias("trait", "value"))
    return sync.reidentify(parts.where("substr(id, 2) % 2 = 0"), parts.where("substr(id, 2) % 2 = 1"), 3)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j25_uncovered_entries(s, d):
    return view(s, d, "documents").join(view(s, d, "labels").where("quality = 1"), "doc_id", "left_anti").select("doc_id")


@query("SELECT e.entity_id, a.seq, a.recorded_at FROM v_entities e JOIN v_assertions a ON e.entity_id = 'c' || a.subject::VARCHAR UNION ALL SELECT e.entity_id, a.seq, a.recorded_at FROM v_entities e JOIN v_assertions a ON e.entity_id = 'c' || a.target::VARCHAR WHERE a.target IS NOT NULL AND a.target <> a.subject", "v_entities", "v_assertions")
def j29_entity_timeline(s, d):
    e, a = view(s, d, "v_entities").select("entity_id"), log(s, d)
    by = lambda rows, c: rows.withColumn("entity_id", F.concat(F.lit("c"), F.col(c).cast("string"))).join(e, "entity_id").select("entity_id", "seq", "recorded_at")
    return by(a, "subject").unionByName(by(a.where("target IS NOT NULL AND target <> subject"), "target"))


@query("SELECT 'customer' AS kind, c_nationkey AS k FROM customer INTERSECT SELECT 'customer', s_nationkey FROM supplier WHERE s_suppkey % 4 = 0")
def u2_intersection(s, d):
    a = view(s, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("k"))
    return a.intersect(view(s, d, "supplier").where("s_suppkey % 4 = 0").select(F.lit("customer").alias("kind"), F.col("s_nationkey").alias("k")))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u3_except(s, d):
    return view(s, d, "documents").select("doc_id").subtract(view(s, d, "labels").select("doc_id"))


@query("SELECT stream, source_event_id, recorded_at FROM v_replay WHERE stream IN ('audit', 'activity')", "v_replay")
def u1_stream_union(s, d):
    r = view(s, d, "v_replay").select("stream", "source_event_id", "recorded_at")
    return r.where("stream = 'audit'").unionByName(r.where("stream = 'activity'"))


# windows and paging ---------------------------------------------------------------------------


@query("SELECT seq, subject, row_number() OVER (PARTITION BY subject ORDER BY recorded_at, seq) AS seq_no FROM v_assertions", "v_assertions")
def w1_gapless_seq(s, d):
    return asr.gapless_seq(log(s, d), "subject", ("recorded_at", "seq")).select("seq", "subject", F.col("seq_no").cast("long").alias("seq_no"))


@query("SELECT ordinal, version, version - lag(version) OVER (PARTITION BY ordinal ORDER BY version) - 1 AS missing FROM v_objects QUALIFY missing > 0", "v_objects")
def w5_version_gaps(s, d):
    from pyspark.sql import Window

    gap = F.col("version") - F.lag("version").over(Window.partitionBy("ordinal").orderBy("version")) - 1
    return view(s, d, "v_objects").withColumn("missing", gap).where("missing > 0").select("ordinal", "version", "missing")


@query("SELECT path, ref, row_number() OVER (PARTITION BY path ORDER BY ref) AS ordinal FROM (SELECT DISTINCT path, unnest(regexp_extract_all(markdown, '\\[\\[([^\\]\\n]{1,256})\\]\\]', 1)) AS ref FROM v_markdown)", "v_markdown")
def w7_occurrence_ordinal(s, d):
    refs = view(s, d, "v_markdown").select("path", F.explode(F.regexp_extract_all("markdown", F.lit(r"\[\[([^\]\n]{1,256})\]\]"), F.lit(1))).alias("ref")).distinct()
    return asr.gapless_seq(refs, "path", ("ref",)).select("path", "ref", F.col("seq_no").cast("long").alias("ordinal"))


@query("WITH b AS (SELECT * FROM v_batches WHERE status = 'committed' AND generation > 4 ORDER BY generation LIMIT 50), r AS (SELECT *, sum(object_count) OVER (ORDER BY generation) AS total, row_number() OVER (ORDER BY generation) AS k FROM b) SELECT generation, object_count, total::BIGINT AS total FROM r WHERE k = 1 OR total <= 20000", "v_batches")
def w8_pull_page(s, d):
    return sync.pull_page(view(s, d, "v_batches"), 4, 20000).select("generation", "object_count", "total")


@query("WITH r AS (SELECT *, sum(size) OVER (PARTITION BY authority ORDER BY object_ref, size ROWS UNBOUNDED PRECEDING) AS total, row_number() OVER (PARTITION BY authority ORDER BY object_ref, size) AS k FROM v_objects) SELECT authority, object_ref, size, total::BIGINT AS total FROM r WHERE total <= 250 OR k = 1", "v_objects")
def w9_greedy_batch(s, d):
    return sync.packed(view(s, d, "v_objects"), "authority", ("object_ref", "size"), "size", 250).select("authority", "object_ref", "size", "total")


@query("WITH l AS (SELECT path, generate_subscripts(string_split(markdown, chr(10)), 1) - 1 AS pos, unnest(string_split(markdown, chr(10))) AS line FROM v_markdown), m AS (SELECT *, regexp_matches(line, '^\\s*- ') AS bullet, min(CASE WHEN regexp_matches(line, '^\\s*- ') THEN pos END) OVER (PARTITION BY path) AS f FROM l) SELECT path, pos, CASE WHEN bullet THEN length(regexp_extract(line, '^(\\s*)', 1)) // 2 ELSE -1 END AS depth, regexp_matches(line, '^#{1,6}\\s') AS heading, regexp_matches(line, '^[A-Za-z0-9_-]+:: ') AND pos < coalesce(f, 1073741824) AS page_property FROM m", "v_markdown")
def w11_outline(s, d):
    return search.outline(view(s, d, "v_markdown"))


@query("SELECT seq, assertion_id FROM v_assertions WHERE seq > 400 AND seq <= 9000 ORDER BY seq LIMIT 60", "v_assertions")
def l1_snapshot_page(s, d):
    return asr.page(log(s, d), 400, 60, watermark=9000).select("seq", "assertion_id")


@query("SELECT seq, assertion_id, recorded_at FROM v_assertions WHERE seq > 700 ORDER BY seq LIMIT 101", "v_assertions")
def l3_change_feed_page(s, d):
    return log(s, d).where("seq > 700").orderBy("seq").limit(101).select("seq", "assertion_id", "recorded_at")


@query("SELECT generation, status FROM v_batches WHERE generation > 7 ORDER BY generation LIMIT 26", "v_batches")
def l6_sync_pull(s, d):
    return view(s, d, "v_batches").where("generation > 7").orderBy("generation").limit(26).select("generation", "status")


@query("SELECT source_event_id, recorded_at FROM v_replay ORDER BY recorded_at DESC, source_event_id DESC LIMIT 40", "v_replay")
def l10_tail(s, d):
    return replay.keyset_page(view(s, d, "v_replay"), None, 39).select("source_event_id", "recorded_at")


# graph ----------------------------------------------------------------------------------------

AFFIRMED = "lineage_action IN ('assert', 'correct', 'reinstate', 'invalidate')"


def origins(s, d):
    return view(s, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("origin")).withColumn("node", F.col("origin"))


@query(f"WITH e AS (SELECT * FROM v_edges WHERE {AFFIRMED}), h1 AS (SELECT src AS origin, 1 AS depth, seq, src AS here, dst AS there FROM e WHERE src LIKE 'c%'), h2 AS (SELECT h1.origin, 2 AS depth, e.seq, e.src AS here, e.dst AS there FROM h1 JOIN e ON e.src = h1.there) SELECT * FROM h1 UNION ALL SELECT * FROM h2", "v_edges")
def g1_neighbors(s, d):
    return graph.neighbors(view(s, d, "v_edges"), origins(s, d), max_depth=3)


@query(f"SELECT seq, src, dst FROM v_edges WHERE {AFFIRMED}", "v_edges")
def g2_affirmed_edges(s, d):
    return graph.affirmed(view(s, d, "v_edges")).select("seq", "src", "dst")


@query(f"WITH e AS (SELECT * FROM v_edges WHERE {AFFIRMED}), b AS (SELECT seq, src AS here, dst AS there FROM e UNION ALL SELECT seq, dst, src FROM e), o AS (SELECT 'r' || r_regionkey::VARCHAR AS origin FROM region), h1 AS (SELECT origin, there FROM o JOIN b ON b.here = o.origin), h2 AS (SELECT h1.origin, b.there FROM h1 JOIN b ON b.here = h1.there), a AS (SELECT origin, there AS node, 1 AS depth FROM h1 UNION ALL SELECT origin, there, 2 FROM h2 WHERE there <> origin) SELECT origin, node, min(depth) AS depth FROM a WHERE origin <> node GROUP BY 1, 2", "v_edges")
def g3_traverse(s, d):
    regions = view(s, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("origin")).withColumn("node", F.col("origin"))
    return graph.traverse(view(s, d, "v_edges"), regions, 2)


@query("WITH RECURSIVE m AS (SELECT old_id, new_id FROM v_alias_rows WHERE disposition = 'mapped'), w AS (SELECT c_custkey AS id, c_custkey AS target, 0 AS h FROM customer UNION ALL SELECT w.id, m.new_id, h + 1 FROM w JOIN m ON m.old_id = w.target WHERE h < 32), l AS (SELECT id, arg_max(target, h) AS target FROM w GROUP BY id) SELECT l.id, l.target, coalesce(a.disposition, CASE WHEN l.id = l.target THEN 'current' ELSE 'redirected' END) AS outcome FROM l LEFT JOIN v_alias_rows a ON a.old_id = l.target".replace("WITH RECURSIVE", "WITH"), "v_alias_rows")
def g4_resolve(s, d):
    ids = view(s, d, "customer").select(F.col("c_custkey").alias("id"))
    return graph.resolve(view(s, d, "v_alias_rows"), ids, ids)


SQL["g4_resolve"] = SQL["g4_resolve"].replace("WITH ", "WITH RECURSIVE ", 1)


@query("SELECT * FROM (SELECT assertion_id AS id, 'recorded' AS field, recorded_at AS day FROM v_assertions UNION ALL SELECT assertion_id, 'superseded', superseded_at FROM v_assertions UNION ALL SELECT assertion_id, 'valid_from', from_value FROM v_assertions) WHERE day BETWEEN '1996-01-01' AND '1997-12-31'", "v_assertions")
def g10_timeline(s, d):
    return graph.timeline(log(s, d).withColumn("id", F.col("assertion_id")), {"recorded": "recorded_at", "superseded": "superseded_at", "valid_from": "from_value"}, "1996-01-01", "1997-12-31")


@query()
def g6_resolution_replay(s, d):
    rows = view(s, d, "orders").select((F.col("o_custkey") % 100).alias("authority"), F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderkey") % 9 == 0, "split").otherwise("merge").alias("decision"), F.concat(F.lit("m"), (F.col("o_orderkey") % 13).cast("string")).alias("member"), F.concat(F.lit("m"), (F.col("o_custkey") % 17).cast("string")).alias("into"))
    return graph.replay_resolutions(rows)


# text -----------------------------------------------------------------------------------------


@query("WITH c AS (SELECT entity_id, type, CASE WHEN lower(display_name) = 'red' THEN 1.0 WHEN starts_with(lower(display_name), 'red') THEN 0.8 WHEN contains(lower(display_name), 'red') THEN 0.5 ELSE 0.0 END AS n, CASE WHEN lower(alias) = 'red' THEN 1.0 WHEN starts_with(lower(alias), 'red') THEN 0.8 WHEN contains(lower(alias), 'red') THEN 0.5 ELSE 0.0 END AS a FROM v_entities) SELECT entity_id, type, greatest(n, a)::DOUBLE AS score, CASE WHEN n >= a THEN 'display-name' ELSE 'alias' END AS basis FROM c WHERE greatest(n, a) > 0 ORDER BY score DESC, entity_id LIMIT 200", "v_entities")
def t1_text_search(s, d):
    return search.text_search(view(s, d, "v_entities"), "red", 200).select("entity_id", "type", "score", "basis")


@query("WITH c AS (SELECT doc_id, text, ((length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3) AS a, ((length(lower(text)) - length(replace(lower(text), 'tion', ''))) // 4) AS b FROM documents) SELECT doc_id, a + b AS score, concat_ws(',', CASE WHEN a > 0 THEN 'the' END, CASE WHEN b > 0 THEN 'tion' END) AS matched, substr(text, 1, 240) AS snippet FROM c WHERE a + b > 0 ORDER BY score DESC, doc_id LIMIT 50")
def t2_term_search(s, d):
    return search.term_search(view(s, d, "documents"), "the tion", 50)


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}])(the|und)(s|es|ed|ing)?($|[^\\p{L}\\p{N}])') THEN 'restricted' WHEN regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}])(de|la)(s|es|ed|ing)?($|[^\\p{L}\\p{N}])') THEN 'sealed' ELSE 'open' END AS tier FROM documents")
def t4_tier_classifier(s, d):
    return view(s, d, "documents").select("doc_id", search.tier_of(F.col("text"), (("restricted", ("the", "und")), ("sealed", ("de", "la")))).alias("tier"))


SHORT_NEEDLES = ((-1, "license"), (-2, "@"), (-3, " und "), (-4, "no such needle anywhere"), (-5, "###"))


@query(f"SELECT d.doc_id, b.item_id, instr(d.text, b.text) - 1 AS offset FROM documents d, (SELECT item_id, text FROM benchmark UNION ALL VALUES {', '.join(map(str, SHORT_NEEDLES))}) b WHERE contains(d.text, b.text)")
def t7_bait_scan(s, d):
    short = s.createDataFrame(SHORT_NEEDLES, "item_id long, text string")
    return search.bait_scan(view(s, d, "documents"), view(s, d, "benchmark").select(F.col("item_id").cast("long"), "text").union(short))


@query("SELECT event_id, NOT regexp_matches(props, '[0-9]{2}') AS opaque FROM events")
def t8_path_opacity(s, d):
    return view(s, d, "events").select("event_id", (~F.col("props").rlike("[0-9]{2}")).alias("opaque"))


@query("WITH x AS (SELECT path, markdown AS m FROM v_markdown) SELECT path, len(regexp_extract_all(m, '(?m)^#{1,6}[\\t\\n\\f\\r ]+[^\\t\\n\\f\\r ]')) AS headings, len(regexp_extract_all(m, '\\[\\[([^\\]\\n]{1,256})\\]\\]')) AS wikilinks, len(regexp_extract_all(m, '\\(\\(([A-Za-z0-9_-]{3,128})\\)\\)')) AS block_refs, len(regexp_extract_all(m, '(?m)^[ \\t]*[A-Za-z0-9_-]+::')) AS properties FROM x", "v_markdown")
def t10_markdown_summary(s, d):
    return search.markdown_summary(view(s, d, "v_markdown")).select("path", "headings", "wikilinks", "block_refs", "properties")


@query("WITH r AS (SELECT path, 'wikilink' AS kind, lower(trim(split_part(unnest(regexp_extract_all(markdown, '\\[\\[([^\\]\\n]{1,256})\\]\\]', 1)), '|', 1))) AS target FROM v_markdown UNION ALL SELECT path, 'block-ref', lower(unnest(regexp_extract_all(markdown, '\\(\\(([A-Za-z0-9_-]{3,128})\\)\\)', 1))) FROM v_markdown UNION ALL SELECT path, 'hash-tag', lower(unnest(regexp_extract_all(markdown, '(^|[ \\t\\n(\\[{])#([A-Za-z0-9_/-]{1,80})', 2))) FROM v_markdown UNION ALL SELECT path, 'markdown-link', lower(unnest(regexp_extract_all(markdown, '\\[[^\\]\\n]{1,256}\\]\\(([^) \\t\\n]{1,512})', 1))) FROM v_markdown) SELECT * FROM r WHERE target <> ''", "v_markdown")
def t11_references(s, d):
    return search.references(view(s, d, "v_markdown"))


@query("WITH r AS (SELECT path, lower(trim(split_part(unnest(regexp_extract_all(markdown, '\\[\\[([^\\]\\n]{1,256})\\]\\]', 1)), '|', 1))) AS t FROM v_markdown) SELECT path, 'wikilink' AS kind, sha256('reference:s:wikilink:' || t) AS ref_hash, count(*) AS occurrences FROM r WHERE t <> '' GROUP BY 1, 2, 3", "v_markdown")
def a36_reference_digests(s, d):
    return search.reference_digests(view(s, d, "v_markdown"), "s").where("kind = 'wikilink'")


@query("SELECT path, split_part(m, '::', 1) AS key, trim(split_part(m, '::', 2)) AS value FROM (SELECT path, unnest(regexp_extract_all(markdown, '(?m)^[A-Za-z0-9_-]+::[^\\n]*')) AS m FROM v_markdown)", "v_markdown")
def t12_properties(s, d):
    found = view(s, d, "v_markdown").select("path", F.explode(F.regexp_extract_all("markdown", F.lit(r"(?m)^[A-Za-z0-9_-]+::[^\n]*"), F.lit(0))).alias("m"))
    return found.select("path", F.split_part("m", F.lit("::"), F.lit(1)).alias("key"), F.trim(F.split_part("m", F.lit("::"), F.lit(2))).alias("value"))


@query("SELECT doc_id, i AS ordinal, substr(text, i * 8192 + 1, 8192) AS chunk FROM (SELECT doc_id, text, unnest(range((length(text) + 8191) // 8192)) AS i FROM documents WHERE length(text) > 0)")
def t17_chunks(s, d):
    return search.chunks(view(s, d, "documents"), 8192)


# scalars --------------------------------------------------------------------------------------


@query("SELECT event_id, trim(regexp_replace(lower('#' || event_type || '  x'), '^#', '')) AS tag, substr(props, 1, 4) AS head, strftime(ts, '%Y-%m-%d') AS day, CAST(floor(epoch(ts) / 60) * 60 AS BIGINT) AS minute, CAST(ceil(value / 10) * 10 AS BIGINT) AS bucket, round(value / 7.0, 3) AS ratio, sha256(event_type) AS hash, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def x_scalars(s, d):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return view(s, d, "events").select(
        "event_id", F.trim(F.regexp_replace(F.lower(F.concat(F.lit("#"), "event_type", F.lit("  x"))), "^#", "")).alias("tag"), F.substring("props", 1, 4).alias("head"), F.date_format("ts", "yyyy-MM-dd").alias("day"),
        (F.floor(seconds / 60) * 60).cast("long").alias("minute"), (F.ceil(F.col("value") / 10) * 10).cast("long").alias("bucket"), F.round(F.col("value") / 7.0, 3).alias("ratio"), F.sha2("event_type", 256).alias("hash"), F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


@query("SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS types, list_contains(list(event_type), 'error') AS failed, max(len(event_type)) AS longest FROM events GROUP BY user_id")
def x_arrays(s, d):
    return view(s, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"), F.bool_or(F.col("event_type") == "error").alias("failed"), F.max(F.length("event_type")).cast("long").alias("longest"))


# incremental ----------------------------------------------------------------------------------


@query("WITH p AS (SELECT 'client' || (event_id % 5)::VARCHAR AS client_id, 'k' || (event_id % 2000)::VARCHAR AS idempotency_key, event_type AS request_digest, event_id FROM events), r AS (SELECT client_id, idempotency_key, arg_min(request_digest, event_id) AS known, min(event_id) AS first FROM p GROUP BY 1, 2) SELECT event_id, CASE WHEN event_id = first THEN 'fresh' WHEN known = request_digest THEN 'replay' ELSE 'conflict' END AS outcome FROM p JOIN r USING (client_id, idempotency_key)")
def r4_idempotent_commit(s, d):
    """Every event proposes; the first of a key is fresh, and later ones meet its receipt."""
    e = view(s, d, "events").select(F.concat(F.lit("client"), (F.col("event_id") % 5).cast("string")).alias("client_id"), F.concat(F.lit("k"), (F.col("event_id") % 2000).cast("string")).alias("idempotency_key"), F.col("event_type").alias("request_digest"), "event_id")
    receipts = e.groupBy("client_id", "idempotency_key").agg(F.min(F.struct("event_id", "request_digest")).alias("f"))
    first = receipts.select(F.col("f.event_id").alias("event_id"))
    later = asr.receipts_outcome(e.join(first, "event_id", "left_anti"), receipts.select("client_id", "idempotency_key", "f.request_digest"))
    return later.select("event_id", "outcome").union(first.select("event_id", F.lit("fresh")))


@query()
def r5_sequencer(s, d):
    e = F.col("event_id")
    rows = view(s, d, "events").select((F.col("user_id")).alias("authority"), e.alias("pos"), (e - e % 3).alias("batch_id"), (e % 4).alias("base"), (e % 4 + 1).alias("target"))
    return sync.sequencer(rows)


@query("SELECT o_orderkey, CASE WHEN l = b AND r = b THEN 'idle' WHEN r = b THEN 'push' WHEN l = b THEN 'pull' ELSE 'recover' END AS plan FROM (SELECT o_orderkey, o_orderkey % 3 AS l, o_custkey % 3 AS r, 1 AS b FROM orders)")
def r7_sync_plan(s, d):
    return view(s, d, "orders").select("o_orderkey", sync.sync_plan(F.col("o_orderkey") % 3, F.col("o_custkey") % 3, F.lit(1)).alias("plan"))


@query("SELECT generation, count(*) FILTER (payload <> 'plaintext') AS sent, count(*) FILTER (payload = 'plaintext') AS withheld_plaintext FROM v_objects GROUP BY generation", "v_objects")
def r8_build_batch(s, d):
    return view(s, d, "v_objects").groupBy("generation").agg(F.count_if(F.col("payload") != "plaintext").alias("sent"), F.count_if(F.col("payload") == "plaintext").alias("withheld_plaintext"))


@query("SELECT object_ref, generation FROM v_objects WHERE generation > 41", "v_objects")
def r9_differential(s, d):
    return view(s, d, "v_objects").where("generation > 41").select("object_ref", "generation")


@query("SELECT route, count(*) AS n FROM v_requests WHERE ts >= TIMESTAMP '2024-01-29 00:00:00' AND ts < TIMESTAMP '2024-01-30 00:00:00' GROUP BY route", "v_requests")
def r11_trailing_window(s, d):
    return view(s, d, "v_requests").where("ts >= TIMESTAMP '2024-01-29 00:00:00' AND ts < TIMESTAMP '2024-01-30 00:00:00'").groupBy("route").agg(F.count("*").alias("n"))


# pipelines ------------------------------------------------------------------------------------


@query("SELECT DISTINCT 'topic_' || substr(sha256(lower(trim(p_type))), 1, 16) AS topic_id, lower(trim(p_type)) AS label FROM part")
def e6_topic_nodes(s, d):
    label = F.lower(F.trim("p_type"))
    return view(s, d, "part").select(F.concat(F.lit("topic_"), F.substring(F.sha2(label, 256), 1, 16)).alias("topic_id"), label.alias("label")).distinct()


@query("SELECT seq, row_number() OVER (PARTITION BY subject ORDER BY seq) AS retraction FROM v_assertions WHERE lineage_action = 'retract'", "v_assertions")
def e7_retractions(s, d):
    return asr.gapless_seq(log(s, d).where("lineage_action = 'retract'"), "subject", ("seq",)).select("seq", F.col("seq_no").cast("long").alias("retraction"))


@query("SELECT doc_id, CASE WHEN text IS NULL THEN 'unreadable' WHEN length(trim(text)) = 0 THEN 'empty' WHEN strlen(text) > 16384 THEN 'oversized' ELSE 'ready' END AS status FROM documents")
def e18_manifest(s, d):
    t = F.col("text")
    return view(s, d, "documents").select("doc_id", F.when(t.isNull(), "unreadable").when(F.length(F.trim(t)) == 0, "empty").when(F.octet_length(t) > 16384, "oversized").otherwise("ready").alias("status"))


@query("SELECT doc_id, sha256(text) = sha256(text || CASE WHEN doc_id % 50 = 1 THEN ' ' ELSE '' END) AS intact FROM documents")
def e19_export_check(s, d):
    copy = F.concat("text", F.when(F.col("doc_id") % 50 == 1, " ").otherwise(""))
    return view(s, d, "documents").select("doc_id", (F.sha2("text", 256) == F.sha2(copy, 256)).alias("intact"))
