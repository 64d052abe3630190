"""Queries of migrations, transactions, redirects being written, hash chains and further sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.operators import chain, envelopes, identity, migration
from chronoweave.plans.queries import SQL, query
from chronoweave.plans.views import view
from chronoweave.sources import tables

PLAN = ("v_plan_outcomes", "v_plan_claims", "v_plan_aliases", "v_plan_records")


def plan(s, d):
    return migration.Plan(*(view(s, d, name) for name in PLAN))


@query("""WITH k AS (SELECT record_key, count(*) AS made, count(*) FILTER (from_legacy) AS legacy FROM v_plan_records GROUP BY 1),
    c AS (SELECT record_key, count(*) AS claims FROM v_plan_claims GROUP BY 1),
    b AS (SELECT record_key, coalesce(made, 0) AS made, coalesce(legacy, 0) AS legacy, coalesce(claims, 0) AS claims FROM k FULL JOIN c USING (record_key)),
    t AS (SELECT lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS word, slot, min({'scheme': scheme, 'mechanism': mechanism}) AS m FROM v_plan_records WHERE kind IN ('entity', 'minted-entity') AND scheme IS NOT NULL AND name IS NOT NULL GROUP BY 1, 2),
    g AS (SELECT word, slot, count(*) OVER (PARTITION BY word, m.scheme) AS same, bool_or(m.mechanism <> 'projected-from-corpus') OVER (PARTITION BY word, m.scheme) AS minted, min(m.scheme) OVER (PARTITION BY word) <> max(m.scheme) OVER (PARTITION BY word) AS spread FROM t),
    s AS (SELECT slot FROM v_plan_records WHERE kind IN ('entity', 'minted-entity')),
    f AS (SELECT 'unclassified-source-category' AS code, legacy_id AS subject, 1 AS n FROM v_plan_outcomes WHERE category = 'other' OR (disposition = 'refused' AND reason = 'unclassified-source-category')
    UNION ALL SELECT 'unnamed-refusal-reason', legacy_id, 1 FROM v_plan_outcomes WHERE disposition = 'refused' AND reason = 'other'
    UNION ALL SELECT 'unnamed-source-disposition', legacy_id, 1 FROM v_plan_outcomes WHERE disposition = 'other'
    UNION ALL SELECT 'alias-row-missing', legacy_id, 1 FROM v_plan_outcomes WHERE alias_kind IS NULL
    UNION ALL SELECT DISTINCT 'alias-target-missing-record', legacy_id, 1 FROM v_plan_aliases WHERE record_key NOT IN (SELECT record_key FROM k)
    UNION ALL SELECT 'duplicate-idempotency-key', record_key, made - 1 FROM b WHERE made > 1
    UNION ALL SELECT 'record-not-accounted', record_key, greatest(claims - 1, 0) FROM b WHERE claims > 1
    UNION ALL SELECT 'record-not-accounted', record_key, claims FROM b WHERE made = 0
    UNION ALL SELECT 'record-not-accounted', record_key, legacy FROM b WHERE claims = 0 AND legacy > 0
    UNION ALL SELECT 'record-not-accounted', record_key, made - legacy FROM b WHERE claims > 0 AND made > legacy
    UNION ALL SELECT 'retraction-target-missing', record_key, 1 FROM v_plan_records WHERE kind = 'retraction' AND retracts NOT IN (SELECT record_key FROM k)
    UNION ALL SELECT 'dangling-projected-endpoint', record_key, 1 FROM v_plan_records WHERE kind IN ('relationship', 'minted-relationship') AND NOT (source_slot IN (SELECT slot FROM s) AND target_slot IN (SELECT slot FROM s))
    UNION ALL SELECT 'duplicate-minted-topic', slot, 1 FROM g WHERE same > 1 AND minted UNION ALL SELECT 'duplicate-source-topic', slot, 1 FROM g WHERE same > 1 AND NOT minted
    UNION ALL SELECT 'cross-scheme-topic-homonym', slot, 1 FROM g WHERE spread
    UNION ALL SELECT 'unnamed-topic-scheme', slot, 1 FROM v_plan_records WHERE scheme = 'other'
    UNION ALL SELECT 'invalid-record-shape', record_key, 1 FROM v_plan_records WHERE kind IN ('entity', 'minted-entity') AND name IS NULL
    UNION ALL SELECT 'unmodelled-record-carried', record_key, 1 FROM v_plan_records WHERE kind = 'provisional-block'
    UNION ALL SELECT 'closure-arithmetic-mismatch', NULL, 0 FROM v_plan_outcomes HAVING count(*) FILTER (disposition IN ('projected', 'refused')) <> count(*))
    SELECT code, CASE WHEN code IN ('duplicate-source-topic', 'cross-scheme-topic-homonym', 'unmodelled-record-carried') THEN 'tolerated' ELSE 'failure' END AS severity, sum(n)::BIGINT AS subject_count,
    coalesce(array_to_string(list_sort(list_distinct(list(subject)))[1:20], ' '), '') AS subjects FROM f GROUP BY 1""", *PLAN)
def e9_closure_gate(s, d):
    return migration.closure_findings(plan(s, d)).withColumn("subjects", F.array_join("subjects", " "))


@query("""WITH o AS (SELECT 'legacy-id-resolution' AS "check", CASE WHEN held IS NULL THEN 'legacy-id-missing' WHEN held <> want THEN 'legacy-id-class-mismatch' END AS code, '' AS field
      FROM (SELECT legacy_id, CASE alias_kind WHEN 'record' THEN 'mapped' ELSE alias_kind END AS want FROM v_plan_outcomes WHERE alias_kind IS NOT NULL) LEFT JOIN (SELECT legacy_id, max(disposition) AS held FROM v_store_aliases GROUP BY 1) USING (legacy_id)),
    a AS (SELECT record_key, min({'kind': kind, 'name': name, 'source_slot': source_slot, 'target_slot': target_slot}) AS a FROM v_plan_records GROUP BY 1),
    b AS (SELECT record_key, min({'kind': kind, 'name': name, 'source_slot': source_slot, 'target_slot': target_slot}) AS b FROM v_store_records GROUP BY 1),
    x AS (SELECT * FROM a FULL JOIN b USING (record_key)),
    f AS (SELECT * FROM o UNION ALL SELECT 'record-counts', CASE WHEN b IS NULL THEN 'record-missing' WHEN a IS NULL THEN 'record-unplanned' END, coalesce(a.kind, '') FROM x
      UNION ALL SELECT 'field-comparison', 'field-mismatch', 'name' FROM x WHERE a IS NOT NULL AND b IS NOT NULL AND a.name IS DISTINCT FROM b.name
      UNION ALL SELECT 'field-comparison', 'field-mismatch', 'target_slot' FROM x WHERE a IS NOT NULL AND b IS NOT NULL AND a.target_slot IS DISTINCT FROM b.target_slot),
    t AS (SELECT text, 1 AS side FROM v_plan_records WHERE kind = 'provisional-block' UNION ALL SELECT text, -1 FROM v_store_records WHERE kind = 'provisional-block'),
    g AS (SELECT 'block-digest-mismatch' AS code, sum(n) AS n FROM (SELECT text, sum(side) AS n FROM t GROUP BY 1 HAVING sum(side) > 0)
      UNION ALL SELECT 'block-count-mismatch', abs(sum(side)) FROM t UNION ALL SELECT 'block-text-length-mismatch', abs(sum(side * length(text))) FROM t)
    SELECT "check", code, field, count(*) AS n FROM f WHERE code IS NOT NULL GROUP BY ALL UNION ALL SELECT 'provisional-blocks', code, '', n::BIGINT FROM g WHERE n <> 0""", "v_plan_outcomes", "v_store_aliases", "v_plan_records", "v_store_records")
def e11_faithfulness(s, d):
    p = plan(s, d)
    return migration.faithfulness(p.outcomes, p.records, view(s, d, "v_store_records"), view(s, d, "v_store_aliases"), ("name", "source_slot", "target_slot"))


TX = ("v_envelopes", "v_writes", "v_transactions", "v_operation_records")
OUTCOME = """f AS (SELECT w.*, o.version AS held, CASE WHEN w.object_authority <> w.authority THEN 'object-authority-mismatch'
      WHEN row_number() OVER (PARTITION BY w.tx, w.object_id ORDER BY w.item) > 1 THEN 'object-already-exists'
      WHEN w.kind = 'create' THEN CASE WHEN o.version IS NOT NULL THEN 'object-already-exists' END WHEN o.version IS NULL THEN 'object-missing' WHEN o.tombstone THEN 'object-already-tombstoned'
      WHEN w.expected_version <> o.version OR w.new_version <> o.version + 1 THEN 'version-conflict' END AS why
      FROM v_writes w LEFT JOIN v_envelopes o ON o.authority = w.authority AND o.object_id = w.object_id),
    p AS (SELECT tx, count(*) AS items, arg_min(why, item) FILTER (why IS NOT NULL) AS why FROM f GROUP BY 1),
    q AS (SELECT t.*, r.generation AS old, CASE WHEN r.fingerprint = t.fingerprint THEN 'replayed' WHEN r.fingerprint IS NOT NULL THEN 'idempotency-conflict'
      WHEN t.expected_generation <> 3 THEN 'generation-conflict' WHEN items IS NULL THEN 'invalid-object' ELSE coalesce(why, 'committed') END AS verdict
      FROM v_transactions t LEFT JOIN p USING (tx) LEFT JOIN v_operation_records r ON r.authority = t.authority AND r.idempotency_key = t.idempotency_key),
    w AS (SELECT authority, min(pos) AS p, arg_min(idempotency_key, pos) AS k, arg_min(fingerprint, pos) AS fp FROM q WHERE verdict = 'committed' GROUP BY 1),
    z AS (SELECT tx, authority, idempotency_key, CASE WHEN p IS NULL OR pos <= p OR old IS NOT NULL THEN verdict WHEN idempotency_key = k THEN CASE WHEN fingerprint = fp THEN 'replayed' ELSE 'idempotency-conflict' END
      WHEN expected_generation = 4 THEN 'deferred' ELSE 'generation-conflict' END AS outcome, CASE WHEN old IS NOT NULL THEN old WHEN pos >= p THEN 4 ELSE 3 END AS generation FROM q LEFT JOIN w USING (authority))"""


def decided(s, d):
    objects, writes, requests, records = (view(s, d, name) for name in TX)
    now = requests.select("authority").distinct().withColumn("generation", F.lit(3))
    return envelopes.transactions(objects, writes, requests, records, now), writes


@query(f"WITH {OUTCOME} SELECT tx, authority, outcome, generation FROM z", *TX)
def k5_transactions(s, d):
    return decided(s, d)[0].select("tx", "authority", "outcome", F.col("generation").cast("int").alias("generation"))


@query(f"WITH {OUTCOME} SELECT 'la_change_' || substr(sha256('transaction:' || tx || ':' || object_id || ':4'), 1, 32) AS change_id, tx, object_id, kind AS operation, CASE WHEN kind = 'update' THEN new_version - 1 END AS base_version, new_version FROM v_writes JOIN z USING (tx) WHERE outcome = 'committed'", *TX)
def k5_changes(s, d):
    return envelopes.changes(*decided(s, d)).drop("authority", "generation")


@query("SELECT authority, object_id, max(version) AS version, arg_max(size, (version, size)) AS size FROM (SELECT authority, ordinal AS object_id, version, size FROM v_objects) GROUP BY ALL", "v_objects")
def k6_compacted(s, d):
    rows = view(s, d, "v_objects").select("authority", F.col("ordinal").alias("object_id"), "version", "size")
    return envelopes.compacted(rows.where("version <= 3"), rows.where("version > 3"))


@query(f"WITH {OUTCOME}, m AS (SELECT tx, object_id FROM v_writes JOIN z USING (tx) WHERE outcome = 'committed'), u AS (SELECT tx, count(*) FILTER (object_id = 'b2') AS unsent FROM m GROUP BY 1) SELECT tx, CASE WHEN idempotency_key LIKE '%7' THEN 'reconciliation-required' ELSE 'recorded' END AS audit, CASE WHEN coalesce(unsent, 0) = 0 THEN 'queued' ELSE 'reconciliation-required' END AS sync_queue FROM z LEFT JOIN u USING (tx) WHERE outcome IN ('committed', 'replayed')", *TX)
def e22_resolution_receipts(s, d):
    outcomes, writes = decided(s, d)
    made = envelopes.changes(outcomes, writes)
    heard = outcomes.where("idempotency_key NOT LIKE '%7'").select("idempotency_key")
    return envelopes.receipts(outcomes, made, heard, made.where("object_id <> 'b2'").select("change_id"))


@query("""WITH RECURSIVE m AS (SELECT old_id, new_id FROM v_alias_rows WHERE disposition = 'mapped'), w AS (SELECT c_custkey AS id, c_custkey AS target, 0 AS h FROM customer UNION ALL SELECT w.id, m.new_id, h + 1 FROM w JOIN m ON m.old_id = w.target WHERE h < 32),
    l AS (SELECT id, arg_max(target, h) AS target FROM w GROUP BY id), e AS (SELECT l.id, l.target FROM l WHERE l.target NOT IN (SELECT old_id FROM v_alias_rows)),
    r AS (SELECT r.pos, r.action, r.old_id, e.target, CASE WHEN action = 'merge' AND r.old_id = r.into THEN 'merge-into-self' WHEN action = 'split' AND candidates < 2 THEN 'split-needs-two-candidates'
      WHEN r.old_id IN (SELECT old_id FROM v_alias_rows) THEN 'alias-already-redirected' WHEN action = 'split' AND missing THEN 'split-candidate-unresolvable' WHEN action = 'merge' AND e.target IS NULL THEN 'merge-target-unresolvable'
      WHEN action = 'merge' AND e.target = r.old_id THEN 'merge-would-create-cycle' ELSE 'accepted' END AS v FROM v_redirect_requests r LEFT JOIN e ON e.id = r.into AND r.action = 'merge')
    SELECT r.pos, r.old_id, CASE WHEN v NOT IN ('merge-into-self', 'split-needs-two-candidates', 'alias-already-redirected') AND EXISTS (FROM r q WHERE q.v = 'accepted' AND q.pos < r.pos AND (q.old_id = r.old_id OR q.old_id = r.target OR q.target = r.old_id)) THEN 'deferred' ELSE v END AS verdict FROM r""".replace("WITH RECURSIVE", "WITH"), "v_alias_rows", "v_redirect_requests")
def g5_redirect_requests(s, d):
    live = view(s, d, "customer").select(F.col("c_custkey").alias("id"))
    return identity.verdicts(view(s, d, "v_alias_rows"), live, view(s, d, "v_redirect_requests")).select("pos", "old_id", "verdict")


SQL["g5_redirect_requests"] = SQL["g5_redirect_requests"].replace("WITH ", "WITH RECURSIVE ", 1)


def chain_sql(group, key, content, table):
    """DuckDB SQL of the faults of damaged chains: each group's rows by key, linked one by one."""
    return f"""WITH RECURSIVE e AS (SELECT {group}, row_number() OVER (PARTITION BY {group} ORDER BY {key}) AS n, {content} AS content, {key} AS id FROM {table}),
    c AS (SELECT {group}, n, content, id, repeat('0', 64) AS previous_hash, sha256(repeat('0', 64) || chr(10) || content) AS event_hash FROM e WHERE n = 1
      UNION ALL SELECT e.{group}, e.n, e.content, e.id, c.event_hash, sha256(c.event_hash || chr(10) || e.content) FROM c JOIN e ON e.{group} = c.{group} AND e.n = c.n + 1),
    x AS (SELECT {group}, n, previous_hash, CASE WHEN id % 97 = 0 THEN content || '!' ELSE content END AS content, CASE WHEN id % 89 = 0 THEN sha256('forged') ELSE event_hash END AS event_hash FROM c WHERE id % 101 <> 0),
    y AS (SELECT *, coalesce(lag(event_hash) OVER w, repeat('0', 64)) AS before, n - coalesce(lag(n) OVER w, 0) AS gap FROM x WINDOW w AS (PARTITION BY {group} ORDER BY n))
    SELECT {group}, n, CASE WHEN gap <> 1 THEN 'gap' WHEN previous_hash <> before THEN 'previous-mismatch' ELSE 'hash-mismatch' END AS fault FROM y WHERE gap <> 1 OR previous_hash <> before OR sha256(previous_hash || chr(10) || content) <> event_hash"""


def damaged_chains(entries, group):
    """Chains of (group, id, content), written by the library, then damaged: contents changed, hashes forged, entries lost."""
    import pandas as pd

    def written(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        out = pd.DataFrame(chain.linked(list(rows.content)), columns=["content", "previous_hash", "event_hash"])
        return out.assign(id=rows.id.values, n=range(1, len(out) + 1), **{group: rows[group].values})

    rows = entries.groupBy(group).applyInPandas(written, f"{group} long, id long, n long, content string, previous_hash string, event_hash string")
    at = F.col("id")
    rows = rows.withColumn("content", F.when(at % 97 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))).withColumn("event_hash", F.when(at % 89 == 0, F.sha2(F.lit("forged"), 256)).otherwise(F.col("event_hash")))
    return rows.where(at % 101 != 0)


@query(chain_sql("o_custkey", "o_orderkey", "CAST(o_orderkey AS STRING) || ':' || o_orderstatus", "orders"))
def w3_hash_chain(s, d):
    entries = view(s, d, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.concat_ws(":", "o_orderkey", "o_orderstatus").alias("content"))
    return chain.faults(damaged_chains(entries, "o_custkey"), "o_custkey")


@query(chain_sql("user_id", "event_id", "CAST(event_id AS STRING) || ':' || event_type", "events"))
def w4_chain_faults(s, d):
    entries = view(s, d, "events").select("user_id", F.col("event_id").alias("id"), F.concat_ws(":", "event_id", "event_type").alias("content"))
    return chain.faults(damaged_chains(entries, "user_id"), "user_id")


@query("SELECT event_id, user_id, event_type FROM events")
def s11_ledger(s, d):
    path = tables.shared_folder(s, "ledger")
    tables.write_lines(view(s, d, "events").select("event_id", "user_id", "event_type"), path)
    return tables.ledger(s, path, "event_id long, user_id long, event_type string")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def k9_recent_activity(s, d):
    path = tables.shared_folder(s, "activity")
    tables.write_lines(view(s, d, "events").select("event_id", "ts", "user_id", "event_type"), path)
    return tables.recent(tables.ledger(s, path, "event_id long, ts timestamp, user_id long, event_type string"), ("ts", "event_id")).drop("ts")


@query("SELECT 'batch_id is not unique' AS rule, count(*) AS n FROM (SELECT user_id FROM events GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'committed_at: unknown status' AS rule, count(*) FROM events WHERE event_type = 'error' UNION ALL SELECT 'operation_id is null', count(*) FROM events WHERE event_type = 'view'".replace("committed_at: ", ""))
def s8_control_table_violations(s, d):
    e, c = view(s, d, "events"), F.col("event_type")
    filled = {x: F.lit("x") for x in tables.required("sync_batches")} | {x: F.lit(1) for x in ("base_generation", "target_generation", "object_count", "change_count", "estimated_batch_bytes", "withheld_plaintext_count")}
    filled |= {"batch_id": F.col("user_id"), "idempotency_key": F.col("event_id"), "operation_id": F.when(c != "view", "op"), "status": F.when(c == "error", "lost").otherwise("committed")}
    return tables.violations(e.select(*(v.alias(k) for k, v in filled.items())), "sync_batches")


@query("SELECT entity_id, record_key FROM (SELECT 'e' || CAST(max(o_orderkey) AS STRING) AS entity_id, CAST(o_custkey AS STRING) AS record_key FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)")
def s12_migration_index(s, d):
    o = view(s, d, "orders").withColumn("client_id", F.when(F.col("o_orderstatus") == "F", "migration").otherwise("other")).withColumn("seq", F.col("o_orderkey"))
    entities = o.select("client_id", "seq", F.concat(F.lit("e"), "o_orderkey").alias("entity_id"), F.col("o_custkey").cast("string").alias("basis"))
    receipts = o.select("client_id", "seq", F.col("o_custkey").alias("idempotency_key"), F.array("o_orderkey").alias("assertion_ids"))
    aliases = o.select("seq", F.col("o_orderkey").alias("old_id"), F.lit("mapped").alias("disposition"))
    return tables.migration_index(entities, receipts, aliases, "migration")[0]


@query("SELECT o.object_ref, o.version, o.size, o.key_ref, o.authority, o.ordinal, o.generation, (SELECT max(generation) FROM v_batches WHERE status = 'committed' AND generation > 7 AND generation <= 19) AS cursor, true AS has_more FROM v_objects o JOIN v_batches b USING (generation) WHERE status = 'committed' AND generation > 7 AND generation <= 19".replace("AND generation <= 19", "AND generation <= (SELECT max(g) FROM (SELECT generation AS g FROM v_batches WHERE status = 'committed' AND generation > 7 ORDER BY 1 LIMIT 10))"), "v_objects", "v_batches")
def s14_pull_pages(s, d):
    return tables.pull_pages(view(s, d, "v_objects"), view(s, d, "v_batches"), 7, 10).drop("tombstone", "payload")


@query("SELECT v AS n, greatest(1, least(coalesce(v, 100), 1000)) AS size FROM (SELECT CASE WHEN o_orderkey % 10 <> 3 THEN o_orderkey - 5 END AS v FROM orders)")
def l9_bounded_limit(s, d):
    n = F.when(F.col("o_orderkey") % 10 != 3, F.col("o_orderkey") - 5)
    return view(s, d, "orders").select(n.alias("n"), tables.bounded_limit(n).cast("long").alias("size"))
