"""Graph-shaped views of the star-schema tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    # one assertion an order; the customer's next order of the same status supersedes it
    "v_assertions": """
        SELECT seq, 'as' || CAST(seq AS STRING) AS assertion_id,
               CASE WHEN seq % 3 = 0 THEN 'relationship' ELSE 'fact' END AS kind,
               CASE seq % 8 WHEN 1 THEN 'correct' WHEN 3 THEN 'retract' WHEN 5 THEN 'invalidate' WHEN 6 THEN 'reinstate' ELSE 'assert' END AS lineage_action,
               subject, predicate, CASE WHEN seq % 3 = 0 THEN seq % 97 END AS target, value, day AS recorded_at,
               lead(day) OVER w AS superseded_at, lead(seq) OVER w AS superseded_by,
               CASE WHEN seq % 7 = 6 THEN NULL WHEN seq % 4 = 3 THEN 'unknown' WHEN seq % 5 = 0 THEN 'approximate' ELSE 'exact' END AS from_kind,
               CASE WHEN seq % 7 = 6 THEN NULL ELSE CASE seq % 4 WHEN 0 THEN substr(day, 1, 4) WHEN 1 THEN substr(day, 1, 7) WHEN 2 THEN day END END AS from_value,
               CASE seq % 6 WHEN 0 THEN 'exact' WHEN 1 THEN 'approximate' END AS to_kind,
               CASE WHEN seq % 6 <= 1 THEN CAST(CAST(substr(day, 1, 4) AS INT) + 2 AS STRING) END AS to_value,
               'client' || CAST(seq % 4 AS STRING) AS client_id,
               CASE seq % 10 WHEN 0 THEN 'sealed' WHEN 1 THEN 'restricted' ELSE 'open' END AS tier,
               CASE seq % 10 WHEN 0 THEN 90 WHEN 1 THEN 50 ELSE 10 END AS tier_rank, seq % 10 = 0 AS withheld
        FROM (SELECT o_orderkey AS seq, o_custkey AS subject, o_orderpriority AS value, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day,
                     CASE o_orderstatus WHEN 'F' THEN 'worked-at' WHEN 'O' THEN 'job-title' ELSE 'attended' END AS predicate FROM orders) o
        WINDOW w AS (PARTITION BY subject, predicate ORDER BY day, seq)""",
    "v_entities": """
        SELECT 'c' || CAST(c_custkey AS STRING) AS entity_id, 'person' AS type, c_name AS display_name, lower(c_mktsegment) AS alias FROM customer
        UNION ALL SELECT 's' || CAST(s_suppkey AS STRING), 'organization', s_name, 'nation ' || CAST(s_nationkey AS STRING) FROM supplier
        UNION ALL SELECT 'p' || CAST(p_partkey AS STRING), 'item', p_name, lower(p_brand) FROM part""",
    # customer -> nation -> region, and customer -> supplier's nation through the order's number
    "v_edges": """
        SELECT c_custkey AS seq, 'c' || CAST(c_custkey AS STRING) AS src, 'based-in' AS predicate, 'n' || CAST(c_nationkey AS STRING) AS dst,
               CASE c_custkey % 8 WHEN 3 THEN 'retract' WHEN 5 THEN 'invalidate' ELSE 'assert' END AS lineage_action FROM customer
        UNION ALL SELECT 1000000000 + n_nationkey, 'n' || CAST(n_nationkey AS STRING), 'contained-in', 'r' || CAST(n_regionkey AS STRING), 'assert' FROM nation
        UNION ALL SELECT 2000000000 + s_suppkey, 's' || CAST(s_suppkey AS STRING), 'based-in', 'n' || CAST(s_nationkey AS STRING), 'assert' FROM supplier""",
    # redirects k -> k / 2 for multiples of 7, and a few of the other dispositions
    "v_alias_rows": """
        SELECT c_custkey AS old_id, CASE WHEN c_custkey % 7 = 0 AND c_custkey > 0 THEN CAST(floor(c_custkey / 2) AS BIGINT) END AS new_id,
               CASE WHEN c_custkey % 7 = 0 AND c_custkey > 0 THEN 'mapped' WHEN c_custkey % 7 = 3 THEN 'ambiguous-split'
                    WHEN c_custkey % 7 = 5 THEN 'terminal' END AS disposition
        FROM customer WHERE c_custkey > 0 AND c_custkey % 7 IN (0, 3, 5)""",
    # the event stream as audit, activity and operational records
    "v_replay": """
        SELECT 'ev' || CAST(event_id AS STRING) AS source_event_id, 'op' || CAST(user_id AS STRING) || '-' || substr(CAST(ts AS STRING), 1, 10) AS operation_id,
               substr(CAST(ts AS STRING), 1, 19) AS recorded_at,
               CASE WHEN event_type IN ('signup', 'purchase') THEN 'audit' WHEN event_type IN ('click', 'view') THEN 'activity' ELSE 'operational' END AS stream,
               CASE WHEN event_id % 2 = 0 THEN 'remote' ELSE 'local' END AS plane, event_type AS action,
               CASE WHEN event_type <> 'error' THEN 'k' || CAST(event_id % 100 AS STRING) END AS touched,
               event_type IN ('signup', 'view') AND event_id % 5 = 0 AS contains_sensitive, event_type = 'error' OR event_id % 3 = 0 AS redacted,
               CASE WHEN event_type = 'purchase' AND event_id % 11 = 0 THEN 'deny' WHEN event_type IN ('click', 'view') THEN 'allow' END AS policy_decision,
               CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 4 = 0 THEN 'server-error' ELSE 'ok' END END AS outcome,
               CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 10 = 0 THEN 'error' ELSE 'info' END END AS severity
        FROM events""",
    "v_requests": """
        SELECT event_id AS request_id, ts, user_id, 'user' || CAST(user_id AS STRING) AS client_id, '/' || event_type || '/' || CAST(event_id % 40 AS STRING) AS route,
               CASE event_id % 10 WHEN 0 THEN 500 WHEN 1 THEN 404 WHEN 2 THEN 403 ELSE 200 END AS status, value AS duration_ms, event_type FROM events""",
    # daily sync batches of ten authorities
    "v_objects": """
        SELECT 'o' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS object_ref, l_suppkey AS authority, l_orderkey AS ordinal,
               l_linenumber AS version, l_orderkey % 50 AS generation, CASE l_linestatus WHEN 'F' THEN 1 ELSE 0 END AS tombstone, CAST(l_quantity AS BIGINT) AS size,
               'key' || CAST(l_partkey % 9 AS STRING) AS key_ref, CASE l_returnflag WHEN 'A' THEN 'plaintext' WHEN 'N' THEN 'inline' ELSE 'ciphertext' END AS payload FROM lineitem""",
    "v_batches": """
        SELECT generation, CASE WHEN generation % 6 = 5 THEN 'staged' ELSE 'committed' END AS status, count(*) AS object_count, sum(size) AS bytes
        FROM v_objects GROUP BY generation""",
    "v_markdown": """
        SELECT 'doc/' || CAST(doc_id AS STRING) AS path, '# Title ' || CAST(doc_id AS STRING) || chr(10) || 'type:: note' || chr(10) || '- see [[Page ' || CAST(doc_id % 50 AS STRING)
               || '|alias]] and [[Other ' || CAST(doc_id % 7 AS STRING) || ']] #tag' || CAST(doc_id % 5 AS STRING) || ' ((ref-' || CAST(doc_id % 13 AS STRING) || '))' || chr(10)
               || '  - [link](http://x.example/' || CAST(doc_id AS STRING) || ') ' || coalesce(text, '') AS markdown FROM documents""",
    # a migration plan: an outcome for each order, a record for each line
    "v_plan_outcomes": """
        SELECT 'o' || CAST(o_orderkey AS STRING) AS legacy_id, CASE WHEN o_orderkey % 401 = 0 THEN 'other' WHEN o_orderstatus = 'F' THEN 'entity' ELSE 'relationship' END AS category,
               CASE WHEN o_orderkey % 307 = 0 THEN 'other' WHEN o_orderkey % 11 = 0 THEN 'refused' ELSE 'projected' END AS disposition,
               CASE WHEN o_orderkey % 11 = 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'other' WHEN 1 THEN 'unclassified-source-category' ELSE 'quarantined' END END AS reason,
               CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'terminal' ELSE 'record' END AS alias_kind FROM orders""",
    "v_plan_records": """
        SELECT 'k' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS record_key,
               CASE l_linenumber WHEN 1 THEN 'entity' WHEN 2 THEN 'minted-entity' WHEN 5 THEN 'minted-relationship' WHEN 6 THEN 'retraction' WHEN 7 THEN 'provisional-block' ELSE 'relationship' END AS kind,
               CASE WHEN l_linenumber <= 2 THEN 's' || CAST(l_partkey AS STRING) END AS slot,
               CASE WHEN l_linenumber IN (3, 4, 5) THEN 's' || CAST(l_partkey AS STRING) END AS source_slot,
               CASE WHEN l_linenumber IN (3, 4, 5) THEN 's' || CAST(l_partkey + 3 AS STRING) END AS target_slot,
               CASE WHEN l_linenumber = 6 THEN 'k' || CAST(l_orderkey AS STRING) || '-1' END AS retracts, l_linenumber NOT IN (2, 5) AS from_legacy,
               CASE WHEN l_linenumber <= 2 AND l_suppkey % 3 = 0 THEN CASE l_suppkey % 4 WHEN 0 THEN 'role' WHEN 1 THEN 'kind' WHEN 2 THEN 'subject' ELSE 'other' END END AS scheme,
               CASE WHEN l_linenumber <= 2 AND l_partkey % 61 <> 0 THEN 'Word  ' || CAST(l_partkey % 900 AS STRING) END AS name,
               CASE WHEN l_linenumber = 2 THEN 'minted-from-subtype' ELSE 'projected-from-corpus' END AS mechanism,
               CASE WHEN l_linenumber = 7 THEN 'block ' || CAST(l_partkey AS STRING) END AS text FROM lineitem""",
    "v_plan_claims": """
        SELECT 'o' || CAST(l_orderkey AS STRING) AS legacy_id, 'k' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS record_key FROM lineitem
        WHERE (l_linenumber NOT IN (2, 5) AND l_orderkey % 89 <> 0) OR (l_linenumber = 2 AND l_orderkey % 101 = 0)
        UNION ALL SELECT 'o' || CAST(o_orderkey AS STRING), 'k' || CAST(o_orderkey AS STRING) || '-9' FROM orders WHERE o_orderkey % 211 = 0""",
    "v_plan_aliases": """
        SELECT 'o' || CAST(o_orderkey AS STRING) AS legacy_id, 'k' || CAST(o_orderkey AS STRING) || '-1' AS record_key FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 97 <> 0""",
    # what the store holds of that plan after a run that lost and changed some of it
    "v_store_records": """
        SELECT CASE WHEN l_orderkey % 67 = 1 THEN record_key || 'x' ELSE record_key END AS record_key, kind, source_slot, target_slot,
               CASE WHEN l_orderkey % 71 = 0 THEN 'renamed' ELSE name END AS name, CASE WHEN l_orderkey % 59 = 0 THEN text || '?' ELSE text END AS text
        FROM (SELECT *, CAST(substr(record_key, 2, length(record_key) - 3) AS BIGINT) AS l_orderkey FROM v_plan_records) r WHERE l_orderkey % 73 <> 0""",
    "v_store_aliases": """
        SELECT legacy_id, CASE WHEN alias_kind = 'terminal' OR n % 103 = 0 THEN 'terminal' ELSE 'mapped' END AS disposition
        FROM (SELECT *, CAST(substr(legacy_id, 2) AS BIGINT) AS n FROM v_plan_outcomes) o WHERE alias_kind IS NOT NULL AND n % 83 <> 0""",
    # five objects of each customer's store; orders are transactions on it, with their lines as writes
    "v_envelopes": """
        SELECT c_custkey AS authority, 'b' || CAST(k AS STRING) AS object_id, 1 + (c_custkey + k) % 3 AS version, (c_custkey + k) % 7 = 0 AS tombstone
        FROM customer CROSS JOIN (SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS k FROM nation WHERE n_nationkey < 5) n WHERE (c_custkey + k) % 3 <> 0""",
    "v_writes": """
        SELECT o_orderkey AS tx, o_custkey AS authority, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS BIGINT) AS item,
               CASE WHEN (o_custkey + l_partkey % 5) % 3 = 0 THEN CASE WHEN l_suppkey % 5 = 0 THEN 'update' ELSE 'create' END ELSE CASE WHEN l_suppkey % 7 = 0 THEN 'create' ELSE 'update' END END AS kind,
               'b' || CAST(l_partkey % 5 AS STRING) AS object_id, CASE WHEN l_suppkey % 23 = 0 THEN o_custkey + 1 ELSE o_custkey END AS object_authority,
               CASE WHEN l_suppkey % 2 = 0 THEN 1 + (o_custkey + l_partkey % 5) % 3 END AS expected_version, CASE WHEN l_suppkey % 11 = 0 THEN 9 ELSE 2 + (o_custkey + l_partkey % 5) % 3 END AS new_version
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey""",
    "v_transactions": """
        SELECT o_orderkey AS tx, o_custkey AS authority, o_orderkey AS pos, 'i' || CAST(CAST(floor(o_orderkey / 2) AS BIGINT) AS STRING) AS idempotency_key, o_orderpriority AS fingerprint,
               CASE WHEN o_orderkey % 9 = 8 THEN 4 WHEN o_orderkey % 13 = 12 THEN 2 ELSE 3 END AS expected_generation FROM orders""",
    "v_operation_records": """
        SELECT o_custkey AS authority, 'i' || CAST(CAST(floor(o_orderkey / 2) AS BIGINT) AS STRING) AS idempotency_key, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority ELSE 'changed' END AS fingerprint, 1 AS generation
        FROM orders WHERE o_orderkey % 10 = 4""",
    "v_redirect_requests": """
        SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 5 = 0 THEN 'split' WHEN o_orderkey % 7 = 0 THEN 'disposition' ELSE 'merge' END AS action, o_custkey AS old_id,
               CASE WHEN o_orderkey % 19 = 0 THEN o_custkey ELSE (o_custkey * 3 + o_orderkey) % 2000 END AS into, o_orderkey % 4 AS candidates, o_orderkey % 6 = 1 AS missing FROM orders""",
    # orders under review, with their lines as proposals
    "v_review_items": """
        SELECT o_orderkey AS review_id, CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'owner-review' ELSE 'research' END AS state, o_orderkey % 29 <> 0 AS exact_preserved,
               CASE WHEN o_orderkey % 31 = 0 THEN 1 ELSE 0 END AS missing_references, CASE WHEN o_orderkey % 37 = 0 THEN 1 ELSE 0 END AS unmapped, 1 + o_orderkey % 3 AS version, 1 + o_orderkey % 2 AS units FROM orders""",
    "v_review_proposals": """
        SELECT l_orderkey AS review_id, 'k' || CAST(l_partkey AS STRING) AS object_id, CASE WHEN l_suppkey % 19 = 0 THEN 'fact' ELSE 'observation' END AS kind, l_suppkey % 41 <> 0 AS found FROM lineitem""",
    "v_review_parity": """
        SELECT l_orderkey AS review_id, CASE WHEN l_suppkey % 43 = 0 THEN 'needs-review' ELSE 'represented' END AS coverage, 'observation' AS representation, 'k' || CAST(l_partkey AS STRING) AS object_id
        FROM lineitem WHERE l_suppkey % 19 <> 0""",
    "v_review_units": """
        SELECT l_orderkey AS review_id, l_orderkey % 2 * (l_partkey % 2) AS unit, l_orderkey % 5 <> 2 AS has_evidence, CASE WHEN l_suppkey % 19 <> 0 AND l_suppkey % 17 <> 0 THEN 'k' || CAST(l_partkey AS STRING) END AS observation_id
        FROM lineitem""",
}
NEEDS = {"v_batches": ("v_objects",), "v_store_records": ("v_plan_records",), "v_store_aliases": ("v_plan_outcomes",)}


def chain(*names: str) -> list[str]:
    """The views and what they are built from, in order."""
    out: list[str] = []
    for name in names:
        for x in (*NEEDS.get(name, ()), name):
            if x not in out:
                out.append(x)
    return out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a view over them."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    body = " ".join(VIEWS[x] for x in chain(name))
    tables = [f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in TABLES if t in body]
    return spark.sql("WITH " + ", ".join([*tables, *(f"{x} AS ({VIEWS[x]})" for x in chain(name))]) + f" SELECT * FROM {name}")


def duck(sql: str, *names: str) -> str:
    """``sql`` (from its SELECT on, or after its own WITH parts) over the views, for DuckDB."""
    parts = ", ".join(f"{x} AS ({VIEWS[x]})" for x in chain(*names))
    return f"WITH {parts}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {parts} {sql}"
