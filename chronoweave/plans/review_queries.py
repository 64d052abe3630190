"""Queries of the review operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.operators import envelopes, migration, review
from chronoweave.plans.queries import query
from chronoweave.plans.store_queries import PLAN, TX, plan
from chronoweave.plans.views import view

ITEMS = ("v_review_items", "v_review_proposals", "v_review_parity", "v_review_units")
MODES = """ob AS (SELECT DISTINCT review_id, object_id FROM v_review_proposals WHERE found AND kind = 'observation'),
    pa AS (SELECT DISTINCT review_id, object_id FROM v_review_parity WHERE object_id IS NOT NULL), un AS (SELECT DISTINCT review_id, observation_id AS object_id FROM v_review_units WHERE observation_id IS NOT NULL),
    bad AS (SELECT review_id FROM ((FROM ob EXCEPT FROM pa) UNION ALL (FROM pa EXCEPT FROM ob)) GROUP BY 1), una AS (SELECT review_id FROM ((FROM ob UNION FROM pa) EXCEPT FROM un) GROUP BY 1),
    pr AS (SELECT review_id, count(*) AS proposed, count(*) FILTER (found) AS n_found FROM v_review_proposals GROUP BY 1), no AS (SELECT review_id, count(*) AS n_obs FROM ob GROUP BY 1),
    sh AS (SELECT review_id, bool_and(coverage = 'represented' AND representation = 'observation' AND object_id IS NOT NULL) AS shaped FROM v_review_parity GROUP BY 1),
    ue AS (SELECT review_id, unit, bool_or(has_evidence) AS e, count(observation_id) > 0 AS m FROM v_review_units GROUP BY 1, 2),
    us AS (SELECT review_id, count(*) AS mapped, bool_or(e) AS any_e, bool_and(e AND m) AS ok FROM ue GROUP BY 1),
    md AS (SELECT i.*, CASE WHEN NOT exact_preserved THEN 'exact-source-unavailable' WHEN coalesce(proposed, 0) <> coalesce(n_found, 0) THEN 'destination-unavailable' WHEN missing_references > 0 THEN 'reference-unavailable'
      WHEN shaped IS NOT true OR i.review_id IN (SELECT review_id FROM bad) OR n_obs IS NULL THEN 'coverage-mismatch' WHEN unmapped > 0 THEN 'destination-unmapped'
      WHEN any_e THEN CASE WHEN mapped <> units OR NOT ok THEN 'fragment-incomplete' WHEN i.review_id IN (SELECT review_id FROM una) THEN 'coverage-not-accounted' ELSE 'rich' END
      WHEN n_found = 1 AND n_obs = 1 THEN 'legacy' ELSE 'unsupported-mapping' END AS reason
      FROM v_review_items i LEFT JOIN pr USING (review_id) LEFT JOIN no USING (review_id) LEFT JOIN sh USING (review_id) LEFT JOIN us USING (review_id)),
    mo AS (SELECT *, CASE WHEN reason IN ('rich', 'legacy') THEN reason ELSE 'incomplete' END AS mode FROM md)"""


def judged(s, d):
    items, *rest = (view(s, d, name) for name in ITEMS)
    return items.join(review.resolution_modes(items, *rest), "review_id")


@query(f"WITH {MODES} SELECT review_id, mode, reason FROM mo", *ITEMS)
def e12_review_mode(s, d):
    return judged(s, d).select("review_id", "mode", "reason")


@query(f"WITH {MODES} SELECT review_id, CASE review_id % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'research' ELSE 'deferred-unknown' END AS state, CASE WHEN review_id % 3 = 1 THEN 'research' ELSE 'owner-review' END AS recommendation, version + 1 AS version FROM mo WHERE mode <> 'incomplete'", *ITEMS)
def e13_review_decisions(s, d):
    k = F.col("review_id") % 3
    return review.decisions(judged(s, d), F.when(k == 0, "keep").when(k == 1, "research").otherwise("defer"))


@query(f"WITH {MODES} SELECT review_id, CASE WHEN mode = 'rich' THEN 'auto' ELSE 'manual' END AS route, CASE WHEN mode = 'rich' THEN sha256(review_id || chr(10) || version || chr(10) || mode) END AS fingerprint FROM mo WHERE state NOT IN ('auto-applied', 'resolved')", *ITEMS)
def e14_auto_apply(s, d):
    return review.exact_preservation(judged(s, d))


@query("SELECT user_id AS proposal, CASE min(CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 1 ELSE 2 END) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence, count(*) AS results FROM events GROUP BY 1")
def e15_lowest_confidence(s, d):
    t = F.col("event_type")
    return review.lowest_confidence(view(s, d, "events").select(F.col("user_id").alias("proposal"), F.when(t == "error", "low").when(t == "view", "medium").otherwise("high").alias("confidence")))


@query("SELECT * FROM (VALUES ('connector-coverage', 'gap'), ('topic-review', 'missing')) t(component, verdict) UNION ALL SELECT CASE generation % 5 WHEN 0 THEN 'semantic' WHEN 1 THEN 'topic-import' ELSE 'enrichment' END, CASE WHEN bool_or(status <> 'committed') THEN 'failed' WHEN max(object_count) > 130000 THEN 'synced' ELSE 'ready' END FROM v_batches GROUP BY 1", "v_batches")
def e16_readiness(s, d):
    k = F.col("generation") % 5
    name = F.when(k == 0, "semantic").when(k == 1, "topic-import").otherwise("enrichment")
    parts = view(s, d, "v_batches").groupBy(name.alias("component")).agg(F.bool_and(F.col("status") == "committed").alias("complete"), (F.max("object_count") > 130000).alias("synced"))
    return review.readiness(parts, ("semantic", "topic-import", "enrichment", "connector-coverage"), ("topic-review",))


@query("SELECT 'customer' AS kind, count(*) AS dead FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 11 <> 0) UNION ALL SELECT 'label', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 13 <> 0)")
def j32_mutation_set(s, d):
    named = lambda kind, rows, key: rows.select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
    refs = named("customer", view(s, d, "orders"), "o_custkey").union(named("label", view(s, d, "labels"), "doc_id"))
    live = named("customer", view(s, d, "customer").where("c_custkey % 11 <> 0"), "c_custkey").union(named("label", view(s, d, "documents").where("doc_id % 13 <> 0"), "doc_id"))
    return review.dead_references(refs, live)


@query("SELECT 'nation' AS kind, count(*) AS dead FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 7 <> 0) UNION ALL SELECT 'part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) UNION ALL SELECT 'customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def j18_reference_integrity(s, d):
    named = lambda kind, rows, key: rows.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"))
    t = lambda name: view(s, d, name)
    refs = named("nation", t("customer"), "c_nationkey").union(named("part", t("lineitem"), "l_partkey")).union(named("customer", t("orders"), "o_custkey"))
    live = named("nation", t("nation").where("n_nationkey % 7 <> 0"), "n_nationkey").union(named("part", t("part").where("p_size > 5"), "p_partkey")).union(named("customer", t("customer"), "c_custkey"))
    return review.dead_references(refs, live)


@query("WITH r AS (SELECT subject AS commit_id, seq, superseded_by + 0 AS supersedes FROM v_assertions) SELECT commit_id, min(supersedes) AS \"unknown\" FROM r WHERE supersedes IS NOT NULL AND supersedes NOT IN (SELECT seq FROM v_assertions WHERE lineage_action <> 'retract') AND NOT EXISTS (FROM r q WHERE q.seq % 2 = 0 AND q.commit_id = r.commit_id AND q.seq = r.supersedes) GROUP BY 1", "v_assertions")
def j5_supersedes_validity(s, d):
    log = view(s, d, "v_assertions")
    rows = log.select(F.col("subject").alias("commit_id"), F.when(F.col("seq") % 2 == 0, F.col("seq")).alias("assertion_id"), F.col("superseded_by").alias("supersedes"))
    return review.aborted_commits(rows, log.where("lineage_action <> 'retract'").select(F.col("seq").alias("assertion_id")))


@query("SELECT e.seq, e.predicate, a.type AS src_type, b.type AS dst_type, CASE WHEN a.type IS NULL AND b.type IS NULL THEN 'both-endpoints-missing' WHEN a.type IS NULL THEN 'source-missing' WHEN b.type IS NULL THEN 'target-missing' END AS refusal FROM v_edges e LEFT JOIN v_entities a ON a.entity_id = e.src LEFT JOIN v_entities b ON b.entity_id = e.dst", "v_edges", "v_entities")
def j9_endpoint_typing(s, d):
    return review.typed_edges(view(s, d, "v_edges"), view(s, d, "v_entities"))


@query("""SELECT DISTINCT 'object-missing' AS fault, doc_id AS key FROM documents WHERE doc_id % 4 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT DISTINCT 'review-not-covered', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 4 = 0) UNION ALL SELECT DISTINCT 'review-without-observation', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def j17_unrepresented(s, d):
    labels, docs = view(s, d, "labels"), view(s, d, "documents")
    parity = docs.select(F.col("doc_id").alias("key"), F.when(F.col("doc_id") % 4 == 0, "needs-review").otherwise("represented").alias("coverage"), F.col("doc_id").alias("object_id"))
    objects = labels.select(F.col("doc_id").alias("object_id"), F.when(F.col("quality") == 1, "observation").otherwise("fact").alias("kind"))
    return review.parity_faults(parity, objects, labels.select(F.col("doc_id").alias("key"), F.col("doc_id").alias("object_id")))


@query("WITH r AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), g AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0), b AS (SELECT r.k AS a, n, g.k AS b FROM r FULL JOIN g ON r.k = g.k) SELECT 'matched' AS state, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n FROM b UNION ALL SELECT 'unknown', count(*) FILTER (b IS NULL) FROM b UNION ALL SELECT 'duplicate', sum(n - 1)::BIGINT FROM b UNION ALL SELECT 'unresolved', count(*) FILTER (a IS NULL) FROM b")
def j31_resolutions_vs_groups(s, d):
    return review.resolution_states(view(s, d, "orders").select(F.col("o_custkey").alias("key")), view(s, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key")))


@query("SELECT count(*) AS sources, count(*) FILTER (disposition = 'projected') AS projected, count(*) FILTER (disposition = 'refused') AS refused, count(*) FILTER (disposition = 'refused' AND reason IS NOT NULL) AS reasons, count(category) AS categories, count(disposition) AS dispositions FROM v_plan_outcomes", "v_plan_outcomes")
def a28_closure_arithmetic(s, d):
    return migration.tally(plan(s, d))


@query("""WITH k AS (SELECT record_key, count(*) AS made, count(*) FILTER (from_legacy) AS legacy FROM v_plan_records GROUP BY 1), c AS (SELECT record_key, count(*) AS claims FROM v_plan_claims GROUP BY 1),
    f AS (SELECT 'duplicate-idempotency-key' AS code, record_key AS subject, made - 1 AS n FROM k WHERE made > 1 UNION ALL SELECT 'record-not-accounted', record_key, claims - 1 FROM c WHERE claims > 1 UNION ALL SELECT 'record-not-accounted', record_key, claims FROM c WHERE record_key NOT IN (SELECT record_key FROM k)
    UNION ALL SELECT 'record-not-accounted', record_key, legacy FROM k WHERE legacy > 0 AND record_key NOT IN (SELECT record_key FROM c) UNION ALL SELECT 'record-not-accounted', record_key, made - legacy FROM k JOIN c USING (record_key) WHERE made > legacy
    UNION ALL SELECT 'retraction-target-missing', record_key, count(*) FROM v_plan_records WHERE kind = 'retraction' AND retracts NOT IN (SELECT record_key FROM k) GROUP BY record_key) SELECT code, subject, sum(n)::BIGINT AS n FROM f GROUP BY 1, 2""", *PLAN)
def a29_record_accounting(s, d):
    return migration.accounting_faults(plan(s, d)).groupBy("code", "subject").agg(F.sum("n").alias("n"))


@query("""SELECT w.tx, w.item, CASE WHEN w.object_authority <> w.authority THEN 'object-authority-mismatch' WHEN count(*) OVER (PARTITION BY w.tx, w.object_id ORDER BY w.item) > 1 THEN 'object-already-exists'
    WHEN w.kind = 'create' AND o.version IS NOT NULL THEN 'object-already-exists' WHEN w.kind = 'create' THEN NULL WHEN o.version IS NULL THEN 'object-missing' WHEN o.tombstone THEN 'object-already-tombstoned'
    WHEN coalesce(w.expected_version, o.version) <> o.version OR w.new_version - 1 <> o.version THEN 'version-conflict' END AS reason FROM v_writes w LEFT JOIN v_envelopes o USING (authority, object_id)""", "v_envelopes", "v_writes")
def k4_versioned_mutations(s, d):
    return envelopes.write_faults(*(view(s, d, name) for name in TX[:2])).select("tx", "item", "reason")
