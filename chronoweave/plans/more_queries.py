"""Further queries: rollups, reconciliation joins, ETL projections and text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoweave.functions import digest, markup
from chronoweave.operators import graph, rules, search, sync
from chronoweave.plans.queries import log, query
from chronoweave.plans.views import view


@query("SELECT seq FROM (SELECT seq, row_number() OVER (PARTITION BY subject ORDER BY seq) - 1 AS r FROM v_assertions) WHERE r % 3 = 0", "v_assertions")
def f26_step_sample(s, d):
    r = F.row_number().over(Window.partitionBy("subject").orderBy("seq")) - 1
    return log(s, d).withColumn("r", r).where("r % 3 = 0").select("seq")


@query("SELECT entity_id, display_name FROM v_entities WHERE type = 'organization' AND entity_id = 's7'", "v_entities")
def f29_entity_get(s, d):
    return view(s, d, "v_entities").where("type = 'organization' AND entity_id = 's7'").select("entity_id", "display_name")


@query("SELECT generation, object_count FROM v_batches WHERE (generation, status) > (20, 'a') ORDER BY generation, status LIMIT 20", "v_batches")
def f20_ledger_cursor(s, d):
    b = view(s, d, "v_batches").where("generation > 20 OR (generation = 20 AND status > 'a')")
    return b.orderBy("generation", "status").limit(20).select("generation", "object_count")


@query("SELECT count(*) AS objects, count(*) FILTER (payload = 'inline') AS capsules FROM v_objects", "v_objects")
def f28_sync_scope(s, d):
    return view(s, d, "v_objects").agg(F.count("*").alias("objects"), F.count_if(F.col("payload") == "inline").alias("capsules"))


@query("SELECT object_ref, CASE WHEN payload = 'plaintext' THEN -1 ELSE size END AS size, payload = 'plaintext' AS withheld FROM v_objects", "v_objects")
def p6_sanitized_objects(s, d):
    plain = F.col("payload") == "plaintext"
    return view(s, d, "v_objects").select("object_ref", F.when(~plain, F.col("size")).otherwise(-1).alias("size"), plain.alias("withheld"))


@query("SELECT source_event_id, 'sha256:' || sha256(action) AS summary_hash, CASE WHEN stream = 'audit' AND policy_decision = 'deny' THEN 'denied' WHEN stream = 'audit' THEN 'write' WHEN stream = 'activity' THEN 'read' ELSE 'system' END AS public_action FROM v_replay", "v_replay")
def p9_public_activity(s, d):
    kind = rules.first_match([((F.col("stream") == "audit") & (F.coalesce("policy_decision", F.lit("")) == "deny"), "denied"), (F.col("stream") == "audit", "write"), (F.col("stream") == "activity", "read")], "system")
    return view(s, d, "v_replay").select("source_event_id", F.concat(F.lit("sha256:"), F.sha2("action", 256)).alias("summary_hash"), kind.alias("public_action"))


@query("SELECT seq, from_value AS start, from_kind = 'approximate' AS approximate FROM v_assertions WHERE from_kind IN ('exact', 'approximate')", "v_assertions")
def p12_plain_interval(s, d):
    return log(s, d).where("from_kind IN ('exact', 'approximate')").select("seq", F.col("from_value").alias("start"), (F.col("from_kind") == "approximate").alias("approximate"))


@query("SELECT seq, CASE WHEN from_kind IS NULL THEN NULL WHEN from_kind = 'unknown' THEN 'unknown' WHEN from_kind = 'approximate' THEN '~' || from_value ELSE from_value END AS mixed FROM v_assertions", "v_assertions")
def p17_mixed_dates(s, d):
    kind = F.col("from_kind")
    return log(s, d).select("seq", F.when(kind == "unknown", "unknown").when(kind == "approximate", F.concat(F.lit("~"), "from_value")).when(kind == "exact", F.col("from_value")).alias("mixed"))


@query("SELECT doc_id, CASE WHEN n_chars > 20000 THEN 'quarantine' WHEN contains(text, '|') THEN 'opaque' WHEN contains(text, '@') THEN 'entity' WHEN n_chars < 100 THEN 'block' ELSE 'narrative' END AS category FROM documents")
def p18_record_classes(s, d):
    t, n = F.col("text"), F.col("n_chars")
    return view(s, d, "documents").select("doc_id", rules.first_match([(n > 20000, "quarantine"), (F.contains(t, F.lit("|")), "opaque"), (F.contains(t, F.lit("@")), "entity"), (n < 100, "block")], "narrative").alias("category"))


@query("SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'item' WHEN 'PROMO' THEN 'offering' ELSE 'hand-review' END AS mapped FROM part")
def p19_node_mapping(s, d):
    table = s.createDataFrame([("ECONOMY", "item"), ("PROMO", "offering")], "p_type string, mapped string")
    return view(s, d, "part").join(F.broadcast(table), "p_type", "left").select("p_partkey", F.coalesce("mapped", F.lit("hand-review")).alias("mapped"))


@query("SELECT doc_id, source AS plain FROM documents")
def p26_encrypt_round_trip(s, d):
    key, aad = F.lit("0123456789abcdef"), F.lit("aad")
    sealed = F.aes_encrypt("source", key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), aad)
    return view(s, d, "documents").select("doc_id", F.aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), aad).cast("string").alias("plain"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{\"k\":\"[redacted]\",\"z\":{\"a\":1}}' ELSE '{\"z\":{\"a\":1}}' END AS masked FROM events")
def p28_recursive_redaction(s, d):
    mask = digest.redact_json("k")
    source = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"z": {"a": 1.0}, "k": '), F.get_json_object("props", "$.k"), F.lit("}"))).otherwise('{"z": {"a": 1}}')
    return view(s, d, "events").select("event_id", mask(source).alias("masked"))


@query("SELECT event_id, 'sha256:' || sha256('{\"a\":' || event_id::VARCHAR || ',\"b\":null}') AS digest FROM events")
def p25_claim_digest(s, d):
    source = F.concat(F.lit('{"b": null, "a": '), F.col("event_id").cast("string"), F.lit(".0}"))
    return view(s, d, "events").select("event_id", digest.json_digest(source).alias("digest"))


# joins


@query("SELECT o.ordinal, o.object_ref, b.status FROM v_objects o JOIN v_batches b USING (generation) QUALIFY row_number() OVER (PARTITION BY ordinal ORDER BY version DESC, object_ref DESC) = 1", "v_batches")
def j2_latest_with_batch(s, d):
    both = view(s, d, "v_objects").join(F.broadcast(view(s, d, "v_batches").select("generation", "status")), "generation")  # 50 generations at most
    return sync.latest(both, "ordinal", "version", "object_ref").select("ordinal", "object_ref", "status")


@query("SELECT a.seq, b.seq IS NOT NULL AS stamped FROM v_assertions a LEFT JOIN v_assertions b ON b.superseded_by = a.seq", "v_assertions")
def j4_stamps(s, d):
    rows = log(s, d)
    stamps = rows.where("superseded_by IS NOT NULL").select(F.col("superseded_by").alias("seq"), F.lit(True).alias("hit"))
    return rows.select("seq").join(stamps, "seq", "left").select("seq", F.coalesce("hit", F.lit(False)).alias("stamped"))


@query("SELECT e.seq, 'outbound' AS way FROM v_edges e WHERE src IN ('n1', 'n2') UNION ALL SELECT e.seq, 'inbound' FROM v_edges e WHERE dst IN ('n1', 'n2')", "v_edges")
def j7_frontier(s, d):
    front = s.createDataFrame([("n1",), ("n2",)], "node string")
    e = view(s, d, "v_edges")
    hop = lambda c, name: e.join(F.broadcast(front), e[c] == front["node"]).select("seq", F.lit(name).alias("way"))
    return hop("src", "outbound").union(hop("dst", "inbound"))


@query("SELECT seq, src, dst FROM v_edges WHERE src NOT IN (SELECT entity_id FROM v_entities) AND dst NOT IN (SELECT entity_id FROM v_entities)", "v_edges", "v_entities")
def j10_dangling_slots(s, d):
    e, known = view(s, d, "v_edges"), view(s, d, "v_entities").select("entity_id")
    return e.join(known, e["src"] == known["entity_id"], "left_anti").join(known, e["dst"] == known["entity_id"], "left_anti").select("seq", "src", "dst")


@query("SELECT old_id, new_id FROM v_alias_rows WHERE disposition = 'mapped' AND new_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0)", "v_alias_rows")
def j11_missing_targets(s, d):
    live = view(s, d, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("new_id"))
    return view(s, d, "v_alias_rows").where("disposition = 'mapped'").join(live, "new_id", "left_anti").select("old_id", "new_id")


@query("SELECT a.old_id, a.disposition AS planned, CASE WHEN a.old_id % 2 = 0 THEN 'mapped' ELSE 'terminal' END AS stored FROM v_alias_rows a WHERE a.disposition <> CASE WHEN a.old_id % 2 = 0 THEN 'mapped' ELSE 'terminal' END", "v_alias_rows")
def j13_legacy_resolution(s, d):
    rows = view(s, d, "v_alias_rows")
    stored = rows.select("old_id", F.when(F.col("old_id") % 2 == 0, "mapped").otherwise("terminal").alias("stored"))
    return rows.join(stored, "old_id").where("disposition <> stored").select("old_id", F.col("disposition").alias("planned"), "stored")


@query("WITH u AS (SELECT lower(display_name) AS title, min(entity_id) AS entity_id FROM v_entities GROUP BY 1 HAVING count(DISTINCT entity_id) = 1), r AS (SELECT 'Customer#' || lpad((n * 13)::VARCHAR, 9, '0') AS ref FROM range(200) t(n)) SELECT r.ref, u.entity_id FROM r LEFT JOIN u ON u.title = lower(r.ref)", "v_entities")
def j21_reference_to_entity(s, d):
    unique = sync.unique_titles(view(s, d, "v_entities").withColumn("title", F.lower("display_name")), ("title",), "entity_id")
    refs = s.range(200).select(F.concat(F.lit("Customer#"), F.lpad((F.col("id") * 13).cast("string"), 9, "0")).alias("ref"))
    return refs.withColumn("title", F.lower("ref")).join(unique, "title", "left").select("ref", "entity_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) AND source IN (SELECT source FROM documents WHERE n_chars > 9000)")
def j23_superseded_imports(s, d):
    docs = view(s, d, "documents")
    covered = docs.where("n_chars > 9000").select("source").distinct()
    return docs.join(view(s, d, "labels").where("quality = 0"), "doc_id", "left_anti").join(covered, "source", "left_semi").select("doc_id")


@query("SELECT c.c_mktsegment AS rule, coalesce(string_agg(DISTINCT s.s_nationkey::VARCHAR, ',' ORDER BY s.s_nationkey::VARCHAR), '') AS tags FROM customer c LEFT JOIN supplier s ON s.s_nationkey = c.c_nationkey AND s.s_acctbal < 500 GROUP BY 1")
def j26_overlay_rules(s, d):
    sup = view(s, d, "supplier").where("s_acctbal < 500").select(F.col("s_nationkey").alias("c_nationkey"), F.col("s_nationkey").cast("string").alias("tag"))
    both = view(s, d, "customer").join(sup, "c_nationkey", "left")
    return both.groupBy(F.col("c_mktsegment").alias("rule")).agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))


@query("SELECT e.entity_id, count(*) AS facts, min(a.recorded_at) AS first_at FROM v_entities e JOIN v_assertions a ON e.entity_id = 'c' || a.subject::VARCHAR AND a.kind = 'fact' GROUP BY 1", "v_entities", "v_assertions")
def j27_assertions_for_entity(s, d):
    a = log(s, d).where("kind = 'fact'").withColumn("entity_id", F.concat(F.lit("c"), F.col("subject").cast("string")))
    return a.join(view(s, d, "v_entities").select("entity_id"), "entity_id").groupBy("entity_id").agg(F.count("*").alias("facts"), F.min("recorded_at").alias("first_at"))


@query("SELECT o_orderkey, list_sort(list_distinct(list(l_suppkey))) AS sources FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1".replace("list_sort(list_distinct(list(l_suppkey)))", "string_agg(DISTINCT lpad(l_suppkey::VARCHAR, 8, '0'), ',' ORDER BY lpad(l_suppkey::VARCHAR, 8, '0'))"))
def j28_provenance(s, d):
    li = view(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.lpad(F.col("l_suppkey").cast("string"), 8, "0").alias("k"))
    return view(s, d, "orders").where("o_orderstatus = 'F'").join(li, "o_orderkey").groupBy("o_orderkey").agg(F.array_join(F.array_sort(F.collect_set("k")), ",").alias("sources"))


@query("WITH g AS (SELECT p_brand AS g, p_size AS k FROM part GROUP BY 1, 2), u AS (SELECT k, min(g) AS g FROM g GROUP BY 1 HAVING count(*) = 1), r AS (SELECT n AS k FROM range(60) t(n)) SELECT r.k, CASE WHEN u.g IS NOT NULL THEN 'rekeyed' WHEN r.k IN (SELECT k FROM g) THEN 'ambiguous' ELSE 'unknown-group' END AS state FROM r LEFT JOIN u USING (k)")
def j30_rekey(s, d):
    g = view(s, d, "part").select(F.col("p_size").cast("long").alias("k"), F.col("p_brand").alias("g")).distinct().groupBy("k").agg(F.count("*").alias("n"))
    return s.range(60).toDF("k").join(g, "k", "left").select("k", F.when(F.col("n") == 1, "rekeyed").when(F.col("n") > 1, "ambiguous").otherwise("unknown-group").alias("state"))


@query("SELECT d.lang, count(*) AS candidates FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AND d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1")
def j33_review_packet(s, d):
    labels = view(s, d, "labels")
    some = view(s, d, "documents").join(labels.where("quality = 0"), "doc_id", "left_semi").join(labels.where("toxic = 1"), "doc_id", "left_anti")
    return some.groupBy("lang").agg(F.count("*").alias("candidates"))


# aggregations


@query("SELECT subject, count(DISTINCT client_id) > 1 AS mixed FROM v_assertions GROUP BY subject", "v_assertions")
def a2_mixed_fidelity(s, d):
    return log(s, d).groupBy("subject").agg((F.count_distinct("client_id") > 1).alias("mixed"))


@query("SELECT (SELECT count(*) FROM v_objects) AS inventory, (SELECT sum(object_count)::BIGINT FROM v_batches) AS app, (SELECT count(*) FROM v_objects) = (SELECT sum(object_count) FROM v_batches) AS agrees", "v_batches")
def a11_usage_reconcile(s, d):
    inventory = view(s, d, "v_objects").agg(F.count("*").alias("inventory"))
    app = view(s, d, "v_batches").agg(F.sum("object_count").alias("app"))
    return inventory.crossJoin(app).withColumn("agrees", F.col("inventory") == F.col("app"))  # two single rows


@query("SELECT source, count(*) AS files, sum(n_chars)::BIGINT AS chars, sum(len(string_split(text, chr(10))))::BIGINT AS lines FROM documents GROUP BY source")
def a16_ledger_totals(s, d):
    lines = F.regexp_count("text", F.lit("\n")) + 1
    return view(s, d, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"), F.sum(lines).cast("long").alias("lines"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source))")
def a17_histograms(s, d):
    docs = view(s, d, "documents")
    return docs.groupingSets([[F.col("lang")], [F.col("source")], [F.col("lang"), F.col("source")]], "lang", "source").agg(F.count("*").alias("n"))


@query("WITH w AS (SELECT ordinal AS k, object_ref, size, row_number() OVER (PARTITION BY ordinal ORDER BY version DESC, object_ref DESC, size DESC) AS r FROM v_objects) SELECT count(*) AS windows, sum(size)::BIGINT AS total FROM w WHERE r = 1", "v_objects")
def a19_latest_per_window(s, d):
    last = view(s, d, "v_objects").groupBy("ordinal").agg(F.max(F.struct("version", "object_ref", "size")).alias("m"))
    return last.agg(F.count("*").alias("windows"), F.sum("m.size").alias("total"))


@query("SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1, 2")
def a23_map_sum(s, d):
    pairs = view(s, d, "events").select("event_type", F.explode(F.from_json("props", "map<string,int>")).alias("name", "k"))
    return pairs.groupBy("event_type", F.col("k").cast("string").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment AS grp, count(*) AS n, count(DISTINCT c_nationkey) AS sources, min(c_name) AS first_name FROM customer GROUP BY 1")
def a24_topic_groups(s, d):
    return view(s, d, "customer").groupBy(F.col("c_mktsegment").alias("grp")).agg(F.count("*").alias("n"), F.count_distinct("c_nationkey").alias("sources"), F.min("c_name").alias("first_name"))


@query("WITH t AS (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_name) AS r FROM (SELECT DISTINCT p_brand, p_name FROM part)) SELECT p_brand, string_agg(p_name, ';' ORDER BY p_name) AS snippets FROM t WHERE r <= 3 GROUP BY 1")
def a25_snippets(s, d):
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_name"))
    some = view(s, d, "part").select("p_brand", "p_name").distinct().withColumn("r", rank).where("r <= 3")
    return some.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list("p_name")), ";").alias("snippets"))


@query("WITH u(k, pos) AS (VALUES ('assert', 1), ('correct', 2), ('retract', 3), ('invalidate', 4), ('reinstate', 5), ('other', 6)) SELECT u.k AS category, u.pos, count(a.seq) AS n FROM u LEFT JOIN v_assertions a ON a.lineage_action = u.k GROUP BY 1, 2", "v_assertions")
def a27_breakdown(s, d):
    names = ["assert", "correct", "retract", "invalidate", "reinstate", "other"]
    universe = s.createDataFrame([(k, n) for n, k in enumerate(names, 1)], "category string, pos int")
    n = log(s, d).groupBy(F.col("lineage_action").alias("category")).agg(F.count("*").alias("n"))
    return universe.join(n, "category", "left").select("category", "pos", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT predicate, count(*) AS edges, count(DISTINCT dst) AS targets FROM v_edges GROUP BY 1", "v_edges")
def a31_edge_breakdown(s, d):
    return view(s, d, "v_edges").groupBy("predicate").agg(F.count("*").alias("edges"), F.count_distinct("dst").alias("targets"))


@query("SELECT t.tag AS topic, count(*) AS contributors, count(DISTINCT path) AS pages FROM (SELECT path, unnest(regexp_extract_all(markdown, '\\[\\[([^\\]\\n]{1,256})\\]\\]', 1)) AS tag FROM v_markdown) t GROUP BY 1", "v_markdown")
def a38_topic_contributors(s, d):
    refs = view(s, d, "v_markdown").select("path", F.explode(F.regexp_extract_all("markdown", F.lit(r"\[\[([^\]\n]{1,256})\]\]"), F.lit(1))).alias("topic"))
    return refs.groupBy("topic").agg(F.count("*").alias("contributors"), F.count_distinct("path").alias("pages"))


@query("SELECT (SELECT count(*) FROM v_assertions) AS assertions, (SELECT count(*) FROM v_entities) AS entities, (SELECT count(*) FROM v_alias_rows) AS redirects", "v_assertions", "v_entities", "v_alias_rows")
def a40_store_status(s, d):
    one = lambda name, alias: view(s, d, name).agg(F.count("*").alias(alias))
    return one("v_assertions", "assertions").crossJoin(one("v_entities", "entities")).crossJoin(one("v_alias_rows", "redirects"))  # single rows


@query("SELECT count(*) AS documents, count(*) FILTER (x) AS unchanged, count(*) FILTER (NOT x) AS changed FROM (SELECT sha256(text) = sha256(replace(text, '###', '')) AS x FROM documents)")
def a47_lossless_check(s, d):
    same = F.sha2("text", 256) == F.sha2(F.replace("text", F.lit("###"), F.lit("")), 256)
    return view(s, d, "documents").agg(F.count("*").alias("documents"), F.count_if(same).alias("unchanged"), F.count_if(~same).alias("changed"))


@query("SELECT generation, array_to_string(list_filter([CASE WHEN status <> 'committed' THEN 'not-committed' END, CASE WHEN object_count < 1200 THEN 'few-objects' END, CASE WHEN bytes > 31000 THEN 'large' END], lambda x: x IS NOT NULL), ',') AS blockers FROM v_batches", "v_batches")
def a46_blockers(s, d):
    checks = F.array(F.when(F.col("status") != "committed", "not-committed"), F.when(F.col("object_count") < 1200, "few-objects"), F.when(F.col("bytes") > 31000, "large"))
    return view(s, d, "v_batches").select("generation", F.array_join(F.array_compact(checks), ",").alias("blockers"))


# windows


@query("SELECT subject, seq, epoch(recorded_at::TIMESTAMP)::BIGINT + row_number() OVER (PARTITION BY subject, recorded_at ORDER BY seq) - 1 AS monotone FROM v_assertions", "v_assertions")
def w2_monotone_time(s, d):
    nth = F.row_number().over(Window.partitionBy("subject", "recorded_at").orderBy("seq")) - 1
    return log(s, d).select("subject", "seq", (F.unix_seconds(F.col("recorded_at").cast("timestamp")) + nth).cast("long").alias("monotone"))


@query("SELECT authority, max(ordinal + size)::BIGINT AS next_offset FROM v_objects GROUP BY 1", "v_objects")
def w10_next_offset(s, d):
    return view(s, d, "v_objects").groupBy("authority").agg(F.max(F.col("ordinal") + F.col("size")).alias("next_offset"))


@query("WITH t AS (SELECT doc_id, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos, lower(unnest(string_split(text, ' '))) AS w FROM documents) SELECT doc_id, min(pos) AS pos, arg_min(w, pos) AS token FROM t WHERE w IN ('the', 'de', 'und', 'la', 'of') GROUP BY doc_id")
def w14_first_predicate_token(s, d):
    words = view(s, d, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "w")).withColumn("w", F.lower("w")).where(F.col("w").isin("the", "de", "und", "la", "of"))
    return words.groupBy("doc_id").agg(F.min("pos").cast("long").alias("pos"), F.min_by("w", "pos").alias("token"))


@query("SELECT DISTINCT source, lang FROM documents EXCEPT SELECT source, lang FROM documents JOIN labels USING (doc_id) WHERE toxic = 1")
def u5_expected_minus_covered(s, d):
    docs = view(s, d, "documents")
    covered = docs.join(view(s, d, "labels").where("toxic = 1"), "doc_id", "left_semi")
    return docs.select("source", "lang").subtract(covered.select("source", "lang"))


@query("SELECT user_id, list_sort(list_distinct(list(event_type) FILTER (event_id % 2 = 0))) = list_sort(list_distinct(list(event_type) FILTER (event_id % 2 = 1))) AS same FROM events GROUP BY 1")
def u6_set_equality(s, d):
    part = lambda k: F.array_sort(F.collect_set(F.when(F.col("event_id") % 2 == k, F.col("event_type"))))
    return view(s, d, "events").groupBy("user_id").agg((part(0) == part(1)).alias("same"))


# text


@query()
def t18_query_normalization(s, d):
    """Of whole texts; SQL has no NFKC, so a test compares it with plain Python."""
    return view(s, d, "documents").select("doc_id", digest.normal_query("text").alias("q"))


@query("WITH n AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x NOT IN ('the', 'of', 'and', 'a', '')) AS w FROM documents) SELECT doc_id, array_to_string(w[1:12], ' ') AS k FROM n")
def t20_grouping_text(s, d):
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " ")
    return view(s, d, "documents").select("doc_id", F.array_join(F.slice(F.filter(words, lambda x: ~x.isin("the", "of", "and", "a", "")), 1, 12), " ").alias("k"))


@query("SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE regexp_matches(l, '[0-9]{3}') AND length(l) < 400 GROUP BY 1")
def t19_candidate_lines(s, d):
    lines = view(s, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    return lines.where(F.col("l").rlike("[0-9]{3}") & (F.length("l") < 400)).groupBy("doc_id").agg(F.count("*").alias("lines"))


@query("SELECT kind, target, count(*) AS n FROM (SELECT 'wikilink' AS kind, lower(trim(split_part(unnest(regexp_extract_all(markdown, '\\[\\[([^\\]\\n]{1,256})\\]\\]', 1)), '|', 1))) AS target FROM v_markdown) GROUP BY 1, 2 HAVING count(*) >= 2", "v_markdown")
def t22_curated_topics(s, d):
    refs = search.references(view(s, d, "v_markdown")).where("kind = 'wikilink'")
    return refs.groupBy("kind", "target").agg(F.count("*").alias("n")).where("n >= 2")


OPENING_SQL = r"\n[ \t]*([-*+][ \t]+|#{1,6}[ \t]+|[A-Za-z][A-Za-z0-9_-]*::)"
UNITS_SQL = f"""
    u AS (SELECT path, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(replace(markdown, chr(13) || chr(10), chr(10)), '\\n([ \\t\\r]*\\n)+', chr(30), 'g'), '{OPENING_SQL}', chr(30) || '\\1', 'g'), '[ \\t]*\\n[ \\t]*', ' ', 'g'), chr(30)),
          lambda x: regexp_replace(x, '^[ \\t]+|[ \\t]+$', '', 'g')), lambda x: x <> '') AS units FROM v_markdown),
    r AS (SELECT path, generate_subscripts(units, 1) - 1 AS pos, unnest(units) AS unit FROM u),
    k AS (SELECT *, lower(regexp_extract(unit, '^([A-Za-z][A-Za-z0-9_-]*)::', 1)) AS key, lower(regexp_extract(unit, '^[-*+][ \\t]+(?:\\*\\*)?([A-Za-z][A-Za-z /&-]{{0,48}}):', 1)) AS label FROM r)"""
KIND_SQL = "CASE " + " ".join(f"WHEN key = '{k}' THEN '{v}'" for k, v in markup.PROPERTY_KIND.items()) + " WHEN key <> '' THEN 'attribute' WHEN regexp_matches(unit, '^#{1,6}[ \\t]+[^ \\t]') THEN 'entity' " + " ".join(f"WHEN {' OR '.join(f'contains(label, {w!r})' for w in words)} THEN '{kind}'" for kind, words in markup.LABEL_KIND) + " ELSE 'observation' END"


@query(f"WITH {UNITS_SQL} SELECT path, pos::INT AS pos, {KIND_SQL} AS kind, sha256(unit) AS unit_id FROM k", "v_markdown")
def t13_source_meaning(s, d):
    units = view(s, d, "v_markdown").select("path", F.posexplode(markup.segments(F.col("markdown"))).alias("pos", "unit"))
    return units.select("path", "pos", markup.segment_kind(F.col("unit")).alias("kind"), F.sha2("unit", 256).alias("unit_id"))


@query("SELECT p_partkey, p_name AS name, NULL::VARCHAR AS note FROM part UNION ALL SELECT p_partkey, p_brand, p_type || ' · ' || p_size FROM part")
def t14_title_units(s, d):
    title = F.concat(F.lit("[["), F.col("p_name"), F.lit("]] · "), F.col("p_brand"), F.lit(" ("), F.col("p_type"), F.lit(" · "), F.col("p_size"), F.lit(") "))
    return view(s, d, "part").select("p_partkey", F.explode(markup.title_units(title)).alias("u")).select("p_partkey", "u.name", "u.note")


CUT_SQL = "CASE WHEN length({0}) > 4096 AND contains({0}[:4096], chr(10)) THEN {0}[:4097 - instr(reverse({0}[:4096]), chr(10))] ELSE {0}[:4096] END"


@query(f"WITH RECURSIVE c AS (SELECT doc_id, 0 AS ordinal, {CUT_SQL.format('text')} AS chunk, text AS rest FROM documents WHERE text <> '' UNION ALL SELECT doc_id, ordinal + 1, {CUT_SQL.format('rest[length(chunk) + 1:]')}, rest[length(chunk) + 1:] FROM c WHERE length(rest) > length(chunk)) SELECT doc_id, ordinal, chunk FROM c")
def t16_evidence_chunks(s, d):
    return view(s, d, "documents").select("doc_id", F.posexplode(markup.evidence_chunks("text")).alias("ordinal", "chunk"))


@query("SELECT event_id, 'k ' || json_extract_string(props, '$.k') AS text FROM events")
def t3_text_from_value(s, d):
    return view(s, d, "events").select("event_id", digest.json_text("props").alias("text"))


# pipelines


@query("SELECT o_custkey, count(*) AS employers, CASE WHEN count(*) = 1 THEN 'placed' WHEN count(*) = 0 THEN 'no-employer' ELSE 'many-employers' END AS outcome FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) GROUP BY 1")
def e5_title_placement(s, d):
    n = view(s, d, "orders").select("o_custkey", "o_orderpriority").distinct().groupBy("o_custkey").agg(F.count("*").alias("employers"))
    return n.withColumn("outcome", F.when(F.col("employers") == 1, "placed").when(F.col("employers") == 0, "no-employer").otherwise("many-employers"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'ok' ELSE 'unknown-id' END AS outcome, pos FROM (SELECT n AS pos, n AS doc_id FROM range(100) t(n))")
def e17_batch_items(s, d):
    known = view(s, d, "documents").where("doc_id % 2 = 0").select("doc_id", F.lit(1).alias("hit"))
    items = s.range(100).select(F.col("id").alias("pos"), F.col("id").alias("doc_id"))
    return items.join(known, "doc_id", "left").select("doc_id", F.when(F.col("hit") == 1, "ok").otherwise("unknown-id").alias("outcome"), "pos")


@query("SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 20 AS chunk FROM documents")
def e20_backfill_chunks(s, d):
    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    return view(s, d, "documents").select("source", "doc_id", F.floor(n / 20).cast("long").alias("chunk"))


@query("SELECT old_id AS id, new_id AS target FROM v_alias_rows WHERE disposition = 'mapped'", "v_alias_rows")
def g5_redirects_acyclic(s, d):
    """Redirects that a write may add: those that do not close a cycle."""
    rows = view(s, d, "v_alias_rows")
    ids = rows.where("disposition = 'mapped'").select(F.col("old_id").alias("id"))
    live = view(s, d, "customer").select(F.col("c_custkey").alias("id"))
    ok = graph.resolve(rows, ids, live).where("outcome <> 'cycle-or-depth'").select("id")
    return rows.where("disposition = 'mapped'").select(F.col("old_id").alias("id"), F.col("new_id").alias("target")).join(ok, "id")


@query("SELECT generation AS g, version, CASE WHEN version = 1 THEN 'apply' WHEN prev IS NULL THEN 'version-gap' WHEN version = prev + 1 THEN 'apply' ELSE 'version-gap' END AS action FROM (SELECT generation, ordinal, version, lag(version) OVER (PARTITION BY ordinal ORDER BY version, object_ref) AS prev FROM v_objects)", "v_objects")
def r6_apply_envelopes(s, d):
    prev = F.lag("version").over(Window.partitionBy("ordinal").orderBy("version", "object_ref"))
    v = F.col("version")
    out = view(s, d, "v_objects").withColumn("prev", prev)
    action = F.when(v == 1, "apply").when(F.col("prev").isNull(), "version-gap").when(v == F.col("prev") + 1, "apply").otherwise("version-gap")
    return out.select(F.col("generation").alias("g"), "version", action.alias("action"))


@query("SELECT greatest(max(recorded_at), '1999-01-01') AS floor FROM v_assertions WHERE lineage_action = 'retract'", "v_assertions")
def r3_history_floor(s, d):
    return log(s, d).where("lineage_action = 'retract'").agg(F.greatest(F.max("recorded_at"), F.lit("1999-01-01")).alias("floor"))


@query("SELECT status, count(*) AS n, min(generation) AS first_generation FROM v_batches GROUP BY 1", "v_batches")
def r12_write_states(s, d):
    return view(s, d, "v_batches").groupBy("status").agg(F.count("*").alias("n"), F.min("generation").alias("first_generation"))
