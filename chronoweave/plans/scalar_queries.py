"""Queries of the scalar functions, of the policy, and of hash chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.functions import digest
from chronoweave.functions import scalars as sc
from chronoweave.functions import world_time as wt
from chronoweave.operators import policy, search
from chronoweave.plans.queries import bound, log, query
from chronoweave.plans.views import view

# strings


@query("SELECT c_custkey, lower(c_name) = 'customer#000000007' AS same, starts_with(lower(c_name), 'customer#00000001') AS begins, contains(lower(c_mktsegment), 'mach') AS holds FROM customer")
def x1_comparisons(s, d):
    n = F.lower("c_name")
    return view(s, d, "customer").select("c_custkey", (n == "customer#000000007").alias("same"), F.startswith(n, F.lit("customer#00000001")).alias("begins"), F.contains(F.lower("c_mktsegment"), F.lit("mach")).alias("holds"))


@query("SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(lower(p_name || '  ' || p_type), '\\s+'), lambda x: x <> ''), ',') AS terms FROM part")
def x2_terms(s, d):
    return view(s, d, "part").select("p_partkey", F.array_join(sc.terms(F.concat("p_name", F.lit("  "), "p_type")), ",").alias("terms"))


@query("SELECT doc_id, len(string_split(text, 'the')) - 1 AS n FROM documents WHERE text IS NOT NULL")
def x3_occurrences(s, d):
    return view(s, d, "documents").where("text IS NOT NULL").select("doc_id", search.occurrences(F.col("text"), "the").alias("n"))


@query("SELECT doc_id, substr(text, 1, 240) AS snippet, substr(sha256(text), 1, 12) AS slug FROM documents")
def x4_snippets(s, d):
    return view(s, d, "documents").select("doc_id", sc.snippet(F.col("text")).alias("snippet"), F.substring(F.sha2("text", 256), 1, 12).alias("slug"))


@query("SELECT p_partkey, './' || replace(p_type, ' ', '\\') || '//' || p_name || '.MD' AS raw, regexp_replace(regexp_replace(replace('./' || replace(p_type, ' ', '\\') || '//' || p_name || '.MD', '\\', '/'), '/+', '/', 'g'), '^\\./', '') AS path, 'md' AS extension FROM part")
def x6_paths(s, d):
    raw = F.concat(F.lit("./"), F.replace("p_type", F.lit(" "), F.lit("\\")), F.lit("//"), F.col("p_name"), F.lit(".MD"))
    return view(s, d, "part").select("p_partkey", raw.alias("raw"), sc.normal_path(raw).alias("path"), sc.extension(raw).alias("extension"))


@query("SELECT p_partkey, trim(regexp_replace(p_name || ' ' || p_type, '\\s+', ' ', 'g')) AS cleaned FROM part")
def x7_cleaned(s, d):
    return view(s, d, "part").select("p_partkey", sc.clean(F.concat(F.lit(" **"), F.col("p_name"), F.lit("**   [["), F.col("p_type"), F.lit("]] "))).alias("cleaned"))


@query("SELECT p_partkey, lower(p_brand) AS tag, upper(substr(p_brand, 1, 1)) || substr(translate(p_brand, '-_', '  '), 2) AS label, regexp_replace(lower(p_type), '\\s+', ' ', 'g') AS topic FROM part")
def x8_tags(s, d):
    return view(s, d, "part").select("p_partkey", sc.tag(F.concat(F.lit(" #"), F.col("p_brand"), F.lit(" "))).alias("tag"), sc.human_label(F.col("p_brand")).alias("label"), sc.topic_value(F.concat(F.lit("  "), F.col("p_type"))).alias("topic"))


@query("SELECT event_id, upper(substr(event_type, 1, 1)) || substr(event_type, 2) || ' of user' AS label FROM events")
def x9_labels(s, d):
    return view(s, d, "events").select("event_id", sc.human_label(F.concat(F.col("event_type"), F.lit("-of_user"))).alias("label"))


@query("SELECT doc_id, regexp_replace(lower(trim(source)), '\\s+', ' ', 'g') AS topic FROM documents WHERE source IS NOT NULL")
def x10_topics(s, d):
    return view(s, d, "documents").where("source IS NOT NULL").select("doc_id", sc.topic_value(F.concat(F.lit("  "), F.upper("source"), F.lit(" "))).alias("topic"))


# dates


@query("SELECT seq, CASE length(from_value) WHEN 4 THEN 'year' WHEN 7 THEN 'month' WHEN 10 THEN 'day' END AS precision FROM v_assertions", "v_assertions")
def x12_precision(s, d):
    return log(s, d).select("seq", wt.precision(F.col("from_value")).alias("precision"))


@query(f"SELECT seq, CAST({bound('from_kind', 'from_value')} AS VARCHAR) AS low FROM v_assertions WHERE from_value IS NOT NULL", "v_assertions")
def x13_bounds(s, d):
    return log(s, d).where("from_value IS NOT NULL").select("seq", wt.lower_bound(F.col("from_kind"), F.col("from_value")).cast("string").alias("low"))


@query("SELECT event_id, substr(CAST(ts AS VARCHAR), 1, 10) AS day FROM events")
def x14_day_buckets(s, d):
    return view(s, d, "events").select("event_id", sc.day_bucket(F.col("ts")).alias("day"))


@query("SELECT event_id, strftime(ts + INTERVAL 30 DAY + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M') AS kept_until FROM events")
def x15_retention(s, d):
    return view(s, d, "events").select("event_id", F.date_format(sc.retained_until(F.col("ts"), 30, 5), "yyyy-MM-dd HH:mm").alias("kept_until"))


@query("SELECT event_id, epoch_us(ts) // 60000000 * 60000 AS minute FROM events")
def x16_minutes(s, d):
    return view(s, d, "events").select("event_id", sc.minute_floor(F.unix_millis(F.col("ts").cast("timestamp"))).alias("minute"))


@query("SELECT l_orderkey, l_linenumber, coalesce(l_shipdate <= TIMESTAMP '1995-06-17', false) AS expired FROM lineitem")
def x17_expiry(s, d):
    return view(s, d, "lineitem").select("l_orderkey", "l_linenumber", sc.expired(F.col("l_shipdate"), F.lit("1995-06-17").cast("timestamp")).alias("expired"))


@query("SELECT event_id, epoch_us(ts) * 1000 AS nanos FROM events")
def x18_nanos(s, d):
    return view(s, d, "events").select("event_id", sc.nanos(F.col("ts")).alias("nanos"))


@query("SELECT seq, coalesce(from_value, '9999') AS key FROM v_assertions", "v_assertions")
def x19_date_keys(s, d):
    approximate = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("~"), F.col("from_value"))).otherwise(F.col("from_value"))
    return log(s, d).select("seq", wt.date_key(approximate).alias("key"))


@query("SELECT seq, TRY_CAST(day AS DATE) IS NOT NULL AS valid FROM (SELECT seq, substr(recorded_at, 1, 8) || lpad((seq % 33)::VARCHAR, 2, '0') AS day FROM v_assertions)", "v_assertions")
def x20_valid_dates(s, d):
    day = F.concat(F.substring("recorded_at", 1, 8), F.lpad((F.col("seq") % 33).cast("string"), 2, "0"))
    return log(s, d).select("seq", F.coalesce(wt.valid_mixed_date(day), F.lit(False)).alias("valid"))


# numbers


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 100 ELSE least(greatest(event_id - 40, 1), 1000) END::BIGINT AS n FROM events")
def l9_bounded_limit(s, d):
    asked = F.when(F.col("event_id") % 5 != 0, F.col("event_id") - F.lit(40) + F.lit(0.25))
    return view(s, d, "events").select("event_id", sc.bounded_limit(asked).alias("n"))


@query("SELECT ps, least(greatest(q, 5), 30)::BIGINT AS q, (ceil(q / 10) * 10)::BIGINT AS bucket FROM (SELECT l_orderkey * 10 + l_linenumber AS ps, l_quantity::BIGINT AS q FROM lineitem)")
def x21_clamp(s, d):
    q = F.col("l_quantity").cast("long")
    return view(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("ps"), sc.clamp(q, 5, 30).alias("q"), (F.ceil(q / 10) * 10).cast("long").alias("bucket"))


@query("SELECT doc_id, (ceil(n_chars / 10) * 10)::BIGINT AS bucket FROM documents")
def x23_buckets(s, d):
    from chronoweave.functions.access import bucket_count

    return view(s, d, "documents").select("doc_id", bucket_count(F.col("n_chars")).alias("bucket"))


@query("SELECT event_id, array_to_string(list_transform([9, 8, 7, 6, 5, 4, 3, 2, 1, 0], lambda k: substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', (((epoch_us(ts) // 1000) >> (5 * k)) & 31)::INT + 1, 1)), '') AS id FROM events")
def x24_time_ids(s, d):
    return view(s, d, "events").select("event_id", digest.time_id(F.unix_millis(F.col("ts").cast("timestamp"))).alias("id"))


@query("SELECT doc_id, round(('0x' || right(md5(doc_id::VARCHAR), 8))::UBIGINT / 4294967295.0, 6) AS share FROM documents")
def x25_shares(s, d):
    return view(s, d, "documents").select("doc_id", F.round(sc.hex_share(F.md5(F.col("doc_id").cast("string").cast("binary"))), 6).alias("share"))


# arrays and maps


def per_user(s, d):
    return view(s, d, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("types"))


@query("SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS types FROM events GROUP BY 1")
def x26_distinct_sorted(s, d):
    return per_user(s, d).select("user_id", F.array_join(sc.distinct_sorted(F.col("types")), ",").alias("types"))


@query("SELECT user_id, list_contains(list(event_type), 'error') AS has, list_has_any(list(event_type), ['signup', 'purchase']) AS overlaps, bool_or(event_type LIKE 'c%') AS some, bool_and(event_type <> 'view') AS every FROM events GROUP BY 1")
def x27_membership(s, d):
    t = F.col("types")
    return per_user(s, d).select(
        "user_id", F.array_contains(t, "error").alias("has"), F.arrays_overlap(t, F.array(F.lit("signup"), F.lit("purchase"))).alias("overlaps"),
        F.exists(t, lambda x: F.startswith(x, F.lit("c"))).alias("some"), F.forall(t, lambda x: x != "view").alias("every"),
    )


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')[1:2]) AS word FROM part")
def x28_slices(s, d):
    return view(s, d, "part").select("p_partkey", F.explode(F.slice(F.split("p_name", " "), 1, 2)).alias("word"))


@query("SELECT entity_id, greatest(CASE WHEN starts_with(lower(display_name), 's') THEN 0.8 ELSE 0 END, CASE WHEN starts_with(alias, 's') THEN 0.8 ELSE 0 END)::DOUBLE AS score FROM v_entities", "v_entities")
def x29_alias_scores(s, d):
    names = F.array("display_name", "alias")
    return view(s, d, "v_entities").select("entity_id", F.array_max(F.transform(names, lambda x: F.when(F.startswith(F.lower(x), F.lit("s")), F.lit(0.8)).otherwise(0.0))).alias("score"))


@query("SELECT event_type, sum(event_id)::BIGINT AS total FROM (SELECT event_type, event_id FROM events UNION ALL SELECT 'all', event_id FROM events) GROUP BY 1")
def x31_map_sums(s, d):
    maps = view(s, d, "events").select(F.create_map("event_type", "event_id", F.lit("all"), "event_id").alias("m"))
    return maps.select(F.explode("m").alias("event_type", "n")).groupBy("event_type").agg(F.sum("n").alias("total"))


@query("SELECT c_custkey, c_name AS name, '[redacted]' AS phone FROM customer")
def x32_masked_keys(s, d):
    m = sc.masked(F.create_map(F.lit("name"), F.col("c_name"), F.lit("phone"), F.col("c_mktsegment")), ("phone", "email"))
    return view(s, d, "customer").select("c_custkey", m["name"].alias("name"), m["phone"].alias("phone"))


# documents in JSON


@query("SELECT event_id, CASE WHEN event_id % 3 > 0 THEN json_extract_string(props, '$.k')::INT END AS k FROM events")
def x33_safe_parse(s, d):
    line = F.when(F.col("event_id") % 3 == 0, F.substring("props", 2, 1 << 30)).otherwise(F.col("props"))
    return view(s, d, "events").select("event_id", F.variant_get(F.try_parse_json(line), "$.k", "int").alias("k"))


@query("SELECT n_nationkey, 'key ' || n_nationkey || ' nation name ' || n_name AS text FROM nation")
def x35_flat_text(s, d):
    value = F.to_json(F.struct(F.col("n_nationkey").alias("key"), F.struct(F.col("n_name").alias("name")).alias("nation")))
    return view(s, d, "nation").select("n_nationkey", digest.json_text(value).alias("text"))


@query("SELECT event_id, translate(rtrim(base64(props::BLOB), '='), '+/', '-_') AS token, props AS back FROM events")
def x36_url_tokens(s, d):
    token = sc.url_token(F.col("props"))
    return view(s, d, "events").select("event_id", token.alias("token"), sc.from_url_token(token).alias("back"))


# policy

REQUESTS = """
    SELECT l_orderkey * 10 + l_linenumber AS id, 'c' || (l_partkey % 3)::STRING AS actor,
           CASE l_suppkey % 10 WHEN 0 THEN 'sync-device' WHEN 1 THEN 'remote-safe' WHEN 2 THEN 'remote-cloud-unlock' WHEN 3 THEN 'local-readonly' WHEN 4 THEN 'local-full'
                WHEN 5 THEN 'local-release' WHEN 6 THEN 'local-admin' WHEN 7 THEN 'local-crud' WHEN 8 THEN 'sensitive-keyholding-client' ELSE 'nobody' END AS profile,
           CASE l_partkey % 6 WHEN 0 THEN 'object_get' WHEN 1 THEN 'search' WHEN 2 THEN 'update' WHEN 3 THEN 'sync_pull' WHEN 4 THEN 'audit_read' ELSE 'timeline' END AS operation,
           CASE WHEN l_linenumber % 2 = 0 THEN 'cloud-unlock-session' ELSE 'plain' END AS access_mode, l_orderkey % 4 = 0 AS unlocked,
           CASE WHEN l_orderkey % 13 <> 0 THEN CASE WHEN l_orderkey % 17 = 0 THEN 'other' ELSE 'c' || (l_partkey % 3)::STRING END END AS cap_client,
           CASE WHEN l_orderkey % 19 = 0 THEN '2020' END AS cap_revoked_at, CASE WHEN l_orderkey % 5 = 0 THEN CASE WHEN l_linenumber = 1 THEN '2024' ELSE '2030' END END AS cap_expires_at,
           CASE WHEN l_orderkey % 23 = 0 THEN 'none' ELSE 'same' END AS p, CASE WHEN l_orderkey % 29 = 0 THEN 'x' ELSE 'same' END AS m, l_orderkey % 31 = 0 AS narrow, l_orderkey % 37 = 0 AS small,
           CASE l_orderkey % 5 WHEN 0 THEN 'remote-safe' WHEN 1 THEN 'release' WHEN 2 THEN 'local-private' WHEN 3 THEN 'quarantine' ELSE 'shareable' END AS access_class,
           CASE l_linenumber WHEN 2 THEN '2024' WHEN 3 THEN '2031' END AS release_expires_at, CASE WHEN l_returnflag = 'A' THEN 'plaintext-json' ELSE 'ciphertext' END AS payload
    FROM lineitem"""
ANY = "operation IN ('object_get', 'search', 'timeline')"
OPEN = "access_class IN ('remote-safe', 'shareable', 'release')"


@query(f"""
    WITH q AS ({REQUESTS.replace("STRING", "VARCHAR")}), r AS (SELECT *, CASE
        WHEN cap_client IS NULL THEN 'missing-capability' WHEN cap_client <> actor THEN 'capability-actor-mismatch' WHEN cap_revoked_at IS NOT NULL THEN 'capability-revoked'
        WHEN cap_expires_at <= '2026' THEN 'capability-expired' WHEN p <> 'same' OR m <> 'same' THEN 'capability-profile-mismatch'
        WHEN narrow AND operation <> 'search' THEN 'capability-operation-denied' WHEN small AND access_class <> 'remote-safe' THEN 'capability-access-class-denied'
        WHEN profile = 'sync-device' THEN CASE WHEN operation <> 'sync_pull' THEN 'sync-plaintext-denied' ELSE 'allowed' END
        WHEN access_class = 'quarantine' AND profile <> 'local-admin' THEN 'quarantine-denied' WHEN access_class = 'release' AND release_expires_at <= '2026' THEN 'release-expired'
        WHEN profile = 'remote-safe' THEN CASE WHEN NOT {ANY} THEN 'profile-operation-denied' WHEN NOT {OPEN} THEN 'remote-sensitive-unavailable' ELSE 'allowed' END
        WHEN profile = 'remote-cloud-unlock' THEN CASE WHEN NOT {ANY} THEN 'cloud-unlock-mutation-denied' WHEN {OPEN} OR (access_mode = 'cloud-unlock-session' AND unlocked) THEN 'allowed' ELSE 'cloud-unlock-required' END
        WHEN profile = 'local-readonly' THEN CASE WHEN {ANY} THEN 'allowed' ELSE 'readonly-denied' END
        WHEN profile IN ('local-full', 'local-crud', 'sensitive-keyholding-client') AND ({ANY} OR operation = 'update') THEN 'allowed'
        WHEN profile = 'local-release' AND ({ANY} OR operation = 'update') THEN CASE WHEN {OPEN} THEN 'allowed' ELSE 'remote-sensitive-unavailable' END
        WHEN profile = 'local-admin' AND operation <> 'sync_pull' THEN 'allowed' ELSE 'profile-operation-denied' END AS reason FROM q)
    SELECT id, reason, reason = 'allowed' AND profile <> 'sync-device' AND (profile <> 'remote-safe' OR payload = 'plaintext-json') AS plaintext FROM r""")  # fmt: skip
def p5_policy_decisions(s, d):
    view(s, d, "lineitem").createOrReplaceTempView("policy_lineitem")
    q = s.sql(REQUESTS.replace("FROM lineitem", "FROM policy_lineitem"))
    every = F.array(*map(F.lit, (*policy.READ, *policy.WRITE, *policy.SYNC, *policy.ADMIN)))
    q = q.withColumn("cap_profile", F.when(F.col("p") == "same", F.col("profile")).otherwise(F.col("p"))).withColumn("cap_access_mode", F.when(F.col("m") == "same", F.col("access_mode")).otherwise(F.col("m")))
    q = q.withColumn("cap_operations", F.when(F.col("narrow"), F.array(F.lit("search"))).otherwise(every)).withColumn("cap_classes", F.when(F.col("small"), F.array(F.lit("remote-safe"))).otherwise(F.array(*map(F.lit, policy.ALL_CLASSES))))
    return q.select("id", policy.evaluate(F.lit("2026")).alias("a")).select("id", "a.reason", "a.plaintext")
