"""The store's read tools as queries: a store whose tables are views over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import access
from chronoweave.plans.queries import SQL, query
from chronoweave.plans.views import view
from chronoweave.store import ASSERTIONS, GraphStore

READER = access.Grant("reader", ("open",))
STUB = "CASE WHEN NOT {0} THEN 'redaction_' || substr(sha256('reader' || chr(0) || {1}), 1, 32) END"
SHOWN = "(tier = 'open' AND NOT withheld)"


class ViewStore(GraphStore):
    """A store that reads views and is never written."""

    def __init__(self, spark: SparkSession, sf_dir: str, grant: access.Grant = READER):
        super().__init__(spark, sf_dir, grant)

    def table(self, name: str) -> DataFrame:
        if name == "assertions":
            return view(self.spark, self.path, "v_assertions").select(*(F.col(c.split()[0]) for c in ASSERTIONS.split(",")))
        if name == "stamps":
            return view(self.spark, self.path, "v_assertions").where("superseded_at IS NOT NULL").select("seq", "superseded_at", "superseded_by")
        if name == "entities":
            open_ = [F.lit("2026").alias("updated_at"), F.lit("open").alias("tier"), F.lit(10).alias("tier_rank"), F.endswith("entity_id", F.lit("7")).alias("withheld")]
            return view(self.spark, self.path, "v_entities").select("entity_id", "type", "display_name", "alias", *open_)
        if name == "aliases":
            old, new = F.concat(F.lit("c"), F.col("old_id").cast("string")), F.concat(F.lit("c"), F.col("new_id").cast("string"))
            return view(self.spark, self.path, "v_alias_rows").select(old.alias("old_id"), new.alias("new_id"), "disposition")
        if name == "receipts":
            rows = view(self.spark, self.path, "orders")
            key = F.concat(F.lit("k"), F.col("o_orderkey").cast("string"))
            return rows.select(F.lit("reader").alias("client_id"), key.alias("idempotency_key"), F.lit("d").alias("request_digest"), F.concat(F.lit("sub"), F.col("o_orderkey").cast("string")).alias("submission_id"), F.col("o_orderdate").cast("date").cast("string").alias("committed_at"))
        raise KeyError(name)


IDS = [f"c{k}" for k in (7, 3, 14, 21, 3, 5, 999_999, 28, 35, 1)]


@query("SELECT predicate, bool_or(target IS NOT NULL) AS relational, 'multi-valued' AS cardinality FROM v_assertions GROUP BY 1", "v_assertions")
def tool1_contract(s, d):
    return ViewStore(s, d).contract_describe().rows


@query("SELECT 'reader' AS client_id, 'open' AS tiers, 10 AS ceiling, 'own' AS supersession_scope")
def tool2_scope(s, d):
    facts = ViewStore(s, d).scope_describe().facts
    return s.createDataFrame([(facts["client_id"], ",".join(facts["tiers"]), facts["ceiling"], facts["supersession_scope"])], "client_id string, tiers string, ceiling int, supersession_scope string")


@query(f"""WITH RECURSIVE m AS (SELECT old_id, new_id FROM v_alias_rows WHERE disposition = 'mapped'), i AS (SELECT DISTINCT substr(unnest({IDS}), 2)::BIGINT AS id),
    w AS (SELECT id, id AS target, 0 AS h FROM i UNION ALL SELECT w.id, m.new_id, h + 1 FROM w JOIN m ON m.old_id = w.target WHERE h < 32), l AS (SELECT id, arg_max(target, h) AS target FROM w GROUP BY 1)
    SELECT 'c' || l.id AS id, 'c' || l.target AS target, coalesce(a.disposition, CASE WHEN c.c_custkey IS NULL THEN 'dangling' WHEN l.id = l.target THEN 'current' ELSE 'redirected' END) AS outcome
    FROM l LEFT JOIN v_alias_rows a ON a.old_id = l.target LEFT JOIN customer c ON c.c_custkey = l.target""".replace("WITH RECURSIVE", "WITH"), "v_alias_rows")
def tool3_entity_resolve(s, d):
    return ViewStore(s, d).entity_resolve(IDS).rows


SQL["tool3_entity_resolve"] = SQL["tool3_entity_resolve"].replace("WITH ", "WITH RECURSIVE ", 1)


@query(f"""WITH i AS (SELECT unnest(range({len(IDS)})) AS pos, unnest({IDS}) AS id), e AS (SELECT *, entity_id NOT LIKE '%7' AS ok FROM v_entities)
    SELECT pos, id, CASE WHEN e.entity_id IS NULL THEN 'unknown-id' ELSE 'ok' END AS outcome, ok AS allowed, {STUB.format("ok", "id")} AS stub_id, CASE WHEN ok THEN type END AS type, CASE WHEN ok THEN display_name END AS display_name
    FROM i LEFT JOIN e ON e.entity_id = i.id""", "v_entities")
def tool4_entity_read(s, d):
    return ViewStore(s, d).entity_read(IDS).rows.drop("alias")


ASSERTION_IDS = [f"as{k}" for k in (1, 2, 3, 7, 33, 2, 100_000_000, 64, 65)]


@query(f"""WITH i AS (SELECT unnest(range({len(ASSERTION_IDS)})) AS pos, unnest({ASSERTION_IDS}) AS id)
    SELECT pos, id, CASE WHEN a.seq IS NULL THEN 'unknown-id' ELSE 'ok' END AS outcome, {SHOWN} AS allowed, {STUB.format(SHOWN, "id")} AS stub_id, CASE WHEN {SHOWN} THEN predicate END AS predicate,
           CASE WHEN {SHOWN} THEN lineage_action END AS lineage_action, CASE WHEN {SHOWN} THEN superseded_by END AS superseded_by FROM i LEFT JOIN v_assertions a ON a.assertion_id = i.id""", "v_assertions")
def tool6_assertion_read(s, d):
    return ViewStore(s, d).assertion_read(ASSERTION_IDS, True).rows.select("pos", "id", "outcome", "allowed", "stub_id", "predicate", "lineage_action", "superseded_by")


@query(f"""WITH e AS (SELECT seq, assertion_id, subject AS src, target AS dst, {SHOWN} AS ok FROM v_assertions WHERE target IS NOT NULL AND superseded_at IS NULL AND lineage_action <> 'retract'),
    h AS (SELECT 1 AS depth, e.* FROM e WHERE src = 31), g AS (SELECT 2 AS depth, e.* FROM e WHERE src IN (SELECT dst FROM h) AND seq NOT IN (SELECT seq FROM h)),
    p AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY depth, seq) AS r FROM (SELECT * FROM h UNION ALL SELECT * FROM g)) WHERE r <= 200)
    SELECT depth, ok AS allowed, CASE WHEN ok THEN seq END AS seq, CASE WHEN ok THEN dst END AS there, {STUB.format("ok", "assertion_id")} AS stub_id FROM p""", "v_assertions")
def tool7_neighbors(s, d):
    return ViewStore(s, d).graph_neighbors(31, max_depth=2, page_size=200).rows.select("depth", "allowed", "seq", "there", "stub_id")


@query(f"""WITH m AS (SELECT entity_id, type, display_name, entity_id NOT LIKE '%7' AS ok, CASE WHEN lower(display_name) LIKE 'supplier%' THEN 0.8 WHEN contains(lower(display_name), 'supplier') THEN 0.5 ELSE 0 END AS n FROM v_entities),
    t AS (SELECT * FROM m WHERE n > 0 ORDER BY n DESC, entity_id LIMIT 50) SELECT entity_id AS id, ok AS allowed, {STUB.format("ok", "entity_id")} AS stub_id, CASE WHEN ok THEN display_name END AS display_name, CASE WHEN ok THEN n END::DOUBLE AS score FROM t""", "v_entities")
def tool8_text_search(s, d):
    return ViewStore(s, d).text_search("Supplier").rows.select("id", "allowed", "stub_id", "display_name", F.col("score").cast("double").alias("score"))


@query(f"SELECT seq, 'change_e1_' || seq AS change_id, {SHOWN} AS allowed, {STUB.format(SHOWN, 'assertion_id')} AS stub_id, CASE WHEN {SHOWN} THEN value END AS value FROM v_assertions WHERE seq > 40 ORDER BY seq LIMIT 51", "v_assertions")
def tool9_changes(s, d):
    return ViewStore(s, d).changes_read(40, include_records=True).rows.select("seq", "change_id", "allowed", "stub_id", "value")


@query("SELECT 'reader' AS client_id, 'k' || o_orderkey AS idempotency_key, 'sub' || o_orderkey AS submission_id, CAST(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY AS DATE)::VARCHAR AS expires_on FROM orders WHERE o_orderkey = 7")
def tool11_submission(s, d):
    return ViewStore(s, d).submission_read("k7").rows.select("client_id", "idempotency_key", "submission_id", F.col("expires_on").cast("string").alias("expires_on"))


@query(f"SELECT seq, tier, tier_rank FROM v_assertions WHERE assertion_id = (SELECT min(assertion_id) FROM v_assertions WHERE tier = 'sealed')", "v_assertions")
def tool12_reveal(s, d):
    store = ViewStore(s, d)
    hidden = store.log().where("tier = 'sealed'").agg(F.min("assertion_id").alias("id")).select(access.stub_id(READER, F.col("id")).alias("stub")).first().stub
    return store.sensitive_reveal(hidden, "owner asked").rows
