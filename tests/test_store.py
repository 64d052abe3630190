from chronoweave.functions.access import Grant
from chronoweave.operators.assertions import AssertionQuery
from chronoweave.store import GraphStore


def test_tools_end_to_end(spark, tmp_path):
    store = GraphStore.create(spark, str(tmp_path / "store"), Grant("me"), floor="2026-01-01")
    store.entity_create("c1", "person", "Ann", "annie", "2026-01-01")
    assert store.entity_rename("c1", "Ann", "2026-01-02").facts["outcome"] == "unchanged"
    assert store.entity_rename("c1", "Anna", "2026-01-02").facts["outcome"] == "renamed"
    assert store.entity_rename("zz", "x", "2026-01-02").refusal == "unknown-entity"
    drafts = [{"subject": 1, "predicate": "job-title", "value": "dev", "from_kind": "exact", "from_value": "2020"}, {"subject": 1, "predicate": "knows", "target": 2, "kind": "relationship"}, {"subject": 2, "predicate": "knows", "target": 3, "kind": "relationship", "tier": "sealed", "tier_rank": 90, "withheld": True}]
    assert store.assertion_propose("k1", drafts, "2026-02-01").facts["seqs"] == [1, 2, 3]
    assert store.assertion_propose("k1", drafts, "2026-02-02").facts["outcome"] == "replay"
    assert store.assertion_propose("k1", drafts[:1], "2026-02-02").refusal == "idempotency-conflict"
    assert store.assertion_propose("k2", [{"subject": 1, "predicate": "job-title", "value": "lead", "supersedes": 1, "lineage_action": "correct"}], "2026-03-01").facts["seqs"] == [4]
    assert store.assertion_propose("k3", [{"subject": 1, "predicate": "x", "supersedes": 99}], "2026-03-01").refusal == "unknown-superseded-id"
    now = store.assertion_query(AssertionQuery(subject=1, predicate="job-title"))
    assert [r.value for r in now.rows.collect()] == ["lead"] and now.facts["evaluated"] == 2 and now.facts["matched"] == 1
    then = store.assertion_query(AssertionQuery(subject=1, predicate="job-title", as_of_recorded="2026-02-15"))
    assert [r.value for r in then.rows.collect()] == ["dev"]
    assert store.assertion_query(AssertionQuery(as_of_recorded="2025-01-01")).refusal == "as-of-before-history-floor"
    everything = store.assertion_query(AssertionQuery()).rows.collect()
    hidden = [r for r in everything if not r.allowed]
    assert len(everything) == 3 and len(hidden) == 1 and hidden[0].subject is None
    assert store.sensitive_reveal(hidden[0].stub_id, "audit").rows.first().tier == "sealed" and store.sensitive_reveal("x", "").refusal
    walk = store.graph_neighbors(1, max_depth=2)
    assert [(r.depth, r.allowed, r.seq, r.there) for r in walk.rows.orderBy("depth").collect()] == [(1, True, 2, 2), (2, False, None, None)]
    assert walk.facts == {"withheld": 1, "truncated_by": "policy", "deepest": 2} and walk.rows.where("NOT allowed").first().stub_id.startswith("redaction_")
    assert store.graph_neighbors(1, max_depth=2, page_size=1).facts["truncated_by"] == "page_size"
    assert store.graph_neighbors(1, max_depth=1).facts["truncated_by"] == "max_depth"
    feed = store.changes_read(0, 10, include_records=True)
    assert [(r.seq, r.allowed, r.value) for r in feed.rows.orderBy("seq").collect()] == [(1, True, "dev"), (2, True, None), (3, False, None), (4, True, "lead")] and feed.facts["withheld"] == 1
    assert [r.display_name for r in store.text_search("ann").rows.collect()] == ["Anna"]
    assert [(r.outcome, r.display_name) for r in store.entity_read(["c1", "no", "c1"]).rows.orderBy("pos").collect()] == [("ok", "Anna"), ("unknown-id", None), ("ok", "Anna")]
    assert [r.outcome for r in store.entity_resolve(["c1", "zz"]).rows.orderBy("id").collect()] == ["current", "dangling"]
    assert [r.outcome for r in store.assertion_read(["as1", "as3", "as9"], True).rows.orderBy("pos").collect()] == ["ok", "ok", "unknown-id"]
    assert [r.seq for r in store.changes_read(1, 2).rows.collect()] == [2, 3, 4] and store.changes_read(1, epoch="old").refusal == "feed-epoch-mismatch"
    assert str(store.submission_read("k1").rows.first().expires_on) == "2026-03-03"
    assert store.contract_describe().rows.count() == 2 and store.scope_describe().facts["ceiling"] == 10
    other = GraphStore(spark, store.path, Grant("other"))
    assert other.assertion_propose("k1", [{"subject": 1, "predicate": "job-title", "supersedes": 4}], "2026-04-01").refusal == "supersession-not-permitted"
