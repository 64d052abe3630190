import json
import random

import pytest
from pyspark.sql import functions as F

from chronoweave.functions import digest, markup
from chronoweave.functions import world_time as wt
from chronoweave.operators import graph, replay, rules, search, sync
from chronoweave.sources import segment_log
from chronoweave.streaming import feed


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_partial_dates(spark):
    low = lambda k, v: str(one(spark, wt.lower_bound(F.lit(k), F.lit(v)))[0])
    assert low("exact", "2019") == "2019-01-01" and low("approximate", "2019") == "2018-01-01"
    assert low("approximate", "2020-01") == "2019-12-01" and low("approximate", "2020-03-01") == "2020-02-29"
    assert low("exact", "2019-02-31") == "2019-03-03" and low("unknown", None) == "None"
    assert str(one(spark, wt.upper_bound(F.lit("2020-02")))[0]) == "2020-03-01"
    ok = {v: one(spark, wt.valid_mixed_date(F.lit(v)))[0] for v in ("unknown", "2020", "~2020-02", "2020-02-30", "20-1", "2020-13")}
    assert ok == {"unknown": True, "2020": True, "~2020-02": True, "2020-02-30": False, "20-1": False, "2020-13": False}
    assert [one(spark, wt.date_key(F.lit(v).cast("string")))[0] for v in ("~2020", None, "unknown")] == ["2020", "9999", "9999"]


def test_canonical_json(spark):
    cases = {'{"b": 1.0, "a": null}': '{"a":null,"b":1}', "[1e21, 1e-7, 0.1, -0.0]": "[1e+21,1e-7,0.1,0]", '{"\\ud83d\\ude00": 1, "\\uffff": 2}': '{"😀":1,"￿":2}', "null": "null", "{bad": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", digest.canonical_json("t").alias("c")).collect()
    assert {r.t: r.c for r in rows} == cases
    assert one(spark, digest.normal_query(F.lit("  Ｆull　Width ")))[0] == "full width"
    assert one(spark, digest.time_id(F.lit(32)))[0] == "0000000010"
    masked = one(spark, digest.redact_json("token")(F.lit('{"a": [{"apiToken": {"x": 1}}], "b": 2}')))[0]
    assert json.loads(masked) == {"a": [{"apiToken": "[redacted]"}], "b": 2}


def test_markup(spark):
    text = "# Title\n\nkey:: value\n- **Role:** boss\n  of all\nplain\n\nsource:: web"
    units = one(spark, markup.segments(F.lit(text)))[0]
    assert units == ["# Title", "key:: value", "- **Role:** boss of all plain", "source:: web"]
    kinds = [r.k for r in spark.createDataFrame([(u,) for u in units], "u string").select(markup.segment_kind(F.col("u")).alias("k")).collect()]
    assert kinds == ["entity", "attribute", "relationship", "provenance"]
    titles = one(spark, markup.title_units(F.lit("[[Ann]] (cto · x) · Bob")))[0]
    assert [(t["name"], t["note"]) for t in titles] == [("Ann", "cto · x"), ("Bob", None)]
    hints = {h: one(spark, markup.affiliation(F.lit(h)).alias("a")).a for h in ("Board President", "co-founder", "CTO", "alumni", "pal")}
    assert [hints[h].predicate for h in hints] == ["member-of", "founder-of", "employed-by", "member-of", None] and hints["Board President"].role == "board-member"
    assert hints["Board President"].confidence == "high" and hints["pal"].confidence == "needs-review"
    roles = ("working group", "cto", "head of sales", "Alumna", "co founder & CEO", "trusteeship", "boardroom", "advisory board")
    assert [one(spark, markup.affiliation(F.lit(h)).alias("a")).a.predicate for h in roles] == [None, "employed-by", "employed-by", "member-of", "founder-of", None, None, "member-of"]
    nested = one(spark, markup.title_units(F.lit("A (b [c · d] · e) · [[F]] · (g) · ")))[0]
    assert [(t["name"], t["note"]) for t in nested] == [("A", "b [c · d] · e"), ("F", None), ("(g)", None)]
    left_out = {"- **Context**": "source organization", "- **Relationship to [[Ann]]**": "source organization", "type:: query": "source-system instruction", "- see {{query x}}": "source-system instruction", "(initial stub)": "editorial migration commentary", "- **Phone:** 1": None}
    assert {u: one(spark, markup.exclusion(F.lit(u)))[0] for u in left_out} == left_out
    chunks = one(spark, markup.evidence_chunks(F.lit("a" * 4000 + "\n" + "b" * 5000)))[0]
    assert "".join(chunks) == "a" * 4000 + "\n" + "b" * 5000 and max(map(len, chunks)) <= 4096 and chunks[0].endswith("\n")


def test_redirects(spark):
    rows = [(k, k + 1, "mapped") for k in range(1, 33)] + [(100, 101, "mapped"), (101, 100, "mapped"), (200, 999, "mapped"), (300, None, "ambiguous-split"), (400, None, "terminal"), (401, 400, "mapped")]
    ids = spark.createDataFrame([(x,) for x in (1, 2, 33, 100, 200, 300, 400, 401, 50)], "id long")
    live = spark.createDataFrame([(33,), (50,)], "id long")
    got = {r.id: (r.target, r.outcome) for r in graph.resolve(spark.createDataFrame(rows, "old_id long, new_id long, disposition string"), ids, live).collect()}
    assert got[1] == (33, "redirected") and got[33] == (33, "current") and got[100][1] == "cycle-or-depth"
    assert got[200] == (999, "dangling") and got[300][1] == "ambiguous-split" and got[401] == (400, "terminal") and got[50][1] == "current"


def test_redirects_up_to_a_depth(spark):
    rows = spark.createDataFrame([(k, k + 1, "mapped") for k in range(1, 18)], "old_id long, new_id long, disposition string")
    ids, live = (spark.createDataFrame([(x,) for x in xs], "id long") for xs in ((1, 2, 17), (18,)))
    at = lambda hops: {r.id: (r.target, r.outcome) for r in graph.resolve(rows, ids, live, hops).collect()}
    assert at(16) == {1: (17, "cycle-or-depth"), 2: (18, "redirected"), 17: (18, "redirected")}
    assert at(32)[1] == (18, "redirected") and at(1)[2] == (3, "cycle-or-depth")
    with pytest.raises(ValueError, match="power of two"):
        graph.resolve(rows, ids, live, 12)


def most_rows(df):
    """The most rows that an operator of the executed plan made."""

    def walk(node):
        inner = [node.executedPlan()] if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else [node.plan()] if node.getClass().getSimpleName().endswith("QueryStageExec") else []
        children = [node.children().apply(i) for i in range(node.children().size())]
        made = node.metrics().get("numOutputRows")
        return max([made.get().value() if made.isDefined() else 0, *map(walk, inner + children)])

    return walk(df._jdf.queryExecution().executedPlan())


TRAIT_ROWS = "id string, trait string, value string"


def test_reidentify_makes_no_pairs(spark):
    known = [(f"k{i}", t, v) for i in range(400) for t, v in (("type", "common"), ("size", "common"), ("name", f"n{i}"), ("brand", f"b{i // 2}"))]
    observed = [(f"o{i}", t, v) for i in range(400) for t, v in (("type", "common"), ("size", "common"), ("name", f"n{i}" if i % 2 else "none"), ("brand", f"b{i // 2}" if i < 4 else "none"))]
    df = sync.reidentify(spark.createDataFrame(observed, TRAIT_ROWS), spark.createDataFrame(known, TRAIT_ROWS), 3)
    got = {r.id: (r.decision, r.entity) for r in df.collect()}
    assert got["o0"] == got["o1"] == ("ambiguous", None) and got["o4"] == ("mint", None) and got["o399"] == ("carry", "k399")
    assert len(got) == 400 and most_rows(df) <= 4 * len(observed)


def test_reidentify_splits_a_frequent_set(spark):
    """One set of traits that all observed ids have is not left to one task."""
    known = [(f"k{i}", t, f"{t}{i}") for i in range(50) for t in ("a", "b")]
    observed = [(f"o{i}", t, f"{t}1") for i in range(3000) for t in ("a", "b")]
    adaptive = "spark.sql.adaptive."
    tight = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", adaptive + "autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8", adaptive + "coalescePartitions.enabled": "false",
        adaptive + "advisoryPartitionSizeInBytes": "1k", adaptive + "skewJoin.skewedPartitionThresholdInBytes": "1k", adaptive + "skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k, None) for k in tight}
    try:
        for k, v in tight.items():
            spark.conf.set(k, v)
        df = sync.reidentify(spark.createDataFrame(observed, TRAIT_ROWS), spark.createDataFrame(known, TRAIT_ROWS), 2)
        assert {(r.decision, r.entity) for r in df.collect()} == {("carry", "k1")}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("minimum", [1, 2, 3])
def test_reidentify_equals_all_pairs(spark, minimum):
    """Ids of few and of many traits, repeated rows, values that are null."""
    rng = random.Random(minimum)

    def rows(side, n):
        out = [(f"{side}{i}", rng.choice("abcd"), rng.choice([None, *"01234567"])) for i in range(n) for _ in range(rng.choice([1, 2, 3, 4, 4, 25]))]
        return out + out[:9]

    observed, known = rows("o", 50), rows("k", 30)
    held = {}
    for side in (observed, known):
        for i, t, v in side:
            held.setdefault(i, set()).update([(t, v)] if v is not None else [])
    want = {}
    for i in {r[0] for r in observed}:
        hits = [k for k in {r[0] for r in known} if len(held[i] & held[k]) >= minimum]
        want[i] = ("mint", None) if not hits else ("carry", hits[0]) if len(hits) == 1 else ("ambiguous", None)
    got = sync.reidentify(spark.createDataFrame(observed, TRAIT_ROWS), spark.createDataFrame(known, TRAIT_ROWS), minimum)
    assert {r.id: (r.decision, r.entity) for r in got.collect()} == want


def test_neighbors_directions_and_page(spark):
    edges = spark.createDataFrame([(1, "a", "p", "b", "assert"), (2, "b", "p", "c", "invalidate"), (3, "c", "p", "a", "assert"), (4, "b", "q", "d", "retract"), (5, "a", "q", "c", "correct")], "seq long, src string, predicate string, dst string, lineage_action string")
    start = spark.createDataFrame([("a", "a")], "origin string, node string")
    seqs = lambda **k: [(r.depth, r.seq) for r in graph.neighbors(edges, start, **k).orderBy("depth", "seq").collect()]
    assert seqs(max_depth=1) == [(1, 1), (1, 5)]
    assert seqs(max_depth=5) == [(1, 1), (1, 5), (2, 2), (2, 3)]
    assert seqs(max_depth=1, direction="inbound") == [(1, 3)] and seqs(max_depth=3, predicates=("q",)) == [(1, 5)]
    assert seqs(max_depth=5, page_size=3) == [(1, 1), (1, 5), (2, 2)]
    with pytest.raises(ValueError):
        graph.neighbors(edges, start, max_depth=6)


def test_resolution_fold(spark):
    rows = [(1, 1, "merge", "a", "b"), (1, 2, "merge", "b", "a"), (1, 3, "merge", "b", "c"), (1, 4, "split", "a", ""), (2, 1, "merge", "x", "y")]
    got = {(r.authority, r.member): r.into for r in graph.replay_resolutions(spark.createDataFrame(rows, "authority long, pos long, decision string, member string, into string")).collect()}
    assert got == {(1, "b"): "c", (2, "x"): "y"}


def test_sequencer(spark):
    rows = [(1, 1, 10, 0, 1), (1, 2, 10, 0, 1), (1, 3, 11, 0, 1), (1, 4, 12, 2, 3), (1, 5, 13, 1, 2)]
    got = [r.outcome for r in sync.sequencer(spark.createDataFrame(rows, "authority long, pos long, batch_id long, base long, target long")).orderBy("pos").collect()]
    assert got == ["accepted", "duplicate", "stale-generation", "generation-gap", "accepted"]


def test_stride_sample(spark):
    rows = spark.range(103).toDF("k")
    got = sorted(r.k for r in sync.stride_sample(rows, "k", 7, 103).collect())
    assert got == [i * 103 // 7 for i in range(7)]


def test_vocabulary_and_rate(spark):
    got = {r.name: (r.canonical, r.source) for r in rules.canonical_predicates(spark.createDataFrame([("works-at",), ("owns",), ("manages",), ("advises",), ("zzz",)], "name string"), "name").collect()}
    assert got == {"works-at": ("employed-by", "safe-alias"), "owns": ("owns", "canonical"), "manages": (None, "direction-unsafe"), "advises": (None, "retired"), "zzz": (None, "unknown")}
    tier = lambda t: one(spark, search.tier_of(F.lit(t), (("sealed", ("secret",)),)))[0]
    assert [tier(x) for x in ("a Secret.", "secrets", "secretary", "ésecret")] == ["sealed", "sealed", "open", "open"]


def test_segment_log(spark, tmp_path):
    record = lambda kind, segment, pos, **k: {"record": kind, "segment": segment, "pos": pos, **k}
    rows = [
        record("header", 1, 0), record("assertion", 1, 1, submission_id="s1", assertion_id="a", seq=1), record("submission", 1, 2, submission_id="s1"),
        record("assertion", 1, 3, submission_id="s2", assertion_id="b", seq=2), record("supersession", 1, 4, submission_id="s2", assertion_id="a", superseded_at="2026-01-02", superseded_by="b"), record("submission", 1, 5, submission_id="s2"),
        record("supersession", 2, 1, submission_id="s3", assertion_id="a", superseded_at="2026-01-03", superseded_by="c"), record("submission", 2, 2, submission_id="s3"),
        record("assertion", 2, 3, submission_id="s4", assertion_id="lost", seq=3),
    ]
    path = tmp_path / "log"
    path.mkdir()
    (path / "1.jsonl").write_text("\n".join(map(json.dumps, rows)) + '\n{"record": "asser')
    log = segment_log.read(spark, str(path))
    got = {r.assertion_id: r for r in segment_log.folded(log).collect()}
    assert set(got) == {"a", "b"} and got["a"].superseded_by == "b" and got["a"].conflicting and not got["b"].conflicting
    segment_log.append(spark.createDataFrame([("submission", 2, 4, "s4")], "record string, segment int, pos long, submission_id string"), str(path))
    assert {r.assertion_id for r in segment_log.folded(segment_log.read(spark, str(path))).collect()} == {"a", "b", "lost"}
    assert {r.segment: r.reason for r in segment_log.compactable(log, "2026-06-01", 10).collect()} == {1: "still-believed", 2: "open"}
    (path / "2.jsonl").write_text('{"record": "surprise"}\n')
    with pytest.raises(segment_log.LogDamaged):
        segment_log.read(spark, str(path))


def test_streamed_commits(spark, tmp_path):
    source, receipts, outcomes = (str(tmp_path / x) for x in ("in", "receipts", "out"))
    schema = "event_id long, client_id string, idempotency_key string, request_digest string"
    spark.createDataFrame([], "client_id string, idempotency_key string, request_digest string, batch long").write.partitionBy("batch").parquet(receipts)
    for rows in ([(1, "c", "k", "x"), (2, "c", "k", "x"), (3, "c", "k", "y")], [(4, "c", "k", "x"), (5, "c", "k2", "x"), (6, "d", "k", "z")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = stream.writeStream.foreachBatch(feed.committer(receipts, outcomes)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.event_id: r.outcome for r in spark.read.parquet(outcomes).collect()}
    assert got == {1: "fresh", 2: "replay", 3: "conflict", 4: "replay", 5: "fresh", 6: "fresh"}


def test_streamed_rate_windows(spark, tmp_path):
    rows = spark.sql("SELECT timestamp_seconds(1700000000 + id) AS ts, concat('c', id % 2) AS client_id FROM range(200)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = feed.rate_windows(stream, 20).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT sum(calls) FROM rates").first()[0] == 200 and spark.sql("SELECT bool_or(limited) FROM rates").first()[0]


def test_change_feed(spark):
    log = spark.range(1, 11).select(F.col("id").alias("seq"), F.concat(F.lit("a"), F.col("id").cast("string")).alias("assertion_id"))
    assert [r.seq for r in feed.read_changes(log, 6, 2, "e1").collect()] == [7, 8, 9]
    with pytest.raises(ValueError):
        feed.read_changes(log, 0, 2, "e1", expected="e2")


def test_flags(spark):
    rows = [("o1", "activity", "remote", None, True, False, "allow", None, None), ("o2", "audit", "local", "k", False, True, "deny", None, None), ("o3", "operational", "local", None, False, True, None, "server-error", "info")]
    rows = [(f"e{k}", "2026-01-01", "x", *r) for k, r in enumerate(rows)]
    schema = "source_event_id string, recorded_at string, action string, operation_id string, stream string, plane string, touched string, contains_sensitive boolean, redacted boolean, policy_decision string, outcome string, severity string"
    got = {(r.operation_id, r.code) for r in replay.findings(replay.operations(spark.createDataFrame(rows, schema))).collect()}
    assert got == {("o1", "missing-durable-audit"), ("o1", "remote-sensitive-touch"), ("o2", "audit-without-activity"), ("o2", "policy-denied"), ("o3", "operational-only"), ("o3", "operational-error")}


def test_bait_scan_finds_any_substring(spark):
    texts = [(1, "a secret in the text"), (2, "foo bar baz"), (3, None), (4, "x" * 200_000 + "needle"), (5, ""), (6, "\u00e9\u00e9 sec secret secret")]
    needles = [(10, "secret"), (11, "foo bar baz"), (12, "needle"), (13, "sec"), (14, ""), (15, None), (16, "secret"), (17, "x" * 10)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    wanted = spark.createDataFrame(needles, "item_id long, text string")
    want = sorted((k, i, t.find(n)) for k, t in texts if t for i, n in needles if n and n in t)
    for a_pass in (50_000, 3):
        assert sorted(map(tuple, search.bait_scan(docs, wanted, a_pass=a_pass).collect())) == want
    assert search.bait_scan(docs, wanted.where("item_id > 99")).count() == 0


def test_normal_query_of_whole_documents(spark):
    import unicodedata

    from chronoweave.plans.more_queries import t18_query_normalization

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r.q for r in t18_query_normalization(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert got[r.doc_id] == (None if r.text is None else " ".join(unicodedata.normalize("NFKC", r.text).split()).lower())
