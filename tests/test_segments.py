import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import chain
from chronoweave.sources import segment_files as sf
from chronoweave.sources.segment_log import LogDamaged, compactable


def head(n, epoch="e1", form=sf.FORMAT):
    return {"record": "header", "log_format": form, "feed_epoch": epoch, "segment_ordinal": n}


def group(n, closed=True):
    rows = [{"record": "assertion", "submission_id": f"s{n}", "assertion_id": f"a{n}", "seq": n, "recorded_at": f"2026-01-{n:02d}"}]
    return rows + ([{"record": "submission", "submission_id": f"s{n}", "client_id": "c", "idempotency_key": f"k{n}"}] if closed else [])


def save(path, segments):
    """``segments``: ordinal -> rows, or bytes as they are."""
    for n, rows in segments.items():
        os.makedirs(f"{path}/segment={n}")
        with open(f"{path}/segment={n}/part-0.txt", "wb") as f:
            f.write(rows if isinstance(rows, bytes) else b"".join(json.dumps(r).encode() + b"\n" for r in rows))
    return str(path)


def test_a_whole_log(spark, tmp_path):
    path = save(tmp_path, {1: [head(1), *group(1), *group(2)], 2: [head(2), *group(3)]})
    records, repairs = sf.scan_segments(spark, path, "e1")
    assert sorted(r.seq for r in records.where("record = 'assertion'").collect()) == [1, 2, 3] and repairs.count() == 0


def test_only_the_tail_is_repaired(spark, tmp_path):
    torn = b"".join(json.dumps(r).encode() + b"\n" for r in [head(2), *group(2), *group(3, closed=False)]) + b'{"record": "asse'
    records, repairs = sf.scan_segments(spark, save(tmp_path, {1: [head(1), *group(1)], 2: torn}))
    assert sorted(r.seq for r in records.where("record = 'assertion'").collect()) == [1, 2]
    got = {r.reason: r for r in repairs.collect()}
    assert set(got) == {"torn-tail", "incomplete-commit"} and got["torn-tail"].discarded_bytes == 16
    assert got["torn-tail"].discarded_digest == "sha256:" + hashlib.sha256(b'{"record": "asse').hexdigest()


@pytest.mark.parametrize("code, segments", [
    ("empty-segment", {1: b"", 2: [head(2), *group(1)]}),
    ("torn-record-mid-log", {1: json.dumps(head(1)).encode() + b"\n{", 2: [head(2)]}),
    ("corrupt-record", {1: json.dumps(head(1)).encode() + b"\n{oops\n" + json.dumps(group(1)[0]).encode() + b"\n"}),
    ("corrupt-record", {1: [head(1), {"record": "assertion", "submission_id": "s"}]}),
    ("unknown-record-kind", {1: [head(1), {"record": "novelty"}]}),
    ("missing-header", {1: group(1)}),
    ("format-mismatch", {1: [head(1, form="other"), *group(1)]}),
    ("ordinal-mismatch", {1: [head(4), *group(1)]}),
    ("feed-epoch-mismatch", {1: [head(1, "e0"), *group(1)]}),
    ("incomplete-commit-mid-log", {1: [head(1), *group(1, closed=False), *group(2)]}),
])
def test_everything_else_is_refused(spark, tmp_path, code, segments):
    with pytest.raises(LogDamaged, match=code):
        sf.scan_segments(spark, save(tmp_path, segments), "e1")


def test_written_segments_roll_and_read_back(spark, tmp_path):
    rows = [r for n in range(1, 201) for r in group(n)]
    records = spark.createDataFrame([json.dumps(r | {"pos": k}) for k, r in enumerate(rows)], "string").select(F.from_json("value", sf.RECORD).alias("r")).select("r.*")
    path = str(tmp_path / "log")
    sf.write_segments(records, path, "e1", roll_bytes=4096)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("path", "length").collect()
    assert len(files) > 5 and all(r.length <= 4096 for r in files)
    got, repairs = sf.scan_segments(spark, path, "e1")
    assert sorted(r.seq for r in got.where("record = 'assertion'").collect()) == list(range(1, 201)) and repairs.count() == 0


def test_compaction_carries_receipts(spark, tmp_path):
    stamp = {"record": "supersession", "submission_id": "s2", "assertion_id": "a1", "superseded_at": "2026-01-02", "superseded_by": "a2"}
    path = save(tmp_path, {1: [head(1), *group(1)], 2: [head(2), group(2)[0], stamp, group(2)[1]]})
    records, _ = sf.scan_segments(spark, path)
    records = records.withColumn("pos", F.col("line_no").cast("long"))
    verdict = compactable(records, "2026-02-01", 2)
    assert {r.segment: r.reason for r in verdict.collect()} == {1: "reclaim", 2: "open"}
    left = [(r.record, r.assertion_id, r.submission_id) for r in sf.compacted(records, verdict).collect()]
    assert ("submission", None, "s1") in left and ("compaction", "a1", "s1") in left and ("assertion", "a1", "s1") not in left and ("assertion", "a2", "s2") in left


def test_hash_chain(spark):
    rows = chain.linked([f"entry {k}" for k in range(1, 6)])
    good = spark.createDataFrame([(k, *r) for k, r in enumerate(rows, 1)], "n long, content string, previous_hash string, event_hash string")
    assert chain.faults(good).count() == 0
    more = chain.appended(good, ["six", "seven"], rows[-1][2])
    assert chain.faults(good.union(more)).count() == 0 and [r.n for r in more.collect()] == [6, 7]
    with pytest.raises(chain.ChainMoved):
        chain.appended(good, ["late"], rows[2][2])
    changed = good.withColumn("content", F.when(F.col("n") == 3, "forged").otherwise(F.col("content")))
    assert [(r.n, r.fault) for r in chain.faults(changed).collect()] == [(3, "hash-mismatch")]
    assert [(r.n, r.fault) for r in chain.faults(good.where("n <> 3")).collect()] == [(4, "gap")]
    forged = good.withColumn("event_hash", F.when(F.col("n") == 3, F.lit("f" * 64)).otherwise(F.col("event_hash")))
    assert [(r.n, r.fault) for r in chain.faults(forged).orderBy("n").collect()] == [(3, "hash-mismatch"), (4, "previous-mismatch")]
