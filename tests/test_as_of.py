"""The golden as-of corpus: nine claims about one subject and the pinned answers."""

import pytest

from chronoweave.functions import access
from chronoweave.operators import assertions as asr
from chronoweave.operators.assertions import AssertionQuery, QueryRefused

T = {k: f"2026-02-0{k}" for k in range(1, 7)} | {7: "2026-03-01", 8: "2026-04-01", 9: "2026-05-01"}
CLAIMS = [
    ("exact-closed-span", "worked-at", "exact", "2019-01", "exact", "2022-01", 1), ("approximate-year-ongoing", "worked-at", "approximate", "2019", None, None, 2),
    ("unknown-start", "worked-at", "unknown", None, None, None, 3), ("no-world-time", "worked-at", None, None, None, None, 4),
    ("exact-single-day", "attended", "exact", "2020-06-15", "exact", "2020-06-16", 5), ("approximate-month", "attended", "approximate", "2020-06", "exact", "2020-08", 6),
    ("belief-v1", "job-title", "exact", "2019-01", None, None, 7), ("belief-v2", "job-title", "exact", "2019-01", None, None, 8), ("sealed-note", "medical-note", "exact", "2021-03", None, None, 9),
]
FLOOR = "2026-01-01"


@pytest.fixture(scope="module")
def claims(spark):
    rows = []
    for seq, (label, predicate, fk, fv, tk, tv, t) in enumerate(CLAIMS, 1):
        sealed = label == "sealed-note"
        old = label == "belief-v1"
        rows.append((seq, label, "fact", "correct" if label == "belief-v2" else "assert", 1, predicate, None, T[t], T[8] if old else None, 8 if old else None, fk, fv, tk, tv, "me", "sealed" if sealed else "open", 90 if sealed else 10, sealed))
    schema = "seq long, assertion_id string, kind string, lineage_action string, subject long, predicate string, target long, recorded_at string, superseded_at string, superseded_by long, from_kind string, from_value string, to_kind string, to_value string, client_id string, tier string, tier_rank int, withheld boolean"
    return spark.createDataFrame(rows, schema)


ALL = [c[0] for c in CLAIMS]
CASES = {
    "present-all": ({}, [x for x in ALL if x != "belief-v1"]),
    "valid-2019": ({"as_of_valid": "2019"}, ["exact-closed-span c", "approximate-year-ongoing p", "belief-v2 c"]),
    "valid-2018": ({"as_of_valid": "2018"}, ["approximate-year-ongoing p"]),
    "valid-2022": ({"as_of_valid": "2022"}, ["approximate-year-ongoing p", "belief-v2 c", "sealed-note c"]),
    "valid-2021-12": ({"as_of_valid": "2021-12"}, ["exact-closed-span c", "approximate-year-ongoing p", "belief-v2 c", "sealed-note c"]),
    "valid-2025-ongoing": ({"as_of_valid": "2025"}, ["approximate-year-ongoing p", "belief-v2 c", "sealed-note c"]),
    "unknown-never-matches": ({"as_of_valid": "2100"}, ["approximate-year-ongoing p", "belief-v2 c", "sealed-note c"]),
    "valid-day-inside": ({"predicate": "attended", "as_of_valid": "2020-06-15"}, ["exact-single-day c", "approximate-month p"]),
    "valid-day-at-upper-bound": ({"predicate": "attended", "as_of_valid": "2020-06-16"}, ["approximate-month p"]),
    "valid-month-widened-lower": ({"predicate": "attended", "as_of_valid": "2020-05"}, ["approximate-month p"]),
    "valid-month-outside": ({"predicate": "attended", "as_of_valid": "2020-04"}, []),
    "belief-at-T7": ({"predicate": "job-title", "as_of_recorded": T[7]}, ["belief-v1"]),
    "belief-at-T8": ({"predicate": "job-title", "as_of_recorded": T[8]}, ["belief-v2"]),
    "belief-at-T9": ({"predicate": "job-title", "as_of_recorded": T[9]}, ["belief-v2"]),
    "belief-and-world-together": ({"predicate": "job-title", "as_of_valid": "2019", "as_of_recorded": T[7]}, ["belief-v1 c"]),
    "sealed-row": ({"predicate": "medical-note"}, ["sealed-note"]),
    "include-superseded-at-T8": ({"predicate": "job-title", "as_of_recorded": T[8], "include_superseded": True}, ["belief-v1", "belief-v2"]),
    "include-superseded-present": ({"predicate": "job-title", "include_superseded": True}, ["belief-v1", "belief-v2"]),
}


@pytest.mark.parametrize("name", CASES)
def test_golden_answers(claims, name):
    args, want = CASES[name]
    got = asr.query(claims, AssertionQuery(**args), FLOOR).orderBy("seq").collect()
    marked = bool(want) and want[0][-2:] in (" c", " p")
    assert [r.assertion_id + (f" {r.match[0]}" if marked else "") for r in got] == want


def test_belief_before_the_floor_is_refused(claims):
    with pytest.raises(QueryRefused, match="as-of-before-history-floor"):
        asr.query(claims, AssertionQuery(as_of_recorded="2025-06-01"), FLOOR)


def test_coverage_reconciles(claims):
    got = asr.coverage(claims, AssertionQuery(), access.Grant("reader")).first()
    assert (got.evaluated, got.matched, got.withheld, got.with_valid_time, got.unknown_or_absent) == (9, 8, 1, 6, 2)


def test_withheld_rows_keep_their_place(claims):
    rows = asr.with_access(asr.query(claims, AssertionQuery(), FLOOR), access.Grant("reader"), ("assertion_id", "predicate")).orderBy("seq").collect()
    assert len(rows) == 8 and rows[-1].assertion_id is None and rows[-1].stub_id.startswith("redaction_") and rows[-1].disclosure_level == "existence-only"
    other = asr.with_access(claims, access.Grant("other"), ("assertion_id",)).where("NOT allowed").first()
    assert other.stub_id != rows[-1].stub_id


def test_contested_and_paging(claims):
    assert asr.contested(asr.believed(claims, None, True), claims["recorded_at"]).first().ids == "belief-v1,belief-v2"
    assert [r.seq for r in asr.page(claims, 3, 2).collect()] == [4, 5]
    assert asr.page(claims, None, 10_000).count() == 9
