import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from chronoweave.llm.chat import rotate
from chronoweave.llm.common import written
from chronoweave.llm.language import identify
from chronoweave.llm.mixing import TEMPER, cells_of, margin_errors, margins_of, mix, rake
from chronoweave.llm.queries import bpe_path, oracle_sql, queries
from test_dedup import LOWER, brute_components

SF = "/root/testdata/sf0.001"


def test_chat_odd_rows(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", None), (1, 1, "bob", None), (1, 1, None, "tie"), (None, 0, "ann", "x"), (2, None, "bob", ""), (2, 200, "cy", "late")]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, mask string")
    got = {(r.conv_id, r.perspective, r.part): r for r in rotate(turns).collect()}
    ann = got[1, "ann", 0]
    assert ann.text == "<|assistant|>\nhi<|end|>\n<|user name=bob|>\n<|end|>\n<|user name=unknown|>\ntie<|end|>\n"
    assert [ann.text[int(a) : int(b)] for a, b in (x.split("-") for x in ann.mask.split(","))] == ["hi<|end|>\n"]
    assert got[2, "cy", 0].mask == "" and got[2, "cy", 3].turns == 1 and (None, "ann", 0) in got
    assert rotate(turns.where("conv_id > 5")).count() == 0


def test_long_dialogues_carry_context(spark):
    """Every turn is learned from once by its speaker, and a part begins with the end of the one before."""
    said = [(1, k, ("ann", "bob")[k % 2], f"turn {k}") for k in range(200)]
    got = {(r.perspective, r.part): r for r in rotate(spark.createDataFrame(said, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == 8 and sum(r.turns for (who, _), r in got.items() if who == "ann") == 200
    learned = [r.text[int(a) : int(b)] for (who, _), r in got.items() if who == "bob" for a, b in (x.split("-") for x in r.mask.split(","))]
    assert sorted(learned) == sorted(f"turn {k}<|end|>\n" for k in range(1, 200, 2))
    assert got["ann", 1].text.startswith("<|assistant|>\nturn 56<|end|>\n") and got["ann", 0].text.startswith("<|assistant|>\nturn 0<|end|>\n")


def test_raking_meets_the_margins(spark):
    cells = spark.createDataFrame([("a", "x", 100), ("a", "y", 50), ("b", "x", 10), ("b", "y", 40)], "source string, lang string, tokens long")
    got = rake(cells, {"source": 0.5, "lang": 0.0}, rounds=30, rate=0.1).collect()
    total = {k: sum(r.weight for r in got if k in (r.source, r.lang)) for k in "abxy"}
    assert abs(total["x"] - 100) < 1e-6 and abs(total["y"] - 100) < 1e-6
    assert abs(total["a"] / total["b"] - (150 / 50) ** 0.5) < 1e-3


def test_full_cells_pass_on_what_they_cannot_take(spark):
    """Cells that the old formula would clip are full, and the margins are met all the same."""
    cells = spark.createDataFrame([("a", "x", 1000), ("a", "y", 50), ("b", "x", 30), ("b", "y", 300), ("c", "x", 5)], "source string, lang string, tokens long")
    raked = rake(cells, {"source": 0.5, "lang": 0.5}, rounds=60, rate=0.5)
    assert all(r.weight * 0.5 <= r.tokens * (1 + 1e-9) for r in raked.collect()) and any(r.weight * 0.5 > r.tokens * 0.999 for r in raked.collect())
    errors = margin_errors(raked, {"source": 0.5, "lang": 0.5}).collect()
    assert len(errors) == 5 and all(abs(r.expected / r.target - 1) < 1e-3 for r in errors)


@pytest.mark.parametrize("rate", [0.1, 0.5, 0.9])
def test_raking_on_the_driver_equals_window_sums(spark, rate):
    rng = random.Random(int(rate * 10))
    rows = [(f"s{a}", f"l{b}", rng.choice([1, 7, 7, 300, 20000])) for a in range(9) for b in range(7) if rng.random() < 0.7]
    cells = spark.createDataFrame(rows, "source string, lang string, tokens long")
    temper = {"source": 0.5, "lang": 0.0}
    table = lambda held: {(r.source, r.lang): (r.weight, r._source, r._lang) for r in rake(cells, temper, 8, rate, held).collect()}
    near, far = table(100), table(0)
    assert near.keys() == far.keys() == {r[:2] for r in rows}
    assert all(x == pytest.approx(y, rel=1e-9) for k in near for x, y in zip(near[k], far[k]))


def test_the_query_meets_its_margins(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    raked = rake(cells_of(margins_of(docs, "text", TEMPER), TEMPER), TEMPER)
    errors = margin_errors(raked).collect()
    assert {r.margin for r in errors} == set(TEMPER) and all(abs(r.expected / r.target - 1) < 0.01 for r in errors)
    sampled = mix(docs)
    tokens = sampled.agg({"tokens": "sum"}).first()[0]
    assert abs(sampled.selectExpr("sum(tokens * probability)").first()[0] / (0.5 * tokens) - 1) < 0.01


def test_mix_odd_rows(spark, odd, none):
    got = mix(odd).collect()
    assert len(got) == odd.count()
    assert all(0 <= r.probability <= 1 for r in got) and {r.doc_id for r in got if r.probability == 0} == {4, 5, 6}
    assert mix(none).count() == 0


def test_stages_on_odd_and_no_rows(spark, odd, none):
    """Which rows each stage keeps of those that it gets."""
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    docs, kept = odd, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), "test")
        assert docs.columns == odd.columns
        kept.append(ids(docs))
    language, exact, near, mixed = kept
    assert not {4, 5, 6, 7} & set(language) and {1, 2, 3, 8, 9, 10, 14} <= set(language)
    norm = {r.doc_id: (r.text or "").lower() for r in odd.collect()}
    assert exact == sorted({max(j for j in language if norm[j] == norm[k]) for k in language})
    want = brute_components([(k, norm[k]) for k in exact], 5)
    assert near == [k for k in exact if want[k][1] == k]
    assert set(mixed) <= set(near)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted({r.doc_id for r in pieces}) == mixed
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_pipeline_by_brute_force(spark):
    """Every stage's rows from plain Python on what the stage before it kept; the last one's pieces by the tokenizers library."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    found = {r.doc_id: r for r in identify(docs).collect()}
    left = {k for k in text if found[k].lang_pred != "und" and found[k].certainty >= corpus_pipeline.MIN_CERTAINTY}
    assert all(any(c.isalpha() for c in text[k]) for k in left) and len(left) > 0.9 * len(text)
    newest = {}
    for k in sorted(left):
        newest[text[k].translate(LOWER)] = k
    left = set(newest.values())
    component = brute_components([(k, text[k]) for k in left], 5)
    left = {k for k in left if component[k][1] == k}
    db = duckdb.connect()
    source = pd.DataFrame([(r.doc_id, r.text, r.lang, r.source) for r in docs.collect() if r.doc_id in left], columns=["doc_id", "text", "lang", "source"])
    db.register("documents", source)
    left = {r[0] for r in db.execute(f"SELECT doc_id FROM ({oracle_sql()['op9_mixing']}) WHERE kept").fetchall()}
    library, rows = Tokenizer.from_file(bpe_path()), corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == left
    for k in left:
        want = [*library.encode(text[k], add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(want[at : at + r.length], "<u4").tobytes()) and r.doc_tokens == len(want)
            at += r.length
        assert at == len(want)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(oracle_sql()[name]).fetchall()
    columns = [x[0] for x in db.description]
    got = queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want))
