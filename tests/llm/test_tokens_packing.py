import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoweave.llm.bpe import encoder
from chronoweave.llm.packing import Bm25Shard, pack, pack_shard
from chronoweave.llm.queries import bpe_path
from chronoweave.llm.tokens import encode_resync, token_counts

ALPHABET = ["'s", "'re", "'", " ", "  ", "\n", "\t", "a", "bc", "É", "ß", "1", "23", "٣", "。", "中文", "́", "\xa0", " ", "!", "<|endoftext|>", "😀", "\x85", "'LL", "'sx", "\r\n", "_", "\x1c", "​"]


@pytest.fixture(scope="module")
def enc():
    return encoder(bpe_path())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=14).map("".join))
def test_ids_equal_the_library(text):
    e = encoder(bpe_path())
    assert e.encode([text])[0].tolist() == e.library.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_any_unicode(text):
    e = encoder(bpe_path())
    assert e.encode([text])[0].tolist() == e.library.encode(text, add_special_tokens=False).ids


def test_memo_overflow(enc):
    small = type(enc)(bpe_path(), memo_limit=5)
    texts = ["a few different words", "and some others too", "a few more"]
    for x in texts:
        assert small.encode([x])[0].tolist() == enc.encode([x])[0].tolist()


@pytest.mark.parametrize("text", ["word " * 900, "x" * 5000, "né <|endoftext|> ü" * 300, " \n" * 2000, "a1 b2-c3's " * 500, "中文字。" * 800])
def test_resync_equals_one_call(enc, text):
    whole = enc.library.encode(text, add_special_tokens=False).ids
    for chunk, overlap in ((300, 8), (64, 2), (1000, 128)):
        assert encode_resync(enc, text, chunk, overlap).tolist() == whole


def test_resync_random(enc):
    rnd = random.Random(3)
    text = "".join(rnd.choice(ALPHABET) for _ in range(4000))
    assert encode_resync(enc, text, 200, 4).tolist() == enc.library.encode(text, add_special_tokens=False).ids


def test_counts_of_odd_rows(spark, odd, none, enc):
    got = {(r.doc_id, r.n_bytes): r for r in token_counts(odd, bpe_path()).collect()}
    for r in odd.collect():
        text = r.text or ""
        row = got[r.doc_id, len(text.encode())]
        assert row.n_tokens == len(enc.library.encode(text, add_special_tokens=False).ids)
        assert row.over_limit == (row.n_tokens > 512)
    assert token_counts(odd, bpe_path()).count() == odd.count()
    assert token_counts(none, bpe_path()).count() == 0


def check_packing(rows, docs, enc, window):
    pieces, sequences = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    total = sum(r.length for r in rows)
    assert total == sum(len(enc.encode([d.text or ""])[0]) + 1 for d in docs)
    for d in docs:
        ids = np.append(enc.encode([d.text or ""])[0], 0).astype("<u4")
        mine = sorted({(r.start, r.length, r.ids_crc32) for r in pieces[d.doc_id, len(ids)]})
        at = 0
        for start, length, crc in mine:
            if start < at:
                continue  # the same piece of a repeated row, cut elsewhere
            assert crc == zlib.crc32(ids[start : start + length].tobytes())
            at = start + length
    return len(sequences), total


def test_pack_odd_rows(spark, odd, none, enc):
    rows = pack(odd, bpe_path(), window=64, shard_tokens=2000).collect()
    n, total = check_packing(rows, odd.collect(), enc, 64)
    assert n * 64 - total < 64 * 200
    assert pack(none, bpe_path()).count() == 0


def test_bm25_scores_by_brute_force():
    rnd = np.random.default_rng(1)
    counts = rnd.integers(3, 30, 25)
    ids = rnd.integers(0, 40, counts.sum()).astype(np.uint16)
    idf = rnd.random(50).astype(np.float32)
    index = Bm25Shard(ids, counts, idf, counts.mean(), query_terms=6)
    ends = np.cumsum(counts)
    docs = [ids[e - c : e] for e, c in zip(ends, counts)]
    for seed in range(5):
        def weight(d, t):
            tf = (docs[d] == t).sum()
            return idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * counts[d] / counts.mean()))

        terms = sorted(set(docs[seed].tolist()), key=lambda t: (-np.float32(weight(seed, t)), t))[:6]
        want = [sum(weight(d, t) for t in terms) for d in range(len(docs))]
        assert np.allclose(index.scores(seed), want, rtol=1e-4)


def test_neighbours_fill_by_rank():
    lengths = np.array([10, 6, 6, 6])
    pieces = pack_shard(lengths, lambda seed: np.array([0.0, 1.0, 3.0, 2.0]), 16)
    assert pieces[:2] == [(0, 0, 10, 0, 0), (2, 0, 6, 0, 10)]  # the best neighbour fills the seed's window
    assert sorted((d, n) for d, _, n, _, _ in pieces) == [(0, 10), (1, 6), (2, 6), (3, 6)]


def test_packing_steps_do_not_hold_the_encoder(spark, odd):
    """Shards are built by workers that gave the encoder of the step before back."""
    import pandas as pd

    from chronoweave.llm.packing import pack
    from chronoweave.llm.queries import bpe_path

    def held(frames):
        from chronoweave.llm.common import _CLAIMED

        for _ in frames:
            yield pd.DataFrame({"name": [*_CLAIMED, "none"]})

    assert pack(odd, bpe_path()).count() >= odd.count()
    assert "packing" in {r.name for r in spark.range(0, 64, 1, 16).mapInPandas(held, "name string").collect()}
