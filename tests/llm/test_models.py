import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from chronoweave.llm import telephony as tel
from chronoweave.llm.language import fit_mixture, identify, infer, train
from chronoweave.llm.ppm import END, AdaptiveTrie, Trie, adaptive_scores, grams, score_documents
from chronoweave.llm.quality import Network, chunks_of, quality_scores

DATA = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# language


def test_language_held_out_accuracy(spark, documents):
    rows = identify(documents, keep=("lang",)).where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_mixture_proportions(spark, documents):
    langs, model = train(documents, "doc_id", "text", "lang", 3, 1)
    texts = {r.lang: r.text for r in documents.where("doc_id % 3 = 1 AND n_chars > 400 AND n_chars < 4000").collect()}
    en, fr = ([w for w in texts[x].split()] for x in ("en", "fr"))
    n = min(len(en), len(fr), 60)
    share, _ = infer(model, [" ".join(en[:n] + fr[:n]).encode(), " ".join(en[:n]).encode()])
    assert 0.3 < share[0][langs.index("en")] < 0.7 and 0.3 < share[0][langs.index("fr")] < 0.7
    assert (share[1] > 0).sum() == 1  # one language is enough


def test_em_by_brute_force():
    rng = np.random.default_rng(2)
    like = rng.random((30, 3)).astype(np.float32)
    share, fit, _ = fit_mixture(like, np.array([0]), np.array([30]), np.full((1, 3), 1 / 3, np.float32), steps=300)
    best = max(sum(math.log(a * x + b * y + (1 - a - b) * z) for x, y, z in like.tolist()) for a in np.arange(0, 1.01, 0.05) for b in np.arange(0, 1.01 - a, 0.05) if 1 - a - b >= -1e-9)
    assert fit[0] > best - 0.05 and abs(share.sum() - 1) < 1e-4


def test_em_bound_holds():
    rng = np.random.default_rng(5)
    like = rng.random((400, 4)).astype(np.float32) ** 3
    words = np.array([100, 250, 50])
    first, flat = np.array([0, 100, 350]), np.full((3, 4), 0.25, np.float32)
    _, _, bound = fit_mixture(like, first, words, flat, steps=2)
    _, far, _ = fit_mixture(like, first, words, flat, steps=2000)
    assert (bound >= far - 1e-6).all()


def mixed_texts(documents):
    texts = [r.text for r in documents.where("doc_id % 3 = 1 AND n_chars > 200 AND n_chars < 3000").orderBy("doc_id").limit(120).collect()]
    return [x.encode() for x in (*texts[:30], *(" ".join(a.split()[:40] + b.split()[:40]) for a, b in zip(texts, texts[60:])))]


def test_language_alone_as_in_a_batch(spark, documents):
    _, model = train(documents, "doc_id", "text", "lang", 3, 1)
    texts = mixed_texts(documents)
    share, sure = infer(model, texts)
    for k, text in enumerate(texts):
        alone, sure_alone = infer(model, [text])
        assert np.array_equal(alone[0], share[k]) and sure_alone[0] == sure[k]


def test_language_set_by_brute_force(spark, documents):
    """The chosen set has the best penalised likelihood of the nested sets, fitted to the end."""
    from chronoweave.llm.language import PENALTY, trigrams

    _, model = train(documents, "doc_id", "text", "lang", 3, 1)
    texts = mixed_texts(documents)
    share, _ = infer(model, texts)
    for k, text in enumerate(texts):
        bucket, starts, words = trigrams([text])
        score = np.add.reduceat(model[bucket], starts, 0)
        like = np.exp(score - score.max(1, keepdims=True)).astype(np.float64)
        price, n = PENALTY * math.log1p(len(starts)), len(starts)
        full = np.full(4, 0.25)
        for _ in range(12):
            full = (like * full / (like * full).sum(1, keepdims=True)).mean(0)
        values = {(int(np.log(np.maximum(like, 1e-30)).sum(0).argmax()),): np.log(np.maximum(like, 1e-30)).sum(0).max() - price}
        for size in (2, 3, 4):
            some = np.argsort(-full, kind="stable")[:size]
            p = full[some] / full[some].sum()
            for _ in range(400):
                p = (like[:, some] * p / (like[:, some] * p).sum(1, keepdims=True)).mean(0)
            values[tuple(sorted(some.tolist()))] = np.log((like[:, some] * p).sum(1)).sum() - size * price
        chosen = tuple(np.flatnonzero(share[k] > 0).tolist())
        near = max(values.values()) - 0.5  # the operator's fits are not run to the end
        assert any(v >= near and (set(chosen) <= set(s)) for s, v in values.items()), (k, n, chosen, values)


def test_numbers_are_not_letters(spark):
    docs = spark.createDataFrame([(1, "a text of letters", "en"), (2, "\u00bd \u00b2 \u2460", "en"), (3, "un texte de mots", "fr"), (5, "another text", "en"), (6, "encore un mot", "fr")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs).collect()}
    assert got[2] == ("und", 0.0) and got[1][0] in ("en", "fr")


def test_language_odd_rows(spark, odd, none):
    got = {r.doc_id: r for r in identify(odd).collect()}
    assert {k for k, r in got.items() if r.lang_pred == "und"} >= {4, 5, 6, 7}
    assert identify(odd).count() == odd.count()
    assert identify(none).count() == 0
    kept = identify(odd, keep=tuple(odd.columns))
    assert kept.select("norm").first()["norm"] == "clash" and kept.where("doc_id = 4").first().lang_pred == "und"
    unlabelled = identify(odd.drop("lang").selectExpr("*", "cast(null AS string) AS lang"))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


# quality


def test_quality_held_out(spark, documents):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = quality_scores(documents, labels).join(labels, "doc_id").where("held_out").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert np.mean([r.predicted for r in rows if r.quality == 1]) > 0.95


def test_chunks_cover_and_overlap():
    for n in (0, 1, 7, 8, 255, 256, 257, 260, 261, 5000):
        text = bytes(range(1, 252)) * 20
        parts = chunks_of(text[:n])
        joined = parts[0] + b"".join(p[4:] for p in parts[1:])
        assert joined.rstrip(b"\0") == text[:n]
        assert all(len(p) % 4 == 0 and 8 <= len(p) <= 260 for p in parts)


def test_network_summary_by_brute_force():
    net = Network()
    texts = [b"", b"short", bytes(range(256)) * 3, b"abc" * 500]
    for text, got in zip(texts, net.summary(texts)):
        logits = []
        for chunk in chunks_of(text):
            x = net.embed[np.frombuffer(chunk, np.uint8)].reshape(-1, 32)
            y = x[:-1] @ net.w1 + x[1:] @ net.w2
            logits.append(np.maximum(y.max(0) + net.bias, 0) @ net.out + net.shift[0])
        assert np.allclose(got, [np.mean(logits), max(logits), min(logits)], atol=1e-4)


def test_quality_trains_on_whole_texts(spark):
    """What tells the classes apart lies far behind the beginning."""
    rng = np.random.default_rng(0)
    plain = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    rows = [(k, plain(6000) + ("#@" * 750 if k % 2 else plain(1500))) for k in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k, _ in rows] + [(3, 0)], "doc_id long, quality int")
    got = quality_scores(docs.union(docs.where("doc_id < 4")), labels).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 164 and len(held) > 20
    assert np.mean([(r.score > 0.5) == (r.doc_id % 2 == 0) for r in held]) > 0.9


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (8, None, 1), (99, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality_scores(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert quality_scores(none, labels).count() == 0
    assert len({r.score for r in quality_scores(odd, labels.where("doc_id < 0")).collect()}) == 1


# language model


def test_static_trie_equals_dictionary_trie():
    train_on = [b"the cat sat on the mat", b"the dog sat", "ñandú über".encode(), b""]
    slow = AdaptiveTrie()
    for x in train_on:
        slow.code(x, True)
    codes, counts = np.unique(np.concatenate([grams([x])[0] for x in train_on]), return_counts=True)
    fast = Trie(codes, counts)
    texts = [b"", b"the mat", b"zzz \xff\x00", b"on the dog sat the cat", "übergroß".encode()]
    assert np.allclose(fast.score(texts), [slow.code(x, False) for x in texts])


def test_probabilities_sum_to_one():
    trie = AdaptiveTrie(2)
    trie.code(b"abracadabra", True)
    for context in (b"ab", b"zz", b"ra", b"\0a"):
        assert abs(sum(10 ** trie.log10(tuple(b + 1 for b in context), s) for s in range(1, 258)) - 1) < 1e-9


def test_a_zero_byte_is_not_the_end():
    trie = AdaptiveTrie(2)
    trie.code(b"ab", True)
    ends = trie.log10((98, 99), END)
    assert ends > trie.log10((98, 99), 1)
    codes, sizes = grams([b"a\0", b"a"])
    assert sizes.tolist() == [3, 2] and codes[1] != codes[4] and codes[2] != codes[4]


def test_scores_by_brute_force(spark, odd, none):
    docs = [(r.doc_id, (r.text or "").translate(LOWER)) for r in odd.collect()]
    out = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 7 == 2}
    count, ends = Counter(), 0
    for i, t in docs:
        if i not in out:
            count.update(WORD.findall(t))
            ends += 1
    total, kinds = sum(count.values()) + ends, len(count) + 1
    for head in (3, 100_000):  # with most words resolved by the join, and with none
        got = score_documents(odd, head_words=head).collect()
        assert len(got) == len(docs)
        for r in got:
            words = WORD.findall(dict(docs)[r.doc_id])
            n = [count[w] for w in words] + [ends]
            assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(n), sum(c > 0 for c in n), total, r.doc_id in out)
            assert math.isclose(r.base_score, sum(math.log10((c + 1) / (total + kinds + 1)) for c in n), rel_tol=1e-9)
    assert score_documents(none).count() == 0
    assert adaptive_scores(odd.where("doc_id IN (1, 4, 11)")).where("score < 0").count() == 3


def test_ppm_scores_do_not_depend_on_the_head(spark):
    """All n-grams count, however few are looked up where the text is read."""
    texts = ["the cat sat on the mat", "the dog sat", "a\0b\0", "\u00f1and\u00fa \u00fcber", "", "zzz on the catalogue", "a dog ran over the mat", "\u00fcbergro\u00df", "quite another text 12", "the mats"] * 3
    docs = [(k, f"{t} {k % 5}" if t else t) for k, t in enumerate(texts)]
    out = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 7 == 2}
    slow = AdaptiveTrie()
    for i, t in docs:
        if i not in out:
            slow.code(t.encode(), True)
    assert out
    for most in (8, 1 << 19):
        got = {r.doc_id: r.score for r in score_documents(spark.createDataFrame(docs, "doc_id long, text string"), max_nodes=most).collect()}
        assert all(math.isclose(got[i], slow.code(t.encode(), False), rel_tol=1e-9) for i, t in docs)


# media


def reference_ulaw(code):
    code = ~code & 0xFF
    value = (((code & 15) << 3) + 0x84) << ((code & 0x70) >> 4)
    return 0x84 - value if code & 0x80 else value - 0x84


def reference_ima(block):
    steps = list(map(int, tel.IMA_STEPS.split()))
    value, index = struct.unpack("<hB", block[:3])
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = steps[index]
            change = step >> 3
            change += step if code & 4 else 0
            change += step >> 1 if code & 2 else 0
            change += step >> 2 if code & 1 else 0
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
            out.append(value)
    return out


def test_tables():
    assert tel.mulaw_table().tolist() == [reference_ulaw(c) for c in range(256)]
    a = tel.alaw_table()
    assert (int(a.min()), int(a.max()), int(a[0x55]), int(a[0xD5])) == (-32256, 32256, -8, 8)
    assert len(set(a.tolist())) == 256
    assert len(tel.IMA_STEPS.split()) == 89


def test_ima_by_sample():
    rng = np.random.default_rng(5)
    blocks = rng.integers(0, 256, (40, 68)).astype(np.uint8)
    blocks[:, 2] %= 89
    got = tel.decode_ima(blocks)
    assert all(got[k].tolist() == reference_ima(blocks[k].tobytes()) for k in range(40))


def test_round_trip_and_odd_rows(spark, odd, none):
    rows = tel.media_digests(odd).collect()
    assert len(rows) == odd.count()
    texts = {(r.doc_id, len((r.text or "").encode())): (r.text or "").encode() for r in odd.collect()}
    import hashlib

    for r in rows:
        text = texts[r.doc_id, r.n_bytes]
        payload = text + b"\0" * (max(64, -(-len(text) // 64) * 64) - len(text))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert tel.media_digests(none).count() == 0
    whole = {r.doc_id: r.feature for r in tel.audio_columns(tel.stored_texts(odd)).collect()}
    assert all(r.feature == whole[r.doc_id] for r in rows)  # the feature of the stored PCM is that of the decoded audio
    media = tel.stored_texts(odd).selectExpr("doc_id", "CASE WHEN doc_id = 1 THEN NULL ELSE media END AS media", "'x' AS pcm", "'y' AS extra")
    out = {r.doc_id: r for r in tel.audio_columns(media).collect()}
    assert out[1].pcm is None and out[1].feature is None and out[2].extra == "y" and out[2].pcm_rate == 16000


def test_pcm_stays_in_the_worker(spark, odd):
    """Two Python steps, and no PCM, some six times the text, between them and the JVM."""
    plan = tel.media_digests(odd)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 2 and "media#" in plan and "pcm#" not in plan


def test_writers_and_workers_hold_little(spark):
    from chronoweave.llm import common

    own, plain = spark.newSession(), spark.newSession()
    own.conf.set("parquet.block.size", "1000000")
    common.bounded_batches(own)
    common.bounded_batches(plain)
    assert own.conf.get("parquet.block.size") == "1000000" and int(plain.conf.get("parquet.block.size")) == 8 << 20
    assert plain.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "500"


def test_tidy_gives_back_after_the_last_row(monkeypatch):
    from chronoweave.llm import common

    said = []
    monkeypatch.setattr(common, "give_back", lambda: said.append("back"))
    assert [x for x in common.tidy(lambda rows: (said.append(x) or x for x in rows))(iter([1, 2]))] == [1, 2]
    assert said == [1, 2, "back"]


def test_resample_and_pcm():
    x = np.array([0, 100, -100, 50], np.int16)
    assert tel.resample(x, 8000).tolist() == [0, 50, 100, 0, -100, -25, 50, 50]
    assert tel.resample(x, 16000, 8000).tolist() == [0, -100]
    media = tel.wav(tel.PCM, x.astype("<i2").tobytes(), 2, 16, 8000)
    assert tel.decode([media])[0][0].tolist() == x.tolist()
    with pytest.raises(ValueError):
        tel.read_wav(b"nothing")
