"""Language identification as mixture inference.

Each language has a byte-trigram model (hashed to a fixed number of buckets). The words of a
document are drawn from a mixture of languages; expectation-maximisation estimates the
proportions, and the language set with the best penalised likelihood is chosen among the
nested sets of the most probable languages.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.llm.common import bounded_batches, claim, remainder, slices, tidy

BUCKET_BITS = 15
SMOOTHING = 0.5
STEPS = 12
#: Price of one more language, times log(1 + words).
PENALTY = 2.0
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0x20


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the trigram around each byte of a word, where words start, words of each text)."""
    data = _FOLD[np.frombuffer(b"\x20" + b"\x20".join([*texts, b""]), np.uint8)]
    code = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:] if len(data) > 2 else np.zeros(0, np.uint32)
    bucket = (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
    inside = data[1 : 1 + len(code)] != 0x20
    before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
    starts_all = np.flatnonzero(inside & ~before)
    number = np.cumsum(inside)
    starts = number[starts_all] - 1
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return bucket[inside], starts, np.diff(np.searchsorted(starts_all, ends), prepend=0)


def blocks(whole: list[str], limit: int = 1 << 19):
    """(rows, UTF-8 texts) of bounded size."""
    texts = [x.encode() for x in whole]
    for a, b in slices(np.fromiter(map(len, texts), np.int64, len(texts)), limit):
        yield slice(a, b), texts[a:b]


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, modulus: int, held_out: int) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities [bucket, language] from all labelled rows not held out."""
    rows = docs.where((remainder(F.col(id_col), modulus) != held_out) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())  # the label set
    number, n_buckets = {x: k for k, x in enumerate(langs)}, 1 << BUCKET_BITS

    def count(frames):
        claim("language")
        total = np.zeros(len(langs) * n_buckets, np.int64)
        for frame in frames:
            lang = frame["lang"].map(number).to_numpy()
            for rows_, texts in blocks(frame["text"].tolist()):
                bucket, starts, words = trigrams(texts)
                sizes = np.diff(np.append(starts, len(bucket)))
                of = np.repeat(np.repeat(lang[rows_], words), sizes)
                total += np.bincount(of * n_buckets + bucket, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"cell": seen, "n": total[seen]})

    counts = np.zeros(max(1, len(langs)) * n_buckets)
    if langs:
        # at most languages x buckets rows
        got = rows.mapInPandas(tidy(count), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        counts[got["cell"]] = got["n"]
    counts = counts.reshape(-1, n_buckets).T + SMOOTHING
    return langs, np.log(counts / counts.sum(0)).astype(np.float32)


def fit_mixture(like: np.ndarray, first: np.ndarray, words: np.ndarray, share: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(proportions of each document, its log-likelihood, a bound that no proportions exceed).

    ``like``: word likelihoods scaled to a maximum of 1. Each document stops by itself, so its
    result does not depend on the others. The log-likelihood is concave: with d the mean of
    likelihood over mixture of each language, other proportions gain at most ``words * log(max d)``.
    """
    share, open_ = share.astype(np.float32), np.ones(len(words), bool)
    for _ in range(steps):
        part = like * np.repeat(share, words, 0)
        part /= np.maximum(part.sum(1, keepdims=True), 1e-30)
        new = (np.add.reduceat(part, first, 0) / words[:, None]).astype(np.float32)
        moved = np.abs(new - share).max(1)
        share = np.where(open_[:, None], new, share)
        open_ &= moved >= 1e-3
        if not open_.any():
            break
    total = np.maximum((like * np.repeat(share, words, 0)).sum(1), 1e-30)
    fit = np.add.reduceat(np.log(total.astype(np.float64)), first)
    gain = (np.add.reduceat(like / total[:, None], first, 0, dtype=np.float64) / words[:, None]).max(1)
    return share, fit, fit + words * np.log(np.maximum(gain, 1.0))


def infer(model: np.ndarray, texts: list[bytes], penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """(proportions [text, language], certainty of the choice).

    The certainty compares the best language alone with the second best, and a chosen set of
    several languages also with the best one alone; the larger counts.
    """
    n_langs = model.shape[1]
    share, sure = np.zeros((len(texts), n_langs), np.float32), np.zeros(len(texts))
    bucket, starts, words = trigrams(texts)
    full = np.flatnonzero(words)
    if not len(full):
        return share, sure
    score = np.add.reduceat(model[bucket], starts, 0)
    n = words[full]
    first = np.cumsum(n) - n
    top = score.max(1, keepdims=True)
    like = np.exp(score - top)
    alone = np.add.reduceat((score - top).astype(np.float64), first, 0)
    best = np.sort(alone, 1)
    sure[full] = 1 / (1 + np.exp(-np.minimum(best[:, -1] - best[:, -2], 50))) if n_langs > 1 else 1.0
    mix, _, bound = fit_mixture(like, first, n, np.full((len(full), n_langs), 1 / n_langs, np.float32))
    price = penalty * np.log1p(n)
    chosen = np.zeros_like(mix)
    chosen[np.arange(len(full)), alone.argmax(1)] = 1
    value = best[:, -1] - price
    # no set can fit better than the bound, so most documents need no other sets
    open_ = np.flatnonzero(bound - 2 * price > value)
    rank = np.argsort(np.argsort(-mix, 1, kind="stable"), 1)
    for size in range(2, n_langs + 1):
        if not len(open_):
            break
        rows = np.concatenate([np.arange(first[k], first[k] + n[k]) for k in open_])
        start = np.where(rank[open_] < size, np.maximum(mix[open_], 1e-6), 0)
        start /= start.sum(1, keepdims=True)
        part, got, _ = fit_mixture(like[rows], np.cumsum(n[open_]) - n[open_], n[open_], start.astype(np.float32))
        better = got - size * price[open_] > value[open_]
        chosen[open_[better]], value[open_[better]] = part[better], (got - size * price[open_])[better]
    several = (chosen > 0).sum(1) > 1
    gain = (value - best[:, -1] + price)[several]
    sure[full[several]] = np.maximum(sure[full[several]], 1 / (1 + np.exp(-np.minimum(gain, 50))))
    share[full] = chosen
    return share, sure


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 3, held_out: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """Language proportions of every whole text.

    Returns doc_id, held_out, lang_pred, score, mixture, certainty and the columns in ``keep``. Null
    texts and those without a letter (Unicode category L) are ``und`` with score 0, and so are all where nothing can be
    learned. The score is the main language's proportion times the certainty of the choice.
    Ties go to the language first in order. Very long texts are taken whole, and a text's result
    does not depend on other rows of a batch. Repeated rows are each answered; an empty table
    gives no rows; columns named like the result's are not passed on.
    """
    bounded_batches(docs.sparkSession)
    langs, model = train(docs, id_col, text_col, lang_col, modulus, held_out)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages: a fixed size
    new = ("held_out", "lang_pred", "score", "mixture", "certainty")
    kept = [c for c in keep if c not in ("doc_id", *new)]
    text = text_col if text_col in kept else "_text"

    def predict(batches):
        claim("language")
        for batch in batches:
            whole = [x or "" for x in batch.column(text).to_pylist()]
            letters = np.array([bool(_LETTER.search(x)) for x in whole], bool)
            main, score, mixture, certain = [], [], [], []
            for rows, texts in blocks(whole):
                share, sure = infer(shared.value, texts) if langs else (np.zeros((len(texts), 1)), np.zeros(len(texts)))
                ok = letters[rows] & (share.sum(1) > 0)
                main += [langs[k] if good else UNDETERMINED for k, good in zip(share.argmax(1), ok)]
                certain += np.where(ok, sure, 0.0).tolist()
                score += np.where(ok, np.clip(share.max(1) * sure, 0, 1), 0.0).tolist()
                mixture += [",".join(f"{langs[k]}:{row[k]:.3f}" for k in np.argsort(-row, kind="stable") if row[k] > 0) if good else "" for row, good in zip(share, ok)]
            passed = [batch.column(c) for c in ("doc_id", "held_out", *kept)]
            yield pa.RecordBatch.from_arrays([*passed, pa.array(main, pa.string()), pa.array(score, pa.float64()), pa.array(mixture, pa.string()), pa.array(certain, pa.float64())], names=["doc_id", "held_out", *kept, *new[1:]])

    out = (remainder(F.col(id_col), modulus) == held_out).alias("held_out")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), out, *kept, *([] if text in kept else [F.col(text_col).alias(text)]))
    schema = T.StructType([x for x in rows.schema if x.name != "_text"]).add("lang_pred", "string").add("score", "double").add("mixture", "string").add("certainty", "double")
    return rows.mapInArrow(tidy(predict), schema).select("doc_id", *new, *kept)
