"""Lexical retrieval packing: sharded BM25 neighbours fill each seed document's window.

1. Every text is encoded once; the ids go to a table in the shared folder.
2. Document frequencies of the vocabulary's ids (a bounded vector) come from the whole corpus.
3. Documents are range-partitioned by their two most characteristic ids and the document id,
   so lexical neighbours lie together and no key, however frequent, fills a partition.
4. Each shard (a bounded number of tokens) gets an inverted index. A document's full windows
   are sequences of their own; its remainder is a seed or a neighbour. The seed's most
   characteristic terms query the index, and the unused neighbours by descending BM25 score
   fill the window; the last one is cut so that the window is full.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.bpe import encoder
from chronoweave.llm.common import bounded_batches, claim, slices, tidy, written
from chronoweave.llm.tokens import encode_texts

K1, B = 1.2, 0.75
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def term_counts(ids: np.ndarray, counts: np.ndarray, n_ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, id, frequency) of a block, by document and id."""
    code = np.repeat(np.arange(len(counts), dtype=np.uint64), counts) * np.uint64(n_ids) + ids.astype(np.uint64)
    code.sort()
    edge = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
    doc, term = np.divmod(code[edge], np.uint64(n_ids))
    return doc.astype(np.int32), term.astype(np.int32), np.diff(np.append(edge, len(code))).astype(np.float32)


def top_per_doc(doc: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` heaviest terms of each document, heaviest first; equal weights by term."""
    order = np.lexsort((term, -weight, doc))
    doc, term, weight = doc[order], term[order], weight[order]
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
    rank = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
    keep = rank < k
    return doc[keep], term[keep], weight[keep]


class Bm25Shard:
    """Inverted index of one shard, with corpus-wide statistics."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, idf: np.ndarray, mean_length: float, query_terms: int):
        doc, term, tf = term_counts(ids, counts, len(idf))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (counts[doc] / mean_length)))
        weight = weight.astype(np.float32)
        order = np.argsort(term, kind="stable")
        self.post_doc, self.post_weight = doc[order], weight[order]
        self.first = np.searchsorted(term[order], np.arange(len(idf) + 1))
        q_doc, self.q_term, _ = top_per_doc(doc, term, weight, query_terms)
        self.q_first = np.searchsorted(q_doc, np.arange(len(counts) + 1))
        self.n = len(counts)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 score of every document of the shard for the seed's query."""
        spans = [slice(self.first[t], self.first[t + 1]) for t in self.q_term[self.q_first[seed] : self.q_first[seed + 1]].tolist()]
        if not spans:
            return np.zeros(self.n)
        return np.bincount(np.concatenate([self.post_doc[s] for s in spans]), np.concatenate([self.post_weight[s] for s in spans]), self.n)


def pack_shard(lengths: np.ndarray, score, window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard; ``score(seed)`` ranks neighbours."""
    out, sequence = [], 0
    done = np.zeros(len(lengths), np.int64)  # ids of each document that are placed
    for d, n in enumerate(lengths.tolist()):
        for _ in range(n // window):
            out.append((d, int(done[d]), window, sequence, 0))
            done[d] += window
            sequence += 1
    open_ = lengths > done
    for seed in np.lexsort((np.arange(len(lengths)), -(lengths - done))).tolist():
        if not open_[seed]:
            continue
        offset, take = 0, [seed]
        if lengths[seed] - done[seed] < window:
            ranked = score(seed)
            unused = np.flatnonzero(open_)
            unused = unused[unused != seed]
            take += unused[np.lexsort((unused, -ranked[unused]))].tolist()
        for d in take:
            n = int(min(lengths[d] - done[d], window - offset))
            out.append((d, int(done[d]), n, sequence, offset))
            done[d] += n
            offset += n
            open_[d] = lengths[d] > done[d]
            if offset == window:
                break
        sequence += 1
    return out


def encoded(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """(doc_id, ids as little-endian 16- or 32-bit numbers) of every document, the end id included."""

    def encode(frames):
        enc = encoder(tokenizer)
        kind = "<u2" if enc.n_ids <= 1 << 16 else "<u4"
        for frame in frames:
            texts = frame["text"].tolist()
            for a, b in slices(np.fromiter(map(len, texts), np.int64, len(texts)), 1 << 21):
                ids, n = encode_texts(enc, texts[a:b])
                ids, stop = ids.astype(kind), np.array([end_id], kind)
                at = np.concatenate(([0], np.cumsum(n))).tolist()
                yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[a:b], "ids": [np.concatenate((ids[x:y], stop)).tobytes() for x, y in zip(at, at[1:])]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(tidy(encode), "doc_id long, ids binary")


def unpack(blobs: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Joined ids of rows of ``encoded`` and the count of each."""
    ids = np.frombuffer(b"".join(blobs), kind)
    return ids, np.fromiter(map(len, blobs), np.int64, len(blobs)) // ids.itemsize


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, end_id: int = 0, shard_tokens: int = 1_000_000, query_terms: int = 12) -> DataFrame:
    """Every document's ids in sequences of at most ``window``; one row per piece.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null or empty
    text is its end id alone. Rows with the same id are separate documents. Equal scores and
    lengths are taken in the shard's order. Only a shard's last sequence can be short; its
    padding to ``window`` is the only padding. Other columns are ignored; no rows give no rows.
    """
    bounded_batches(docs.sparkSession)
    enc = encoder(tokenizer)
    n_ids, kind = enc.n_ids, "<u2" if enc.n_ids <= 1 << 16 else "<u4"
    tokens = written(encoded(docs, tokenizer, id_col, text_col, end_id), "packing-ids")

    def frequencies(frames):
        claim("packing")  # the encoder of the step before goes
        total, n_docs, n_tokens = np.zeros(n_ids, np.int64), 0, 0
        for frame in frames:
            blobs = frame["ids"].tolist()
            for a, b in slices(np.fromiter(map(len, blobs), np.int64, len(blobs)), 1 << 22):
                ids, counts = unpack(blobs[a:b], kind)
                total += np.bincount(term_counts(ids, counts, n_ids)[1], minlength=n_ids)
                n_docs, n_tokens = n_docs + len(counts), n_tokens + len(ids)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"term": np.concatenate((seen, [-1, -2])), "n": np.concatenate((total[seen], [n_docs, n_tokens]))})

    # at most one row per vocabulary id: a proven bound
    sums = {r.term: r.n for r in tokens.select("ids").mapInPandas(tidy(frequencies), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n_docs, n_tokens = sums.pop(-1, 0), sums.pop(-2, 0)
    df = np.zeros(n_ids, np.float32)
    df[list(sums)] = list(sums.values())
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean_length = max(1.0, n_tokens / max(1, n_docs))

    def route(frames):
        claim("packing")
        for frame in frames:
            blobs = frame["ids"].tolist()
            for a, b in slices(np.fromiter(map(len, blobs), np.int64, len(blobs)), 1 << 22):
                ids, counts = unpack(blobs[a:b], kind)
                doc, term, tf = term_counts(ids, counts, n_ids)
                doc, term, _ = top_per_doc(doc, term, idf[term] * tf / (tf + K1), 2)
                keys = np.full((b - a, 2), -1, np.int32)
                first = np.concatenate(([True], doc[1:] != doc[:-1]))
                keys[doc[first], 0], keys[doc[~first], 1] = term[first], term[~first]
                yield pd.DataFrame({"k1": keys[:, 0], "k2": keys[:, 1], "doc_id": frame["doc_id"].iloc[a:b].to_numpy(), "ids": blobs[a:b]})

    def fill(frames):
        claim("packing")
        part, shard, rows, ids_of, size = TaskContext.get().partitionId(), 0, [], [], 0
        for frame in frames:
            for doc_id, blob in zip(frame["doc_id"].tolist(), frame["ids"].tolist()):
                rows.append(doc_id)
                ids_of.append(blob)
                size += len(blob) // np.dtype(kind).itemsize
                if size >= shard_tokens:
                    yield packed(rows, ids_of, part, shard)
                    shard, rows, ids_of, size = shard + 1, [], [], 0
        if rows:
            yield packed(rows, ids_of, part, shard)

    def packed(doc_ids, blobs, part, shard):
        ids, counts = unpack(blobs, kind)
        index = Bm25Shard(ids, counts, idf, mean_length, query_terms)
        pieces = np.array(pack_shard(counts, index.scores, window), np.int64).reshape(-1, 5)
        flat, at = ids.astype("<u4"), np.cumsum(counts) - counts
        first = at[pieces[:, 0]] + pieces[:, 1]
        view = memoryview(flat.tobytes())
        crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + pieces[:, 2]).tolist())]
        return pd.DataFrame({"doc_id": np.array(doc_ids)[pieces[:, 0]], "start": pieces[:, 1], "length": pieces[:, 2], "ids_crc32": crc, "doc_tokens": counts[pieces[:, 0]], "sequence_id": (part << 40) + (shard << 24) + pieces[:, 3], "offset": pieces[:, 4]})

    parts = max(1, -(-n_tokens // (2 * shard_tokens)))
    routed = tokens.mapInPandas(tidy(route), "k1 int, k2 int, doc_id long, ids binary")
    # the table is in the shared folder and the sort is total up to equal rows: a rerun gives the same shards
    return routed.repartitionByRange(parts, "k1", "k2", "doc_id").sortWithinPartitions("k1", "k2", "doc_id", "ids").mapInPandas(tidy(fill), PIECES)
