"""Token counts with overlap resynchronisation for huge documents.

A long text is encoded in overlapping chunks. Two neighbouring encodings are spliced where
both have a token end at the same place and that place is a pretoken boundary whatever
surrounds it: a letter before, no letter after (no alternative of the byte-level pattern goes
on past a letter to something else). The tokens on to the next such place must be equal as
well; where no place qualifies, the overlap is widened.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.bpe import LETTER, UNSAFE, Encoder, classes, encoder
from chronoweave.llm.common import slices

CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 256


class Piece:
    """The encoding of ``text[first:past]``, with the byte offset past each token."""

    def __init__(self, enc: Encoder, text: str, first: int, past: int):
        self.first, self.past, self.text = first, past, text[first:past]
        self.ids = enc.encode([self.text])[0]
        self.ends = enc.ends(self.ids)
        cp = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.cls = classes()[cp]
        self.bytes_at = np.concatenate(([0], np.cumsum(1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF))))

    def stable(self, first: int) -> np.ndarray:
        """Places from ``first`` on (offsets in the whole text) with a letter before and no letter after."""
        at = np.arange(max(1, first - self.first), len(self.cls))
        ok = (self.cls[at - 1] == LETTER) & (self.cls[at] != LETTER) & (self.cls[at] != UNSAFE)
        return at[ok] + self.first

    def tokens_to(self, places: np.ndarray) -> np.ndarray:
        """How many tokens end by each place; -1 where no token ends there."""
        want = self.bytes_at[places - self.first]
        k = np.searchsorted(self.ends, want)
        return np.where((k < len(self.ends)) & (self.ends[np.minimum(k, len(self.ends) - 1)] == want), k + 1, -1)


def common_boundary(left: Piece, right: Piece) -> tuple[int, int] | None:
    """Tokens of ``left`` and of ``right`` up to a proven splice, or None."""
    places = left.stable(right.first)
    places = places[(places > right.first) & (places < left.past - 1)]
    if len(places) < 2 or not len(left.ends) or not len(right.ends):
        return None
    a, b = left.tokens_to(places), right.tokens_to(places)
    both = np.flatnonzero((a > 0) & (b > 0))
    for k in both[len(both) // 2 :].tolist() + both[: len(both) // 2].tolist():
        if k + 1 < len(places) and a[k + 1] > 0 and b[k + 1] > 0 and np.array_equal(left.ids[a[k] : a[k + 1]], right.ids[b[k] : b[k + 1]]):
            return int(a[k]), int(b[k])
    return None


def encode_resync(enc: Encoder, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> np.ndarray:
    """Ids of ``text``, encoded a chunk at a time; equal to those of one call on the whole text."""
    n = len(text)
    left, skip, out = Piece(enc, text, 0, min(n, chunk)), 0, []
    while left.past < n:
        wide, found = overlap, None
        while found is None and wide < left.past - left.first:
            first = left.past - wide
            right = Piece(enc, text, first, min(n, first + max(chunk, 2 * wide)))
            found = common_boundary(left, right)
            if found is not None and found[0] < skip:
                found = None
            wide *= 2
        if found is None:  # no boundary in the whole chunk: a longer one from the same start
            left = Piece(enc, text, left.first, min(n, left.past + (left.past - left.first)))
            continue
        out.append(left.ids[skip : found[0]])
        left, skip = right, found[1]
    return np.concatenate([*out, left.ids[skip:]])


def encode_texts(enc: Encoder, texts: list[str], chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, joined, and the count of each; long texts go through ``encode_resync``."""
    huge = [k for k, x in enumerate(texts) if len(x) > chunk]
    if not huge:
        return enc.encode(texts)
    parts, counts, done = [], np.zeros(len(texts), np.int64), 0
    for k in [*huge, len(texts)]:
        ids, n = enc.encode(texts[done:k])
        parts.append(ids)
        counts[done:k] = n
        if k < len(texts):
            parts.append(encode_resync(enc, texts[k], chunk, overlap))
            counts[k] = len(parts[-1])
        done = k + 1
    return np.concatenate(parts), counts


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Exact token count of every whole text.

    Returns doc_id, n_bytes, n_tokens, over_limit. A null text counts as empty (no tokens);
    repeated rows are each counted; other columns are ignored; an empty table gives no rows.
    No shuffle: one pass over the two columns.
    """

    def count(frames):
        enc = encoder(tokenizer)
        for frame in frames:
            texts = frame["text"].tolist()
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            for a, b in slices(sizes, 1 << 22):
                yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[a:b], "n_bytes": frame["n_bytes"].iloc[a:b], "n_tokens": encode_texts(enc, texts[a:b], chunk, overlap)[1]})

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInPandas(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
