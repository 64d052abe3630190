"""Byte-level BPE ids exactly as the ``tokenizers`` library gives them, much faster.

Pretoken boundaries are found with array operations over code points; each distinct
pretoken is merged once per worker and remembered. Texts with code points that are not
stable across Unicode versions, or with an added-token string, go to the library itself.
"""

from __future__ import annotations

import itertools
import json
import unicodedata

import numpy as np

from chronoweave.llm.common import HashIndex, claim, run_hashes, slices

LETTER, NUMBER, SPACE, OTHER, UNSAFE = range(5)
#: What the published byte-level pattern splits off after an apostrophe (fixed values).
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")
_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of each code point; those without the same class in Unicode 3.2 and now are unsafe."""
    if not _CLASSES:
        major = {"L": LETTER, "N": NUMBER}
        old = unicodedata.ucd_3_2_0
        out = np.full(0x110000, UNSAFE, np.uint8)
        for cp in range(0x30000):
            c = chr(cp)
            now = unicodedata.category(c)
            if now[0] == old.category(c)[0] and now not in ("Cn", "Cs", "Co"):
                out[cp] = SPACE if now[0] == "Z" else major.get(now[0], OTHER)
        out[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85]] = SPACE
        out[[0x1C, 0x1D, 0x1E, 0x1F, 0x180E, 0x200B]] = UNSAFE  # engines disagree
        _CLASSES.append(out)
    return _CLASSES[0]


def byte_alphabet() -> dict[str, int]:
    """The published printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def encoder(path: str) -> "Encoder":
    """The encoder of this vocabulary file, one per process."""
    return claim(f"bpe-{path}", lambda: Encoder(path))


class Encoder:
    """Ids of a byte-level BPE vocabulary, and the places where two encodings may be joined."""

    def __init__(self, path: str, memo_limit: int = 250_000, block_chars: int = 1 << 19):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.added = [x["content"] for x in spec["added_tokens"]]
        ranks = {bytes(alphabet[c] for c in token): rank for token, rank in vocab.items() if token not in self.added}
        self.library = Tokenizer.from_file(path)
        self.core = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.n_ids = max([*vocab.values(), *(x["id"] for x in spec["added_tokens"])]) + 1
        self.n_bytes = np.zeros(self.n_ids, np.int64)
        for token, rank in ranks.items():
            self.n_bytes[rank] = len(token)
        for x in spec["added_tokens"]:
            self.n_bytes[x["id"]] = len(x["content"].encode())
        self.memo_limit, self.block_chars = memo_limit, block_chars
        self.forget(0)

    def forget(self, needed: int) -> None:
        """Empty the memo; it then takes ``memo_limit`` pretokens, or ``needed`` if a block has more."""
        self.memo = HashIndex(max(self.memo_limit, needed))
        self.pool = np.zeros(0, np.int32)
        self.pool_first, self.pool_count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        """Merge new pretokens and remember their ids."""
        one = self.core.encode_single_piece
        rows = [one(x) for x in pieces]
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        self.memo.add(hashes)
        self.pool_first = np.concatenate((self.pool_first, len(self.pool) + np.cumsum(counts) - counts))
        self.pool_count = np.concatenate((self.pool_count, counts))
        self.pool = np.concatenate((self.pool, np.fromiter(itertools.chain.from_iterable(rows), np.int32, int(counts.sum()))))

    def boundaries(self, cp: np.ndarray, cls: np.ndarray, doc_first: np.ndarray) -> np.ndarray:
        """True where a pretoken starts. ``doc_first``: where a text of the block starts."""
        n = len(cp)
        first = np.zeros(n + 1, bool)
        first[doc_first] = True
        first[n] = True
        space = cls == SPACE
        prev_cls = np.empty(n, np.uint8)
        prev_cls[0], prev_cls[1:] = OTHER, cls[:-1]
        prev_blank = np.empty(n, bool)
        prev_blank[0], prev_blank[1:] = False, cp[:-1] == 0x20
        start = ~space & (prev_cls != cls) & ~prev_blank
        next_solid = np.empty(n, bool)
        next_solid[-1], next_solid[:-1] = False, ~space[1:]
        next_solid &= ~first[1:]
        start |= space & ((prev_cls != SPACE) | next_solid)
        start |= first[:-1]
        quote = np.flatnonzero((cp == 0x27) & start)
        for tail in CONTRACTIONS:
            if not len(quote):
                break
            hit = quote[quote + len(tail) < n]
            for k, letter in enumerate(tail, 1):
                hit = hit[(cp[hit + k] == ord(letter)) & ~first[hit + k]]
            start[hit + 1] = False
            after = hit + len(tail) + 1
            after = after[after < n]
            start[after[cls[after] == LETTER]] = True
        return start

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of safe texts, joined, and the count of each."""
        joined = "".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        firsts = np.cumsum(lengths) - lengths
        starts = np.flatnonzero(self.boundaries(cp, classes()[cp], firsts[lengths > 0]))
        ends = np.append(starts[1:], len(cp))
        hashes = run_hashes(cp, starts, ends)
        code = self.memo.find(hashes)
        new = np.flatnonzero(code < 0)
        if len(new):
            distinct, which = np.unique(hashes[new], return_index=True)
            if self.memo.n + len(distinct) > self.memo_limit:
                self.forget(len(distinct))
                new = np.arange(len(hashes))
                distinct, which = np.unique(hashes, return_index=True)
            self.learn(distinct, [joined[a:b].encode() for a, b in zip(starts[new[which]].tolist(), ends[new[which]].tolist())])
            code[new] = self.memo.find(hashes[new])
        each = self.pool_count[code]
        at = np.cumsum(each)
        take = np.arange(int(at[-1]), dtype=np.int64) + np.repeat(self.pool_first[code] - (at - each), each)
        bounds = np.searchsorted(starts, np.cumsum(lengths))
        total = np.concatenate(([0], at))[bounds]
        return self.pool[take], np.diff(np.concatenate(([0], total)))

    def safe(self, text: str) -> bool:
        """Whether the array path gives the library's ids for this text."""
        if any(x in text for x in self.added):
            return False
        return text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f") or not (classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)] == UNSAFE).any()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, joined, and how many each text has."""
        ids, counts = [], np.zeros(len(texts), np.int64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        for a, b in slices(sizes, self.block_chars):
            part = texts[a:b]
            ok = [self.safe(x) for x in part]
            if all(ok):
                flat, n = self._plain(part)
                counts[a:b] = n
                ids.append(flat)
                continue
            for x, good in zip(part, ok):
                flat = self._plain([x])[0] if good else np.array(self.library.encode(x, add_special_tokens=False).ids, np.int32)
                counts[a] = len(flat)
                ids.append(flat)
                a += 1
        return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), counts

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset past each token."""
        return np.cumsum(self.n_bytes[ids])
