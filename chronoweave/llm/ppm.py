"""Language-model scores by prediction by partial matching over bytes.

The trie of byte contexts comes from counts of the longest n-grams over all training texts;
shorter contexts are its suffixes. A symbol not seen in a context costs an escape (method C:
as many escapes as distinct symbols seen), after which the symbols of the longer context are
excluded. Since a context's symbols are all symbols of its suffix, the totals after exclusion
are a property of the longer context and are computed once; scoring is then array lookups.

A code length depends on the n-gram alone. The most frequent n-grams (a fixed number) are looked
up where the text is read, the others by a join with all counts: those seen in training have
their own code length, the others fall back over the shorter contexts, joined order by order.

The unigram base takes word counts from a shuffle that grows with the corpus: the most
frequent words (a fixed number) are looked up where the text is read, the others by a join.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import HashIndex, ascii_lower, bounded_batches, claim, mix64, remainder, slices, tidy, words_of, written

ORDER = 5
HEAD_WORDS = 100_000
MAX_NODES = 1 << 19
#: Bits of a symbol: 0 before a text's first byte, 1 to 256 for its bytes, ``END`` after its last.
BITS, END = 9, 257
SYMBOLS = 257  # that can be coded: all bytes and the end
#: Distinct n-grams that a task holds before it passes their counts on.
HELD = 1 << 20
_MASKS = [np.uint64((1 << BITS * k) - 1) for k in range(1, 8)]


def grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Codes of ``order`` symbols of context and one symbol, of the texts each followed by its end."""
    pad = b"\0" * order
    data = np.frombuffer(b"".join(itertools.chain.from_iterable((pad, x, b"\0") for x in texts)), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    past = np.cumsum(sizes + order)
    data += np.uint64(1)
    data[(past - sizes - order)[:, None] + np.arange(order)] = 0
    data[past - 1] = END
    code, n = data[order:].copy(), len(data) - order
    for k in range(order):
        code |= data[k : k + n] << np.uint64(BITS * (order - k))
    keep = np.ones(len(code), bool)
    keep[((past[:-1] - order)[:, None] + np.arange(order)).ravel()] = False
    return code[keep], sizes


def blocks(texts: list[bytes], limit: int):
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return slices(sizes, limit)


class Trie:
    """A static trie with the code length of every symbol in every context."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int = ORDER):
        """``codes``: distinct codes of ``grams`` with this order."""
        self.order = order
        self.grams, self.nodes, self.own, self.count = [], [], [], []
        self.escape, self.total_after, self.escape_after = [], [], []
        table = []
        for k in range(order + 1):
            code, at = np.unique(codes & _MASKS[k], return_inverse=True)
            table.append((code, np.bincount(at, counts, len(code))))
        for k, (code, n) in enumerate(table):
            node, at = np.unique(code >> np.uint64(BITS), return_inverse=True)
            total, kinds = np.bincount(at, n, len(node)), np.bincount(at, minlength=len(node))
            self.grams.append(self._index(code))
            self.nodes.append(self._index(node))
            self.count.append(np.log10(n))
            self.own.append(self.count[k] - np.log10(total + kinds)[at])
            self.escape.append(np.log10(kinds) - np.log10(total + kinds))
            after, escape = np.zeros(len(node)), np.zeros(len(node))
            if k:
                below, below_n = table[k - 1]
                gone = np.bincount(at, below_n[np.searchsorted(below, code & _MASKS[k - 1])], len(node))
                parent = np.searchsorted(short_node, node & (_MASKS[k - 2] if k > 1 else np.uint64(0)))
                left, left_kinds = short_total[parent] - gone, short_kinds[parent] - kinds
                some = left_kinds > 0
                after[some] = np.log10((left + left_kinds)[some])
                escape[some] = np.log10(left_kinds[some]) - after[some]
            self.total_after.append(after)
            self.escape_after.append(escape)
            short_node, short_total, short_kinds = node, total, kinds
        self.last = -math.log10(max(1, SYMBOLS - len(table[0][0])))

    @staticmethod
    def _index(codes: np.ndarray) -> HashIndex:
        out = HashIndex(max(8, len(codes)))
        out.add(mix64(codes + np.uint64(1)))
        return out

    @staticmethod
    def _find(index: HashIndex, codes: np.ndarray) -> np.ndarray:
        return index.find(mix64(codes + np.uint64(1)))

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each code's last byte after the bytes before it."""
        order = self.order
        at = self._find(self.grams[order], codes)
        out = self.own[order][at]
        rest = np.flatnonzero(at < 0)
        if not len(rest):
            return out
        code = codes[rest]
        value, done = np.zeros(len(rest)), np.zeros(len(rest), bool)
        child = np.full(len(rest), -1, np.int64)  # node of the next longer context, if it was seen
        for k in range(order, -1, -1):
            short = code & _MASKS[k]
            gram, node = self._find(self.grams[k], short), self._find(self.nodes[k], short >> np.uint64(BITS))
            fresh = ~done & (child < 0)
            hit = fresh & (gram >= 0)
            value[hit] += self.own[k][gram[hit]]
            miss = fresh & (gram < 0) & (node >= 0)
            value[miss] += self.escape[k][node[miss]]
            after = ~done & (child >= 0)
            if k < order and after.any():
                found = after & (gram >= 0)
                value[found] += self.count[k][gram[found]] - self.total_after[k + 1][child[found]]
                lost = after & (gram < 0)
                value[lost] += self.escape_after[k + 1][child[lost]]
                hit |= found
            done |= hit
            child = np.where(done, child, node)
        value[~done] += self.last
        out[rest] = value
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text and its end."""
        codes, sizes = grams(texts, self.order)
        return np.add.reduceat(self.log10(codes), np.cumsum(sizes) - sizes)


class AdaptiveTrie:
    """The same model as a dictionary trie that can learn while it codes."""

    def __init__(self, order: int = ORDER):
        self.order, self.seen = order, defaultdict(lambda: defaultdict(int))

    def log10(self, context: tuple[int, ...], symbol: int) -> float:
        """log10 probability of a symbol after ``order`` symbols, as numbered in ``grams``."""
        value, excluded = 0.0, set()
        for k in range(self.order, -1, -1):
            seen = self.seen.get(context[len(context) - k :])
            if not seen:
                continue
            left = {s: n for s, n in seen.items() if s not in excluded}
            if left:
                total = sum(left.values()) + len(left)
                if symbol in left:
                    return value + math.log10(left[symbol] / total)
                value += math.log10(len(left) / total)
            excluded |= seen.keys()
        return value - math.log10(max(1, SYMBOLS - len(excluded)))

    def code(self, text: bytes, learn: bool) -> float:
        """log10 probability of the text and its end; with ``learn`` each byte is added after it is coded."""
        data, value = (*[0] * self.order, *(b + 1 for b in text), END), 0.0
        for k in range(self.order, len(data)):
            context = data[k - self.order : k]
            value += self.log10(context, data[k])
            if learn:
                for m in range(self.order + 1):
                    self.seen[context[self.order - m :]][data[k]] += 1
        return value


def adaptive_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Code length of each text under a trie that starts empty and learns the text as it goes."""

    def body(frames):
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": [AdaptiveTrie(order).code(x.encode(), True) for x in frame["text"]]})

    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInPandas(body, "doc_id long, score double")


class Counter:
    """Counts of 64-bit keys, merged array by array."""

    def __init__(self) -> None:
        self.key, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        new, n = np.unique(keys, return_counts=True)
        self.key, at = np.unique(np.concatenate((self.key, new)), return_inverse=True)
        self.n = np.bincount(at, np.concatenate((self.n, n)), len(self.key)).astype(np.int64)


def count_corpus(frames):
    """(kind, key, n): words of training texts (kind 0), byte n-grams (1), training documents and ends (2)."""
    claim("ppm-count")
    words, codes, n_texts = Counter(), Counter(), 0

    def counts():
        kind = np.repeat(np.array([0, 1, 2], np.int8), [len(words.key), len(codes.key), 1])
        key = np.concatenate((words.key.view(np.int64), codes.key.view(np.int64), [0]))
        n = np.concatenate((words.n, codes.n, [n_texts]))
        for a in range(0, len(key), 1 << 18):
            yield pd.DataFrame({"kind": kind[a : a + (1 << 18)], "key": key[a : a + (1 << 18)], "n": n[a : a + (1 << 18)]})

    for frame in frames:
        texts = [x.encode() for x in frame["text"].tolist()]
        n_texts += len(texts)
        for a, b in blocks(texts, 1 << 20):
            words.add(words_of(texts[a:b])[0])
            codes.add(grams(texts[a:b])[0])
            if len(words.key) + len(codes.key) > HELD:
                yield from counts()
                words, codes, n_texts = Counter(), Counter(), 0
    if n_texts or len(words.key):
        yield from counts()


def most_frequent(counts: DataFrame, kind: int, most: int, give: str = "n") -> tuple[tuple[np.ndarray, np.ndarray], bool]:
    """Keys and counts (or the column ``give``) of the most frequent entries, at most ``most``, and whether those are all.

    The least count comes from a histogram with 16 bins a doubling, so nothing is sorted and
    the driver gets no more than the entries that it keeps.
    """
    rows = counts.where(F.col("kind") == kind).select("key", F.col(give).alias("given"), F.floor(F.log2("n") * 16).cast("int").alias("bin"))
    bins = {r["bin"]: r["count"] for r in rows.groupBy("bin").count().collect()}  # some 1000 at most
    total, least = 0, None
    for k in sorted(bins, reverse=True):
        if total + bins[k] > most:
            break
        total, least = total + bins[k], k
    # as Arrow columns: row objects would take some twenty times the memory
    got = rows.where(F.lit(False) if least is None else F.col("bin") >= least).select("key", "given").toArrow()
    key, given = got.column("key").to_numpy().astype(np.int64), got.column("given").to_numpy().astype(np.float64 if give == "value" else np.int64)
    order = np.argsort(key)
    return (key[order], given[order]), total == sum(bins.values())


def model_of(token: str, head_key: np.ndarray, head_n: np.ndarray, code: np.ndarray, value: np.ndarray) -> tuple:
    """(index of the frequent words, log10(count + 1) of each and of no word, index of the frequent n-grams, log10 of each and 0), built once a worker."""

    def build():
        index, codes = HashIndex(max(8, len(head_key))), HashIndex(max(8, len(code)))
        index.add(head_key.view(np.uint64))
        codes.add(mix64(code.view(np.uint64) + np.uint64(1)))
        return index, np.append(np.log10(head_n + 1.0), 0.0), codes, np.append(value, 0.0)

    return claim(f"ppm-{token}", build)


def own_values(counts: DataFrame) -> DataFrame:
    """(key, n, value): the training n-grams, and log10 of each in its longest context."""
    context = F.shiftright("key", BITS)
    rows = counts.where("kind = 1").select("key", "n", context.alias("context"))
    nodes = rows.groupBy("context").agg((F.sum("n") + F.count("*")).alias("all"))
    return rows.join(nodes, "context").select("key", "n", (F.log10("n") - F.log10("all")).alias("value"))


def fallback_values(counts: DataFrame, unseen: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, value) of the distinct n-grams ``unseen`` (column key) that training does not have, as ``Trie.log10`` gives them."""
    mask = [int(x) for x in _MASKS]
    tables = [written(counts.where("kind = 1").groupBy(F.col("key").bitwiseAND(F.lit(mask[order])).alias("key")).agg(F.sum("n").alias("n")), "lm-grams")]
    for k in range(order - 1, -1, -1):
        shorter = tables[0].groupBy(F.col("key").bitwiseAND(F.lit(mask[k])).alias("key")).agg(F.sum("n").alias("n"))
        tables.insert(0, written(shorter, "lm-grams"))
    last = -math.log10(max(1, SYMBOLS - tables[0].count()))
    nodes = [t.groupBy(F.shiftright("key", BITS).alias("node")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds")) for t in tables]
    out = unseen
    for k in range(order, -1, -1):
        short = F.col("key").bitwiseAND(F.lit(mask[k]))
        need = unseen.select(F.shiftright(short, BITS).alias("node")).distinct()
        node = nodes[k].join(need, "node", "left_semi")
        if k:
            under = tables[k - 1].select(F.col("key").alias("below"), F.col("n").alias("below_n"))
            mine = tables[k].select(F.shiftright("key", BITS).alias("node"), F.col("key").bitwiseAND(F.lit(mask[k - 1])).alias("below")).join(need, "node", "left_semi")
            gone = mine.join(under, "below").groupBy("node").agg(F.sum("below_n").alias("gone"))
            parent = nodes[k - 1].toDF("parent", "parent_total", "parent_kinds")
            node = node.join(gone, "node").withColumn("parent", F.col("node").bitwiseAND(F.lit(mask[k - 2] if k > 1 else 0))).join(parent, "parent")
            node = node.select("node", "total", "kinds", (F.col("parent_total") - F.col("gone")).alias("left"), (F.col("parent_kinds") - F.col("kinds")).alias("left_kinds"))
        else:
            node = node.select("node", "total", "kinds", F.lit(0).cast("long").alias("left"), F.lit(0).cast("long").alias("left_kinds"))
        # few contexts are this short, so they are hot keys; the alphabet bounds them: 258 of one symbol, 66,564 of two
        own = F.broadcast(tables[k]) if k < 2 else tables[k]
        out = out.withColumn("short", short).join(own.toDF("short", f"n{k}"), "short", "left").drop("short")
        node = F.broadcast(written(node, "lm-nodes")) if k < 3 else node
        out = out.withColumn("node", F.shiftright(short, BITS)).join(node.toDF("node", f"total{k}", f"kinds{k}", f"left{k}", f"left_kinds{k}"), "node", "left").drop("node")
        out = written(out, "lm-unseen")

    def body(frames):
        for frame in frames:
            col = {c: frame[c].to_numpy(np.float64) for c in frame.columns if c != "key"}
            value, done, child = np.zeros(len(frame)), np.zeros(len(frame), bool), np.zeros(len(frame), bool)
            with np.errstate(divide="ignore", invalid="ignore"):
                for k in range(order, -1, -1):
                    n, every, kinds = col[f"n{k}"], col[f"total{k}"] + col[f"kinds{k}"], col[f"kinds{k}"]
                    gram, node = ~np.isnan(n), ~np.isnan(kinds)
                    fresh, after = ~done & ~child, ~done & child
                    value += np.where(fresh & gram, np.log10(n) - np.log10(every), 0.0)
                    value += np.where(fresh & ~gram & node, np.log10(kinds) - np.log10(every), 0.0)
                    if k < order:
                        left, left_kinds = col[f"left{k + 1}"], col[f"left_kinds{k + 1}"]
                        some = left_kinds > 0
                        value += np.where(after & gram, np.log10(n) - np.log10(left + left_kinds), 0.0)
                        value += np.where(after & ~gram & some, np.log10(left_kinds) - np.log10(left + left_kinds), 0.0)
                    done |= gram
                    child = np.where(done, child, node)
            yield pd.DataFrame({"key": frame["key"], "value": np.where(done, value, value + last)})

    return out.mapInPandas(tidy(body), "key long, value double")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held_out: int = 2, head_words: int = HEAD_WORDS, max_nodes: int = MAX_NODES) -> DataFrame:
    """Unigram base score and PPM score of every whole text (A-Z lower-cased).

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Null counts
    as empty: its only token is the end. Rows with the same id are scored one by one. Without
    training texts every token is unknown and bytes are uniform. ``max_nodes`` n-grams, the
    most frequent, are looked up where the text is read, the others joined: it does not change
    the scores. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    out = remainder(F.col(id_col), modulus) == held_out
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), out.alias("held_out"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    counts = rows.where("NOT held_out").select("text").mapInPandas(tidy(count_corpus), "kind byte, key long, n long")
    counts = written(counts.groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")
    sums = {r.kind: r for r in counts.groupBy("kind").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).collect()}
    n_train = sums[2].n if 2 in sums else 0
    total = n_train + (sums[0].n if 0 in sums else 0)
    distinct = (n_train > 0) + (sums[0].kinds if 0 in sums else 0)
    head, all_words = most_frequent(counts, 0, head_words)
    own = written(own_values(counts), "lm-own")
    nodes, _ = most_frequent(own.select(F.lit(1).alias("kind"), "key", "n", "value"), 1, max_nodes, "value")
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, *head, *nodes))

    def score(frames):
        index, gain, frequent, value = model_of(*shared.value)
        row = TaskContext.get().partitionId() << 40
        for frame in frames:
            texts = [x.encode() for x in frame["text"].tolist()]
            for a, b in blocks(texts, 1 << 19):
                words, n = words_of(texts[a:b])
                at = index.find(words)
                first = np.cumsum(n) - n
                add = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[np.append(first, len(words))])  # noqa: E731, B023
                rare = np.zeros(len(words), bool) if all_words else at < 0
                rest = words[rare].view(np.int64)
                cut = np.cumsum(add(rare).astype(np.int64)).tolist()
                codes, n_code = grams(texts[a:b])
                node = frequent.find(mix64(codes + np.uint64(1)))
                ppm = np.add.reduceat(value[node], np.cumsum(n_code) - n_code)
                other = codes[node < 0].view(np.int64)
                past = np.cumsum(np.add.reduceat((node < 0).astype(np.int64), np.cumsum(n_code) - n_code)).tolist()
                yield pd.DataFrame({
                    "row": np.arange(row, row + b - a), "doc_id": frame["doc_id"].to_numpy()[a:b], "held_out": frame["held_out"].to_numpy()[a:b], "n_tokens": n + 1,
                    "known": add(at >= 0).astype(np.int64), "gain": add(gain[at]), "score": ppm, "rare": [rest[x:y] for x, y in zip([0, *cut], cut)],
                    "other": [other[x:y] for x, y in zip([0, *past], past)],
                })
                row += b - a

    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, gain double, score double, rare array<long>, other array<long>"
    base = written(rows.mapInPandas(tidy(score), schema), "lm-scores")
    rare = base.select("row", F.explode("rare").alias("key")).join(counts.where("kind = 0").select("key", "n"), "key")
    rare = rare.groupBy("row").agg(F.count("*").alias("k"), F.sum(F.log10(F.col("n") + 1)).alias("g"))
    other = base.select("row", F.explode("other").alias("key"))
    unseen = written(other.select("key").distinct().join(own.select("key"), "key", "left_anti"), "lm-unseen")
    values = own.select("key", "value").union(fallback_values(counts, unseen))
    other = other.join(values, "key").groupBy("row").agg(F.sum("value").alias("other_score"))
    both = base.drop("rare", "other").join(rare, "row", "left").join(other, "row", "left").withColumn("score", F.col("score") + F.coalesce("other_score", F.lit(0.0)))
    known = F.col("known") + F.coalesce("k", F.lit(0)) + F.lit(int(n_train > 0))
    gain = F.col("gain") + F.coalesce("g", F.lit(0.0)) + F.lit(math.log10(n_train + 1))
    return both.select("doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (gain - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))).alias("base_score"), "score")
