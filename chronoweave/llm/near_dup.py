"""MinHash near-duplicates with tensored banding.

Two small collections of ``BANDS`` half keys (each of ``ROWS`` minimum hashes) are computed for
a document; its table keys are all pairs of a half key of the first and one of the second.
``BANDS * BANDS`` tables of ``2 * ROWS`` hashes thus cost ``2 * BANDS * ROWS`` hashes, and only
half keys that occur twice are combined at all.

Every pair that shares a table bucket is decided, without making all pairs of a bucket:

1. Documents with equal shingle sets are one class.
2. The member of a bucket with the most mates is its hub. Pairs (member, hub) whose signatures
   make the threshold plausible are confirmed on the full sets, the best hub of each member
   first, then the others that are still in another component.
3. The hub of a bucket is then decided against all its mates. Members of a bucket that still
   lie in different components are compared with each other, exactly and in bounded blocks, one
   side being the members outside the hub group's largest component. A block gives at most a
   spanning forest of its links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import bounded_batches, claim, mix64, slices, small, stream64, tidy, whole_groups, words_of, written
from chronoweave.llm.components import components, extended

PERCENT = 80
WIDTH = 5
BANDS, ROWS = 12, 3
HASHES = 2 * BANDS * ROWS
#: Signature agreement from which a pair may reach the threshold (at 0.8 it is less in about 1 of 15,000 pairs).
PLAUSIBLE = 0.6
#: Members of a side of a block.
BLOCK = 128
ID_BOUND = 1_000_000


def shingle_sets(texts: list[bytes], n: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's ``n``-word shingles; fewer words: the sequence as one."""
    hashes, counts = words_of(texts)
    m = len(hashes)
    if not m:
        return [np.zeros(0, np.uint64)] * len(texts)
    whole = hashes.copy()
    for k in range(1, n):
        whole[: m - k] = mix64(whole[: m - k] * np.uint64(0x9E3779B97F4A7C15) + hashes[k:])
    out, at = [], 0
    for c in counts.tolist():
        if c >= n:
            part = np.sort(whole[at : at + c - n + 1])
            keep = np.ones(len(part), bool)
            np.not_equal(part[1:], part[:-1], out=keep[1:])
            part = part[keep]
        elif c:
            one = np.uint64(c)
            for h in hashes[at : at + c]:
                one = mix64(np.array([one], np.uint64) ^ h)[0]
            part = np.array([one], np.uint64)
        else:
            part = hashes[:0]
        out.append(part)
        at += c
    return out


def signatures(sets: list[np.ndarray], n_hashes: int, block: int = 1 << 15) -> np.ndarray:
    """Minimum of each of ``n_hashes`` multiply-shift hashes over each (non-empty) set."""
    mul, add = stream64(n_hashes, 11) | np.uint64(1), stream64(n_hashes, 12)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    out = np.empty((len(sets), n_hashes), np.uint32)
    for a, b in slices(sizes, block):
        x = np.concatenate(sets[a:b])
        first = np.cumsum(sizes[a:b]) - sizes[a:b]
        y = np.empty_like(x)
        for k in range(n_hashes):
            np.multiply(x, mul[k], out=y)
            y += add[k]
            out[a:b, k] = np.minimum.reduceat(y, first) >> np.uint64(32)
    return out


def features(width: int) -> Callable:
    """Set size, 128-bit set digest, signature and both collections of half keys of each text."""

    def body(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("near-dup")
        for frame in frames:
            texts = [x.encode() for x in frame["text"].tolist()]
            for a, b in slices(np.fromiter(map(len, texts), np.int64, len(texts)), 1 << 21):
                ids, tags = frame["doc_id"].to_numpy()[a:b], frame["tag"].to_numpy()[a:b]
                sets = shingle_sets(texts[a:b], width)
                full = np.array([k for k, s in enumerate(sets) if len(s)], np.int64)
                empty = np.array([k for k, s in enumerate(sets) if not len(s)], np.int64)
                if len(empty):
                    yield pd.DataFrame({"doc_id": ids[empty], "tag": tags[empty], "n": 0, "d1": 0, "d2": 0, "sig": None, "half_a": None, "half_b": None})
                if not len(full):
                    continue
                sets = [sets[k] for k in full]
                joined, sizes = np.concatenate(sets), np.fromiter(map(len, sets), np.int64, len(sets))
                first = np.cumsum(sizes) - sizes
                digest = [np.add.reduceat(mix64(joined ^ np.uint64(s)), first).view(np.int64) for s in (0x243F6A8885A308D3, 0x13198A2E03707344)]
                sig = signatures(sets, HASHES)
                half = np.zeros((len(sets), 2 * BANDS), np.uint64) + np.arange(1, 2 * BANDS + 1, dtype=np.uint64)
                for r in range(ROWS):
                    half = mix64(half * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::ROWS])
                half = half.view(np.int64)
                yield pd.DataFrame({
                    "doc_id": ids[full], "tag": tags[full], "n": sizes, "d1": digest[0], "d2": digest[1], "sig": [x.tobytes() for x in sig],
                    "half_a": list(half[:, :BANDS]), "half_b": list(half[:, BANDS:]),
                })

    return body


def shared_buckets(classes: DataFrame) -> DataFrame:
    """(key, rep, hub, hub_degree, c): the members of table buckets of two or more (``c``), and the bucket's hub.

    Counts and hubs are combinable aggregates joined back by key, so that Spark can split the
    join of a hot key; a window over the bucket could not be split.
    """
    slots = classes.select("rep", F.posexplode(F.concat("half_a", "half_b")).alias("slot", "half"))
    counts = slots.groupBy("half").agg(F.count("*").alias("mates")).where("mates > 1")
    side = lambda test: F.collect_list(F.when(test, F.col("half")))  # noqa: E731  at most BANDS values
    mine = slots.join(counts, "half").groupBy("rep").agg(side(F.col("slot") < BANDS).alias("a"), side(F.col("slot") >= BANDS).alias("b"), F.sum(F.col("mates") - 1).alias("degree"))
    tables = mine.where("size(a) > 0 AND size(b) > 0").select("rep", "degree", "b", F.explode("a").alias("a")).select("rep", "degree", "a", F.explode("b").alias("b"))
    tables = written(tables.select(F.xxhash64("a", "b").alias("key"), "rep", "degree"), "tables")
    top = F.max(F.struct("degree", (-F.col("rep")).alias("minus")))
    heads = tables.groupBy("key").agg(F.count("*").alias("c"), top.alias("top")).where("c > 1").select("key", "c", (-F.col("top.minus")).alias("hub"), F.col("top.degree").alias("hub_degree"))
    return tables.join(heads, "key").select("key", "rep", "hub", "hub_degree", "c")


def agreement(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs whose signatures agree enough for the threshold to be plausible."""
    for frame in frames:
        a, b = (np.frombuffer(b"".join(frame.pop(c)), np.uint32).reshape(-1, HASHES) for c in ("sig", "hub_sig"))
        yield frame[(a == b).mean(1) >= PLAUSIBLE][["rep", "hub", "hub_degree"]]


def confirm(width: int) -> Callable:
    """Pairs whose full sets reach the threshold."""

    def body(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, hubs = frame["text"].tolist(), frame["hub_text"].tolist()
            known: dict[str, np.ndarray] = {}
            for a, b in slices(np.fromiter((len(x) + len(y) for x, y in zip(texts, hubs)), np.int64, len(texts)), 1 << 21):
                need = set(texts[a:b] + hubs[a:b])
                new = sorted(need - known.keys())
                known = {x: known[x] for x in need if x in known} | dict(zip(new, shingle_sets([x.encode() for x in new], width)))
                linked = []
                for x, y in zip(texts[a:b], hubs[a:b]):
                    s, t = known[x], known[y]
                    both = int(np.count_nonzero(t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s))
                    linked.append(100 * both >= PERCENT * (len(s) + len(t) - both))
                yield frame.iloc[a:b][linked][["rep", "hub"]]

    return body


def block_links(group: pd.DataFrame, width: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of one block, as pairs of components: side R against side V.

    Sets are held as their differences from the elements that most of side V has. The symmetric
    difference of two sets is that of their differences, ``|D| + |E| - 2 |D and E|``, and the
    sizes then give the intersection.
    """
    side = group["side"].to_numpy()
    sets = shingle_sets([x.encode() for x in group["text"]], width)
    sig = np.frombuffer(b"".join(group["sig"]), np.uint32).reshape(-1, HASHES)
    comp = group["comp"].to_numpy()
    v, r = np.flatnonzero(side == "V"), np.flatnonzero(side == "R")
    if not len(v) or not len(r):
        return []
    value, count = np.unique(np.concatenate([sets[k] for k in v]), return_counts=True)
    common = value[2 * count > len(v)]
    diffs = [np.setxor1d(sets[k], common, assume_unique=True) for k in v]
    n, apart_v = np.array([len(sets[k]) for k in v]), np.array([len(x) for x in diffs])
    order = np.argsort(np.concatenate(diffs), kind="stable")
    value, owner = np.concatenate(diffs)[order], np.repeat(np.arange(len(v)), apart_v)[order]
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    out, sig_v, comp_v = [], sig[v], comp[v]
    for k in r.tolist():
        plausible = ((sig_v == sig[k]).mean(1) >= PLAUSIBLE) & (comp_v != comp[k])
        if not plausible.any():
            continue
        d = np.setxor1d(sets[k], common, assume_unique=True)
        lo, hi = np.searchsorted(value, d), np.searchsorted(value, d, side="right")
        spans = [owner[x:y] for x, y in zip(lo.tolist(), hi.tolist()) if y > x]
        shared = np.bincount(np.concatenate(spans), minlength=len(v)) if spans else np.zeros(len(v), np.int64)
        apart = len(d) + apart_v - 2 * shared
        both = (len(sets[k]) + n - apart) // 2
        for j in np.flatnonzero(plausible & (100 * both >= PERCENT * (both + apart))).tolist():
            a, b = top(int(comp[k])), top(int(comp_v[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(comp[k]), int(comp_v[j])))
    return out


def residual(width: int) -> Callable:
    """``block_links`` of all blocks of a partition sorted by block."""

    def body(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in whole_groups(frames, ["hub", "bv", "br"]):
            yield pd.DataFrame(block_links(group, width), columns=["a", "b"], dtype=np.int64)

    return body


def with_component(rows: DataFrame, label: DataFrame, col: str, name: str) -> DataFrame:
    """``rows`` with the component of ``col``; without a label it is its own."""
    return rows.join(small(label.toDF(col, name), ID_BOUND), col, "left").withColumn(name, F.coalesce(name, col))


def class_components(rows: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(node, component) of the classes that are linked with others."""
    buckets = written(shared_buckets(classes), "buckets")
    sig = classes.select("rep", "sig")
    pairs = buckets.where("rep <> hub").select("rep", "hub", "hub_degree").distinct()
    both = pairs.join(sig, "rep").join(sig.toDF("hub", "hub_sig"), "hub").select("rep", "hub", "hub_degree", "sig", "hub_sig")
    star = written(both.mapInPandas(tidy(agreement), "rep long, hub long, hub_degree long"), "star")

    def texts_of(reps: DataFrame) -> DataFrame:
        need = written(classes.join(small(written(reps.distinct(), "needed"), ID_BOUND), "rep", "left_semi").select("rep", F.col("low").alias("doc_id"), "tag"), "needed")
        return written(rows.join(small(need, ID_BOUND), ["doc_id", "tag"]).select("rep", "text").dropDuplicates(["rep"]), "texts")

    texts = texts_of(star.select("rep").union(star.select("hub")))

    def links_of(some: DataFrame) -> DataFrame:
        beside = some.join(texts, "rep").join(texts.toDF("hub", "hub_text"), "hub").select("rep", "hub", "text", "hub_text")
        return written(beside.mapInPandas(tidy(confirm(width)), "rep long, hub long").toDF("a", "b"), "links")

    best = star.groupBy("rep").agg(F.max(F.struct("hub_degree", (-F.col("hub")).alias("minus"))).alias("m")).select("rep", (-F.col("m.minus")).alias("hub"))
    best = written(best, "best")
    label = components(links_of(best))
    left = star.select("rep", "hub").join(best, ["rep", "hub"], "left_anti")
    left = with_component(with_component(left, label, "rep", "cr"), label, "hub", "ch").where("cr <> ch")
    left = written(left, "open")
    found = links_of(left.select("rep", "hub")).toDF("rep", "hub").join(left, ["rep", "hub"]).select(F.col("cr").alias("a"), F.col("ch").alias("b"))
    label = extended(label, found)

    # hubs are decided; the other members of a bucket may still lie in several components
    others = with_component(buckets.where("rep <> hub AND c > 2").select("key", "hub", "rep"), label, "rep", "comp")
    mixed = others.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most").select("key")
    rest = written(others.join(mixed, "key", "left_semi").select("hub", "rep", "comp").distinct(), "rest")
    per_comp = rest.groupBy("hub", "comp").agg(F.count("*").alias("m"))
    stats = per_comp.groupBy("hub").agg(F.sum("m").alias("members"), F.max(F.struct("m", (-F.col("comp")).alias("minus"))).alias("main"))
    stats = stats.select("hub", (-F.col("main.minus")).alias("main"), F.ceil(F.col("members") / BLOCK).cast("int").alias("nv"), F.ceil((F.col("members") - F.col("main.m")) / BLOCK).cast("int").alias("nr")).where("nr > 0")
    texts = texts_of(rest.select("rep"))
    full = rest.join(small(written(stats, "stats"), ID_BOUND), "hub").join(texts, "rep").join(sig, "rep")
    mine = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    v = full.select("hub", "rep", "comp", "sig", "text", F.lit("V").alias("side"), mine("nv").alias("bv"), all_of("nr").alias("br"))
    r = full.where("comp <> main").select("hub", "rep", "comp", "sig", "text", F.lit("R").alias("side"), all_of("nv").alias("bv"), mine("nr").alias("br"))
    blocks = v.union(r).repartition("hub", "bv", "br").sortWithinPartitions("hub", "bv", "br", "side", "rep")
    return extended(label, blocks.mapInPandas(tidy(residual(width)), "a long, b long"))


def near_rows(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, tag, n, component_id) of each row; ``tag`` is a hash of its text."""
    bounded_batches(docs.sparkSession)
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tag", F.xxhash64("text"))
    rows = every.where("doc_id IS NOT NULL")
    feats = written(rows.mapInPandas(tidy(features(width)), "doc_id long, tag long, n long, d1 long, d2 long, sig binary, half_a array<long>, half_b array<long>"), "features")
    first = [F.first(c).alias(c) for c in ("sig", "half_a", "half_b")]
    classes = feats.where("n > 0").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "tag")).alias("least"), F.count("*").alias("rows"), *first)
    classes = written(classes.select(F.monotonically_increasing_id().alias("rep"), "d1", "d2", F.col("least.doc_id").alias("low"), F.col("least.tag").alias("tag"), "rows", "sig", "half_a", "half_b"), "classes")
    label = written(class_components(rows, classes, width), "labels")
    named = classes.select("rep", "d1", "d2", "low", "rows").join(small(label.toDF("rep", "component"), ID_BOUND), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    # rows of a class of their own need no look-up
    named = written(named.where(F.col("rows") > 1).unionByName(named.where("rows = 1").join(small(label.select(F.col("node").alias("rep")), ID_BOUND), "rep", "left_semi")), "named")
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    answer = written(named.join(least, "component").select("d1", "d2", "component_id"), "answer")
    out = feats.select("doc_id", "tag", "n", "d1", "d2").join(small(answer, ID_BOUND // 2), ["d1", "d2"], "left")
    out = out.select("doc_id", "tag", "n", F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    nothing = F.lit(None).cast("long")
    return out.union(every.where("doc_id IS NULL").select("doc_id", "tag", nothing.alias("n"), nothing.alias("component_id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Components of documents linked by ``width``-word shingle sets of similarity 0.8 or more.

    Returns doc_id, n_shingles, component_id, kept, one row per row. Null, empty and blank texts
    have an empty set and are linked with nothing. Rows with the same id are judged each by its
    own text. Equal sets are one class (by a 128-bit digest of 64-bit shingle hashes); ties in
    degree go to the smaller class number. Very long texts are taken whole. A row without an id
    is linked with nothing, and its results are null. Other columns are ignored; no rows give
    no rows.
    """
    rows = near_rows(docs, id_col, text_col, width)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id, and rows without an id.

    Columns may have any names and are passed on. Rows with the same id and text stay or go
    together; otherwise as ``near_duplicates``.
    """
    gone = written(near_rows(docs, id_col, text_col, width).where("doc_id <> component_id").select("doc_id", "tag").distinct(), "dropped")
    mine = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tag"), F.struct("*").alias("row"))
    return mine.join(small(gone, ID_BOUND), ["doc_id", "tag"], "left_anti").select("row.*")
