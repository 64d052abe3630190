import hashlib
import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import near_dup
from chronoweave.llm.components import components
from chronoweave.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from chronoweave.llm.near_dup import drop_near_duplicates, near_duplicates, shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width=2):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(*(w[k:] for k in range(width)))) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute_components(rows, width=2):
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_exact_odd_rows(spark, odd, none):
    docs = odd.collect()
    norm = {r.doc_id: (r.text or "").translate(LOWER) for r in docs}
    got = exact_duplicates(odd).collect()
    assert len(got) == len(docs)
    for r in got:
        same = [d.doc_id for d in docs if norm[d.doc_id] == norm[r.doc_id]]
        assert (r.keep_id, r.group_size) == (max(same), len(same))
        assert r.text_sha256 == hashlib.sha256(norm[r.doc_id].encode()).hexdigest()
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in got) == len(set(norm.values()))  # one row of repeated rows stays
    assert drop_exact_duplicates(odd).columns == odd.columns
    assert drop_exact_duplicates(odd).count() == len(set(norm.values()))
    assert exact_duplicates(none).count() == 0 and drop_exact_duplicates(none).count() == 0


def test_exact_checks_bytes_on_colliding_digests(spark, odd):
    """With a digest of two values nearly everything collides, and nothing changes."""
    weak = exact_duplicates(odd, digest=F.substring(F.sha2("norm", 256), 1, 1))
    key = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, weak.select(*key).collect())) == sorted(map(tuple, exact_duplicates(odd).select(*key).collect()))


def test_exact_of_rows_that_are_not_from_files(spark):
    rows = [(1, "a", "x"), (1, "A", "x"), (1, "a", "x"), (None, "b", "x"), (None, "b", "y"), (2, "b", "z"), (3, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, locator string")
    assert [(r.doc_id, r.group_size) for r in exact_duplicates(docs).where("kept").orderBy("doc_id").collect()] == [(1, 3), (2, 3), (3, 1)]
    left = drop_exact_duplicates(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 3]


def test_exact_over_many_batches(spark, odd):
    """A state that is carried over micro-batches of a file each gives the same groups."""
    key = ["doc_id", "keep_id", "group_size", "kept"]
    one = exact_duplicates(odd.repartition(6), batch_bytes=1).select(*key).collect()
    assert sorted(map(tuple, one))[0][0] == 1
    assert {(r.doc_id, r.keep_id, r.group_size) for r in one} == {(r.doc_id, r.keep_id, r.group_size) for r in exact_duplicates(odd).collect()}


def make_near(seed=4):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(4000)]
    rows, n = [], 0
    for _ in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(3, 120))]
        for _ in range(rnd.choice([1, 1, 2, 5, 30])):
            words = [w if rnd.random() > 0.07 * rnd.random() else rnd.choice(vocabulary) for w in base]
            rows.append((n, " ".join(words)))
            n += 1
    hub = [rnd.choice(vocabulary) for _ in range(150)]
    for _ in range(120):  # a group around a text, many of whose pairs are below the threshold
        cut = rnd.sample(range(150), rnd.randint(2, 16))
        rows.append((n, " ".join(rnd.choice(vocabulary) if k in cut else w for k, w in enumerate(hub))))
        n += 1
    return rows


def components_of(spark, rows, **more):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **more).collect()}


@pytest.mark.parametrize("block", [128, 16])
def test_near_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rows = make_near()
    assert components_of(spark, rows, width=2) == brute_components(rows)


def test_near_with_five_words(spark):
    rows = make_near(11)
    assert components_of(spark, rows) == brute_components(rows, 5)


def altered(rnd, words, n):
    cut = set(rnd.sample(range(len(words)), n))
    return [f"v{rnd.randrange(10**9)}" if k in cut else w for k, w in enumerate(words)]


def drifting(rnd):
    """Six chains: each copy alters 4 of the 120 words of the one before."""
    for c in range(6):
        words = [f"c{c}w{rnd.randrange(10**6)}" for _ in range(120)]
        for _ in range(131):
            yield words
            words = altered(rnd, words, 4)


def branching(rnd):
    """Each copy alters 5 words, just above the threshold, of any earlier copy."""
    for c in range(6):
        family = [[f"c{c}w{rnd.randrange(10**6)}" for _ in range(120)]]
        for _ in range(129):
            family.append(altered(rnd, rnd.choice(family), 5))
        yield from family


def linked_at_random(rnd):
    """Texts that keep a template and draw from a small stock: similarities from 0.5 to 0.9."""
    for c in range(3):
        template = [f"t{c}x{k}" for k in range(100)]
        stock = [[f"s{c}y{k}z{j}" for j in range(3)] for k in range(100)]
        for _ in range(150):
            yield [rnd.choice(stock[k]) if rnd.random() < 0.14 else w for k, w in enumerate(template)]


@pytest.mark.parametrize("shape", [drifting, branching, linked_at_random])
@pytest.mark.parametrize("block", [128, 16])
def test_near_in_chains_trees_and_random_graphs(spark, monkeypatch, shape, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rnd = random.Random(3)
    texts = [" ".join(x) for x in shape(rnd)]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    assert components_of(spark, rows, width=2) == brute_components(rows)


def test_recall_at_the_threshold(spark):
    """Pairs of a similarity of 0.80 to 0.82, each on its own: at least 0.99 are found."""
    rnd, rows = random.Random(21), []
    for c in range(1500):
        words = [f"p{c}w{k}" for k in range(110)]
        at = range(rnd.randrange(9), 110, 19)  # six words apart, each of which changes two shingles
        rows += [(2 * c, " ".join(words)), (2 * c + 1, " ".join(f"q{k}" if k in at else w for k, w in enumerate(words)))]
    want, got = brute_pairs(rows), components_of(spark, rows, width=2)
    assert len(want) > 1400
    assert sum(got[a][1] == got[b][1] for a, b in want) >= 0.99 * len(want)


def brute_pairs(rows):
    sets = [shingles(t) for _, t in rows]
    pairs = [(k, k + 1) for k in range(0, len(rows), 2)]
    return [(a, b) for a, b in pairs if 80 <= 100 * len(sets[a] & sets[b]) / len(sets[a] | sets[b]) < 83]


def test_near_between_a_large_and_a_small_hub(spark):
    """C links with B only, resembles the hub A of a large group, and A is further from B, the hub of a small group."""
    rnd = random.Random(7)
    rows = []
    for k in range(30):
        word = iter(f"t{k}x{j}" for j in range(10_000))
        take = lambda n: [next(word) for _ in range(n)]  # noqa: E731, B023
        shared, own = take(100), take(70)
        a = shared + take(60)
        b = take(18) + shared[18:] + own  # beside C, about 0.81
        rows += [(" ".join(a[: len(a) - j] + take(j)),) for j in range(12)]
        rows += [(" ".join(shared + own),), (" ".join(b),)]
        rows += [(" ".join(b[: len(b) - 7 - j] + take(7 + j)),) for j in range(5)]  # beside B, too far from C
    rnd.shuffle(rows)
    rows = [(n, x) for n, (x,) in enumerate(rows)]
    assert components_of(spark, rows, width=2) == brute_components(rows)


def test_near_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "ID_BOUND", 0)
    rows = make_near(9)[:60]
    assert components_of(spark, rows, width=2) == brute_components(rows)


def test_near_odd_rows(spark, odd, none):
    got = near_duplicates(odd, width=2).collect()
    want = brute_components({(r.doc_id, r.text) for r in odd.collect()})
    assert len(got) == odd.count()
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in got)
    assert drop_near_duplicates(odd).columns == odd.columns
    assert near_duplicates(none).count() == 0 and drop_near_duplicates(none).count() == 0


def test_near_null_ids_and_one_id_with_two_texts(spark):
    far, near = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    docs = spark.createDataFrame([(None, far), (None, far), (1, near), (1, far), (2, far), (3, near + " more")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.component_id or 0) for r in near_duplicates(docs).collect()))
    assert got == [(0, 0), (0, 0), (1, 1), (1, 1), (2, 1), (3, 1)]
    assert sorted((r.doc_id or 0) for r in drop_near_duplicates(docs).collect()) == [0, 0, 1, 1]


def test_signatures_estimate_similarity():
    a = " ".join(f"w{k}" for k in range(400))
    b = " ".join(f"w{k}" if k % 20 else f"v{k}" for k in range(400))
    s, t = shingle_sets([a.encode(), b.encode()])
    sig = near_dup.signatures([s, t], 2000)
    exact = len(np.intersect1d(s, t)) / len(np.union1d(s, t))
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.04


def test_components_of_paths_stars_and_cycles(spark):
    links = [(k, k + 1) for k in range(200)] + [(300, k) for k in range(301, 340)] + [(400, 401), (401, 402), (402, 400), (500, 500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(201)) and all(got[k] == 300 for k in range(300, 340)) and all(got[k] == 400 for k in (400, 401, 402))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
