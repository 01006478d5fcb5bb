import random

import numpy as np
import pytest

import cladeflow.llm.ngram_join as module
from cladeflow.llm.components import connected_components
from cladeflow.llm.ngram_join import link_documents


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    sets = []
    for _, text in rows:
        w = lower(text or "").encode().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    heads = {}
    for i, (d, _) in enumerate(rows):
        heads[root(i)] = min(d, heads.get(root(i), d))
    return sorted((d, len(sets[i]), heads[root(i)]) for i, (d, _) in enumerate(rows))


def texts(seed, n, families):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "And", *(f"w{rng.randrange(400)}" for _ in range(4))])
    boiler = " ".join(word() for _ in range(30))
    bases = [[word() for _ in range(rng.choice([3, 5, 12, 40, 120]))] for _ in range(families)]
    out = []
    for _ in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = word()
        text = rng.choice([" ", "\n", "  "]).join(w)
        out.append(text + " " + boiler if rng.random() < 0.4 else text.upper() if rng.random() < 0.1 else text)
    return out + ["", " \t", None, "one", "ONE", "a b c d", "a  b\nc d", "x"]


@pytest.mark.parametrize(("seed", "families", "run", "held"), [(1, 6, 8, 300_000), (2, 40, 2, 300_000), (3, 3, 3, 20)])
def test_against_all_pairs(spark, monkeypatch, seed, families, run, held):
    monkeypatch.setattr(module, "SMALL_RUN", run)
    monkeypatch.setattr(module, "HELD_GRAMS", held)
    rows = list(enumerate(texts(seed, 160, families)))
    random.Random(seed).shuffle(rows)
    rows = [(i * 7 % 1000, t) for i, t in rows]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, key string, n int")
    got = sorted(tuple(r) for r in link_documents(df).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute(rows)


def test_nulls_repeats_and_nothing(spark):
    df = spark.createDataFrame([(None, "a b c"), (5, "A b c"), (5, "A b c"), (None, "q"), (7, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in link_documents(df).collect()), key=str)
    assert got == sorted([(None, 1, 5), (5, 1, 5), (5, 1, 5), (None, 1, None), (7, 0, 7)], key=str)
    assert link_documents(df.limit(0)).count() == 0


def test_filters_keep_all_links():
    rng = np.random.default_rng(0)
    for _ in range(300):
        x = np.unique(rng.integers(0, 2**63, rng.integers(1, 40), dtype=np.uint64) * np.uint64(2))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.9], rng.integers(0, 2**63, rng.integers(0, 5), dtype=np.uint64)]))
        shared = np.intersect1d(x, y)
        if not len(y) or 100 * len(shared) < 75 * len(np.union1d(x, y)):
            continue
        first = shared[0]
        i, j = np.searchsorted(x, first), np.searchsorted(y, first)
        assert i < module.prefix_length(len(x)) and j < module.prefix_length(len(y))
        one = lambda v: np.array([v])
        assert module.passes(one(len(x)), one(i), one(len(y)), one(j))[0]
        bins = [np.frombuffer(module.profile(v), np.uint8).reshape(1, -1) for v in (x, y)]
        assert module.overlap_bound(*bins)[0] >= len(shared)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(1000, i) for i in range(900, 990)] + [(5, 5)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in up if any(i in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def halves(x, y, depth):
    """The suffix filter as published: a lower bound on how many elements of two sorted sets differ."""
    if depth == 0 or not len(x) or not len(y):
        return abs(len(x) - len(y))
    probe = y[len(y) // 2]
    i, j = np.searchsorted(x, probe), len(y) // 2
    own = int(i < len(x) and x[i] == probe)
    return halves(x[:i], y[:j], depth - 1) + halves(x[i + own:], y[j + 1:], depth - 1) + 1 - own


def test_suffix_filter_bounds_and_prunes():
    rng = np.random.default_rng(1)
    ours = published = 0
    for _ in range(400):
        n = int(rng.integers(20, 300))
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.random()], rng.integers(0, 2**63, int(n * rng.random() * 0.6), dtype=np.uint64) * np.uint64(2)]))
        shared, total = len(np.intersect1d(x, y)), len(x) + len(y)
        bound = int(module.overlap_bound(*[np.frombuffer(module.profile(v), np.uint8).reshape(1, -1) for v in (x, y)])[0])
        assert bound >= shared
        need = -(-total * 75 // 175)
        if shared < need <= min(len(x), len(y)):
            ours += bound < need
            published += (total - halves(x, y, 2)) // 2 < need
    assert ours > published > 0


def test_long_texts_and_a_large_family(spark, monkeypatch):
    monkeypatch.setattr(module, "REMEMBERED", 3)
    monkeypatch.setattr(module, "NAMED", 2)
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(3000)}"
    long = [word() for _ in range(21_000)]
    rows = [(1, " ".join(long)), (2, " ".join([*long[:10_000], *(word() for _ in range(300)), *long[10_000:]])), (3, " ".join(reversed(long)))]
    passage = [word() for _ in range(60)]
    for i in range(120):  # a shared passage, own words, and in a third of them a near copy of the one before
        own = [word() for _ in range(50)]
        if i % 3 == 2:
            own = [*last[:20], word(), *last[21:]]
        rows.append((10 + i, " ".join(passage + own)))
        last = own
    got = sorted(tuple(r) for r in link_documents(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute(rows)
