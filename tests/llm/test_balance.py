"""Sharding and mixing."""

import random
import re
import zlib

import numpy as np
import pytest

from cladeflow.llm.mixing import apportion, fill, mix_sources
from cladeflow.llm.sharding import place, shard_documents


def corpus(seed, n, hot=0.3):
    rng = random.Random(seed)
    same = "one text that fills a third of all rows"
    return [(i, same if rng.random() < hot else " ".join(f"w{rng.randrange(10**6)}" for _ in range(int(rng.paretovariate(1.2) * 5)))) for i in range(n)]


def test_shards(spark):
    rows = corpus(1, 3000) + [(None, "x y"), (7, None), (7, ""), (7, "x y")]
    df = spark.createDataFrame([(i, t, "a", 3) for i, t in rows], "doc_id long, text string, shard string, slot int")
    got = shard_documents(df, 8).collect()
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    sums, slots, homes, tokens = np.zeros(8), {}, {}, np.zeros(8)
    for r in got:
        sums[r.shard] += r["size"]
        tokens[r.shard] += r.n_tokens
        slots.setdefault(r.shard, []).append(r.slot)
        homes.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sums.max() < 1.1 * sums.mean() and sums.min() > 0.9 * sums.mean()
    assert tokens.max() < 1.2 * tokens.mean()
    hot = zlib.crc32(b"one text that fills a third of all rows")
    assert len(homes[hot]) == 8 and all(len(h) == 1 for c, h in homes.items() if c != hot)
    counts = [len(s) for s in slots.values()]
    assert max(counts) < 1.2 * np.mean(counts)


def test_shards_are_the_same_again_and_may_be_empty(spark):
    df = spark.createDataFrame(corpus(2, 400), "doc_id long, text string")
    runs = [sorted((r.doc_id, r.shard, r.slot) for r in shard_documents(d, 5).collect()) for d in (df, df.repartition(7))]
    assert runs[0] == runs[1]
    assert shard_documents(df.limit(0), 5).count() == 0
    few = shard_documents(df.limit(2), 5).collect()
    assert len(few) == 2 and all(r.slot == 0 for r in few)


def test_place_takes_the_highest_dot_product():
    residual = np.array([[0.5, 0.5, 0.5], [0.6, 0.1, 0.1]])
    assert place(np.array([[0.3, 0.1, 0.1], [0.1, 0.1, 0.1]]), residual).tolist() == [1, 0]


@pytest.mark.parametrize("seed", range(8))
def test_sainte_lague(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 9)
    weights = [rng.choice([0, 1, 2, 5, rng.random() * 9]) for _ in range(n)]
    most = [rng.randrange(0, 40) for _ in range(n)]
    seats = rng.randrange(0, 90)
    want = [0] * n
    for _ in range(seats):
        left = [i for i in range(n) if weights[i] > 0 and want[i] < most[i]]
        if not left:
            break
        want[min(left, key=lambda i: (-weights[i] / (2 * want[i] + 1), i))] += 1
    assert apportion(weights, seats, most) == want


def test_fill():
    assert fill([10, 10, 10], [5, 2, 1]) == [18.75, 7.5, 3.75]
    assert fill([1, 10, 19], [5, 2, 1]) == [3, 18, 9]
    assert fill([0, 0], [5, 2]) == [0, 0]
    assert sum(fill([1, 2, 400], [5, 2, 1])) == pytest.approx(403)


@pytest.mark.parametrize("n", [3, 60, 4000])
def test_mix(spark, n):
    rng = random.Random(n)
    rows = [(i, t, rng.choice(["a", "é", "B", None, "a", "a"])) for i, t in corpus(n, n, 0.1)] + [(5, None, "a"), (5, " ", "zz"), (None, "q r", "a"), (5, "same", "a"), (5, "same", "a")]
    df = spark.createDataFrame([(*r, 9, 9.0) for r in rows], "doc_id long, text string, source string, size int, taken double")
    got = mix_sources(df).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.doc_id), r["size"], str(r.source)) for r in got) == sorted((str(i), size(t), str(s)) for i, t, s in rows)
    sums = {}
    for _, t, s in rows:
        sums[s] = sums.get(s, 0) + size(t)
    order = sorted(sums, key=lambda s: (s is None, (s or "").encode()))
    targets = dict(zip(order, fill([sums[s] for s in order], [[5, 2, 1][i % 3] for i in range(len(order))]), strict=True))
    taken = {}
    for r in got:
        assert r.source_size == sums[r.source] and r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    block = min(4096, max(16, sum(sums.values()) // 200_000))
    for s in order:
        assert abs(taken[s] - targets[s]) <= 2.5 * block + 0.01 * targets[s]
    again = {(str(r.doc_id), r["size"], str(r.source), r.taken) for r in mix_sources(df.repartition(5)).collect()}
    assert again == {(str(r.doc_id), r["size"], str(r.source), r.taken) for r in got}
    assert mix_sources(df.limit(0)).count() == 0


def test_large_ids_beside_a_null_id(spark):
    ids = [None, *(2**60 + i for i in range(1, 12, 2))]
    df = spark.createDataFrame([(i, f"text {n}") for n, i in enumerate(ids)], "doc_id long, text string")
    got = [r.doc_id for r in shard_documents(df, 2).collect()]
    assert sorted(got, key=str) == sorted(ids, key=str)
