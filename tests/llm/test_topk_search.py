import numpy as np
import pytest
from pyspark.sql import functions as F

import cladeflow.llm.topk_search as module
from cladeflow.llm.topk_search import aggregate, search


def brute(ids, x, query_ids, q, k):
    out = []
    for own, row in zip(query_ids, q, strict=True):
        scores = sorted((-int(sum(int(a) * int(b) for a, b in zip(r, row, strict=True))), int(v)) for v, r in zip(ids, x, strict=True) if v != own)
        out.append([(v, -s) for s, v in scores[:k]])
    return out


def gathered(got, n):
    out = [[] for _ in range(n)]
    for who, what, score in zip(*got, strict=True):
        out[who].append((int(what), int(score)))
    return out


@pytest.mark.parametrize(("n", "d", "spread", "block"), [(3, 2, 5, 8), (40, 3, 2, 8), (300, 8, 20, 64), (500, 16, 250, 100), (50, 4, 10**8, 16), (1, 4, 9, 8)])
def test_against_brute_force(monkeypatch, n, d, spread, block):
    monkeypatch.setattr(module, "LIST_BLOCK", block)
    rng = np.random.default_rng(n)
    x = rng.integers(-spread, spread + 1, (n, d)).astype(float)
    ids = rng.permutation(n) * 3
    queries = np.arange(0, n, 4)
    got = gathered(aggregate(ids, x, ids[queries], x[queries], 5), len(queries))
    assert got == brute(ids, x, ids[queries], x[queries], 5)


def test_null_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], "a"), (1, None, "a"), (2, [1.0, None], "a"), (3, [nan, 1.0], "a"), (4, [inf, 1.0], "a"), (5, [], "a"),
            (6, [1.0, 0.5], "a"), (7, [-0.001, 2.0, 9.0], "a"), (None, [1.0, 1.0], "a"), (8, [1.0, 0.5], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = search(df, F.col("vec_id") % 2 == 0, 3).collect()
    kept = {i: [int(np.floor(256 * v)) for v in e] + [0] * (3 - len(e)) for i, e, _ in rows if i in (0, 6, 7, 8)}
    want = set()
    for q in (0, 6, 8):
        scores = sorted((-sum(a * b for a, b in zip(kept[q], kept[c], strict=True)), c) for c in kept if c != q)[:3]
        want |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(scores)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want
    assert search(df.limit(0), F.col("vec_id") % 2 == 0).count() == 0
