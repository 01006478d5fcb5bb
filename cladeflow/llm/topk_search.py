"""Exact top-k inner product search by sequential reading of sorted lists (no random access)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Candidates whose lists are read together, and candidates that a task holds.
LIST_BLOCK = 2_048
CANDIDATE_BLOCK = 16_384
#: Depths, as parts of the lists, at which bounds are taken.
DEPTHS = (1 / 2, 3 / 4, 1)
#: Reading stops once this part of a block, or less, can still qualify.
LEFT = 1 / 4


def aggregate(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the k rows of ``x`` with the highest integer inner product, its own id left out.

    Each dimension has a list of candidates sorted by value, read from the top where the query's
    component is positive and from the bottom where it is negative. After reading all lists to
    a depth, a candidate's score lies between what was read of it plus the worst, and plus the
    last read, values of the lists where it has not come up. Reading stops for a query once few
    candidates have an upper bound that reaches the k-th highest lower bound, or the k-th best
    score of the blocks before; nothing outside, not even what no list has shown yet, can then
    qualify. The scores of the rest are resolved. Lists are read for all queries at once: what
    was read to a depth is a masked matrix.

    Returns places of queries, candidate ids and scores, best first, ties to the smaller id.
    """
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if not len(x) or not len(q):
        return best
    top = np.abs(x).max(initial=0) * np.sqrt(x.shape[1]) * np.sqrt((q.astype(float) ** 2).sum(axis=1)).max(initial=0)
    if top >= 2**52:  # beyond the exact range of doubles: whole lists, Python's integers
        return _large(ids, x, query_ids, q, k)
    kind = np.float32 if top < 2**23 else np.float64
    x, q = x.astype(kind), q.astype(kind)
    floor = np.full(len(q), -np.inf)
    for at in range(0, len(x), LIST_BLOCK):
        own_ids, block = ids[at:at + LIST_BLOCK], x[at:at + LIST_BLOCK]
        who, row = _read(own_ids, block, query_ids, q, k, floor)
        scores = np.einsum("ij,ij->i", block[row].astype(np.float64), q[who].astype(np.float64)).astype(np.int64) if len(who) else best[0][:0]
        who, what, scores = (np.concatenate(c) for c in zip(best, (who, own_ids[row], scores), strict=True))
        order = np.lexsort((what, -scores, who))
        who, what, scores = who[order], what[order], scores[order]
        nth = np.arange(len(who)) - np.searchsorted(who, who)
        best = tuple(c[nth < k] for c in (who, what, scores))
        last = nth == k - 1
        floor[who[last]] = scores[last]
    return best


def _read(ids, x, query_ids, q, k, floor) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) that may be among the best, after reading lists as deep as it takes."""
    n, d = x.shape
    order = np.argsort(x, axis=0, kind="stable")
    lists = np.take_along_axis(x, order, axis=0)
    rank = np.empty((n, d), np.int32)
    np.put_along_axis(rank, order, np.arange(n, dtype=np.int32)[:, None], axis=0)
    active, found = np.arange(len(q)), []
    for depth in DEPTHS:
        if not len(active):
            break
        t = max(1, int(n * depth))
        signed = np.hstack([np.maximum(q[active], 0), np.minimum(q[active], 0)])

        def bound(high, low, t=t, signed=signed):
            """Scores, were all unread entries ``high`` in lists read from the top, else ``low``."""
            unread = np.concatenate([high, low])
            return signed @ (np.hstack([np.where(rank >= n - t, x - high, 0), np.where(rank < t, x - low, 0)]) + unread).T

        own = query_ids[active][:, None] == ids[None, :]
        most, reach = bound(lists[n - t], lists[t - 1]), floor[active]
        if n > k and np.isneginf(reach).any():  # no block before has given k scores
            least = bound(lists[0], lists[-1])
            least[own] = -np.inf
            reach = np.maximum(reach, np.partition(least, n - k, axis=1)[:, n - k])
        alive = (most >= reach[:, None]) & ~own
        done = (alive.sum(axis=1) <= max(k, LEFT * n)) | (t == n)
        who, row = np.nonzero(alive & done[:, None])
        found.append((active[who], row))
        active = active[~done]
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _large(ids, x, query_ids, q, k):
    whole = np.vectorize(int, otypes=[object])
    x, out = whole(x), []
    for i, (own, row) in enumerate(zip(query_ids, whole(q), strict=True)):
        scores = sorted((-int(s), int(v)) for s, v in zip(x @ row, ids, strict=True) if v != own)[:k]
        out += [(i, v, -s) for s, v in scores]
    return tuple(np.array([r[c] for r in out], np.int64) for c in range(3))


def search(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Exact search of the rows where ``is_query`` holds against all others.

    Components x count as floor(256 * x). Returns query_id, rank (from 1), id_col, score: the
    ``k`` highest integer inner products, all if there are fewer, ties to the smaller id.

    Vectors that are null or hold a null or non-finite component take no part, nor do null
    ids. Scores must fit a long. Vectors of unequal length are compared as if zeros followed. Rows that share an id
    are each a candidate for others, and none for a query of that id. No rows give no rows.
    Queries and candidates are cut into blocks of bounded size; every pair of blocks is one
    group, and each query keeps k rows of each block.
    """
    fit = vectors.select(F.col(id_col).cast("long").alias("id"), is_query.alias("is_query"), F.col(vector_col).alias("v")) \
        .filter("id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf'))")
    sizes = fit.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_query"), 1)).alias("q")).first()
    n_blocks, q_blocks = -(-sizes["n"] // CANDIDATE_BLOCK) or 1, -(-sizes["q"] // min(4096, max(512, sizes["q"] // 8))) or 1
    hashed = fit.withColumn("h", F.xxhash64("id", F.lit(11)))
    candidates = hashed.select("id", "v", F.lit(False).alias("asks"), F.expr(f"pmod(h, {n_blocks})").alias("c"), F.expr(f"explode(sequence(0L, {q_blocks - 1}L))").alias("q"))
    queries = hashed.filter("is_query").select("id", "v", F.lit(True).alias("asks"), F.expr(f"explode(sequence(0L, {n_blocks - 1}L))").alias("c"), F.expr(f"pmod(h, {q_blocks})").alias("q"))

    def pair(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        asks = table.column("asks").to_numpy()
        lists = table.column("v").combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        full = np.zeros((len(ids), int(lengths.max(initial=0))))
        full[np.arange(full.shape[1])[None, :] < lengths[:, None]] = np.floor(256 * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
        who, found, scores = aggregate(ids[~asks], full[~asks], ids[asks], full[asks], k)
        return pa.table({"query_id": ids[asks][who], "id": found, "score": scores})

    met = candidates.unionByName(queries).groupBy("c", "q").applyInArrow(pair, "query_id long, id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
