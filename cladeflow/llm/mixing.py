"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prefix_sums, settle, words

#: Mean rows of a cell, the run of one source's documents that one task orders.
CELL_ROWS = 1_000
#: Blocks of a shard.
SHARD_BLOCKS = 64
#: A corpus is cut into about this many blocks; a block has 16 to 4096 words.
BLOCKS = 200_000


def fill(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Targets that share the sum of ``sizes`` by weight, none above ``most`` times its size.

    What exceeds a cap is shared anew by weight among the sources below theirs.
    """
    target, free, rest = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        whole = sum(weights[i] for i in free)
        over = [i for i in sorted(free) if rest * weights[i] / whole > most * sizes[i]]
        if not over:
            for i in free:
                target[i] = rest * weights[i] / whole
            break
        for i in over:
            target[i] = float(most * sizes[i])
            free.discard(i)
        rest = float(sum(sizes)) - sum(target[i] for i in range(len(sizes)) if i not in free)
    return target


def apportion(weights: list[float], seats: int, most: list[int]) -> list[int]:
    """Sainte-Laguë: each seat goes to the highest quotient weight / (2 * seats + 1).

    No party gets more than ``most``; ties go to the earlier one. All seats whose quotient is
    sure to be among the highest are given at once, the last few one by one.
    """
    whole = sum(weights)
    if whole <= 0:
        return [0] * len(weights)
    rate = max(0.0, (seats - len(weights)) / whole)
    out = [min(m, int(w * rate + 0.5)) for w, m in zip(weights, most, strict=True)]
    queue = [(-w / (2 * n + 1), i) for i, (w, n, m) in enumerate(zip(weights, out, most, strict=True)) if w > 0 and n < m]
    heapq.heapify(queue)
    left = seats - sum(out)
    while left > 0 and queue:
        _, i = heapq.heappop(queue)
        out[i] += 1
        left -= 1
        if out[i] < most[i]:
            heapq.heappush(queue, (-weights[i] / (2 * out[i] + 1), i))
    return out


def plan(sizes: list[int], weights: list[float], most: int = 3) -> tuple[int, list[dict]]:
    """Words of a block, and for each source its target and its quotas.

    A source's stream of n blocks is cut into shards of SHARD_BLOCKS blocks, the last one
    perhaps shorter. Shards of equal length have equal quotients: each gets ``base`` blocks and
    ``extra`` of them, chosen by seed, one more.
    """
    total = sum(sizes)
    block = min(4096, max(16, total // BLOCKS))
    targets = fill(sizes, weights, most)
    n = [-(-s // block) for s in sizes]
    quotas = apportion(targets, round(sum(targets) / block), [most * x for x in n])
    out = []
    for t, k, q in zip(targets, n, quotas, strict=True):
        full, tail = divmod(k, SHARD_BLOCKS)
        last = min(most * tail, int(q * tail / k + 0.5)) if tail else 0
        if full * SHARD_BLOCKS * most < q - last:
            last = q - full * SHARD_BLOCKS * most
        if not full:
            last = q
        base, extra = divmod(q - last, full) if full else (0, 0)
        step = next((x for x in range(int(full * 0.618) or 1, 2 * full + 2) if math.gcd(x, full) == 1), 1) if full else 1
        out.append({"target": t, "quota": q, "full": full, "tail": tail, "last": last, "base": base, "extra": extra, "step": step})
    return block, out


def mix_sources(docs: DataFrame, weights=(5, 2, 1), most: int = 3, seed: int = 7,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often, in words, each document is taken into a mix with target weights.

    Returns id_col, source_col, size, source_size, target, taken. Sources in code point order,
    null last, weigh ``weights``, repeated; they share all words, capped at ``most`` times
    their size. Each source's documents, in an order drawn by ``seed``, form one stream of words
    that is cut into blocks of equal length. Sainte-Laguë gives each source its blocks, and each
    of its shards a quota; a shard takes whole rounds of its blocks and a seeded run of them
    once more. ``taken`` is what the chosen blocks hold of the document, repeats counted: at
    most ``most`` times its size, and over a source within a block or two of the target.

    Null texts have size 0 and are taken 0 times. Null sources are one source. Null or repeated
    ids are kept as rows. No rows give no rows. The sources (not the documents) are gathered by
    the driver: they are what a caller gives weights to.
    """
    spark = docs.sparkSession
    light = settle(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.size(words(F.col(text_col))).cast("long").alias("size"),
    ))
    found = light.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8")))
    sizes = [r["size"] for r in found]
    block, plans = plan(sizes, [weights[i % len(weights)] for i in range(len(found))], most)
    table = spark.createDataFrame(
        [(r["source"], r["size"], p["target"], p["full"], p["tail"], p["last"], p["base"], p["extra"], p["step"]) for r, p in zip(found, plans, strict=True)],
        "src string, source_size long, target double, full long, tail long, last long, base long, extra long, step long",
    )
    n_cells = max(1, -(-sum(r["rows"] for r in found) // CELL_ROWS))
    drawn = light.withColumn("draw", F.xxhash64("id", F.lit(seed))).withColumn("cell", F.expr(f"pmod(draw, {n_cells})"))
    starts = prefix_sums(drawn.groupBy("source", "cell").agg(F.sum("size").alias("n")), ["source"], "cell", "n", "cell_start") \
        .select(F.col("source").alias("s1"), F.col("cell").alias("c1"), "cell_start")
    within = Window.partitionBy("source", "cell").orderBy("draw", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        drawn.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(starts, F.col("source").eqNullSafe(F.col("s1")) & (F.col("cell") == F.col("c1")))
        .join(table, F.col("source").eqNullSafe(F.col("src")))
        .withColumn("beg", F.col("cell_start") + F.col("before"))
        .withColumn("end", F.col("beg") + F.col("size"))
    )
    # times that block b of the source is taken: h is its shard, k the shard's blocks, q its quota
    times = f"""
        if(b div {SHARD_BLOCKS} < full,
           (base + if((b div {SHARD_BLOCKS} * step + {seed}) % full < extra, 1, 0)) div {SHARD_BLOCKS}
             + if(pmod(b + xxhash64(b div {SHARD_BLOCKS}, source, {seed}), {SHARD_BLOCKS})
                  < (base + if((b div {SHARD_BLOCKS} * step + {seed}) % full < extra, 1, 0)) % {SHARD_BLOCKS}, 1, 0),
           last div tail + if(pmod(b + xxhash64(b div {SHARD_BLOCKS}, source, {seed}), tail) < last % tail, 1, 0))"""
    taken = f"""
        if(size = 0, 0L, aggregate(sequence(beg div {block}, (end - 1) div {block}), 0L,
           (acc, b) -> acc + (least(end, (b + 1) * {block}) - greatest(beg, b * {block})) * ({times})))"""
    return placed.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
        F.expr(taken).cast("long").alias("taken"),
    )
