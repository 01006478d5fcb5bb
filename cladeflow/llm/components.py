"""Connected components by distributed union-find: large and small stars until nothing moves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Edges that a task holds at least, so that few edges aren't dealt out to many tasks, round after round.
EDGES = 50_000


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Nodes of ``edges`` (a, b: longs) with the smallest node of their component: node, component.

    Each round hangs every node's larger neighbours, then its smaller ones, under the smallest
    node seen, so paths shrink as in union-find with path halving; no edge list of a node is
    gathered in one place. Loops and nulls are ignored; no edges give no rows.
    """
    now = edges.filter("a is not null and b is not null and a <> b")
    now = settle(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    for _ in range(rounds):
        tasks = state[0] // EDGES + 1
        now = settle(_small(_large(now).coalesce(tasks)).coalesce(tasks))
        new = _state(now)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _state(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").bitwiseAND(0xFFFFFFFF))).first())


def _least(e: DataFrame, key: str, value: str) -> DataFrame:
    """The distinct rows of ``e``, dealt once, by ``key``, with m: the smallest value of the key."""
    own = e.repartition(F.col(key)).dropDuplicates([key, value])
    return own.withColumn("m", F.min(value).over(Window.partitionBy(key)))


def _large(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _least(both, "u", "v").filter("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b"))


def _small(e: DataFrame) -> DataFrame:
    return _least(e, "a", "b").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
