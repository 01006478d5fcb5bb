"""Hierarchy operators over nodes (id, parent, rank)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle

#: Nodes up to which the driver climbs a hierarchy itself.
SMALL = 200_000


def merge_nodes(*sources: DataFrame) -> DataFrame:
    """Union of node tables. An id with two different parents, or two ranks, in different rows raises.

    A row that names no parent or no rank leaves it to the others.
    """
    rows = sources[0]
    for more in sources[1:]:
        rows = rows.unionByName(more)
    one = rows.withColumn("parent", F.nullif("parent", F.lit(""))).groupBy("id").agg(
        F.min("parent").alias("parent"), F.max("parent").alias("p"), F.min("rank").alias("rank"), F.max("rank").alias("r"))
    bad = F.raise_error(F.concat(F.lit('Conflicting values found for "'), F.col("id"), F.lit('".'))).cast("string")
    return one.select("id", F.when((F.col("parent") != F.col("p")) | (F.col("rank") != F.col("r")), bad).otherwise(F.col("parent")).alias("parent"), "rank")


def merge_names(*sources: DataFrame) -> DataFrame:
    rows = sources[0]
    for more in sources[1:]:
        rows = rows.unionByName(more)
    one = rows.groupBy("id").agg(F.min("name").alias("name"), F.max("name").alias("n"))
    bad = F.raise_error(F.concat(F.lit('Conflicting values found for "'), F.col("id"), F.lit('".'))).cast("string")
    return one.select("id", F.when(F.col("name") != F.col("n"), bad).otherwise(F.col("name")).alias("name"))


def fill_root(nodes: DataFrame) -> DataFrame:
    """Nodes with exactly one root, a node that is its own parent.

    Parents that are no nodes are added. A lone node without a parent becomes the root; where
    there are several, a new root stands over them: the smallest positive number that is no id.
    """
    missing = nodes.filter("parent is not null").select(F.col("parent").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    whole = nodes.unionByName(missing.select("id", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("rank")))
    crown = whole.filter("parent is null or parent = id").select("id").take(2)
    if not crown:
        if nodes.take(1):
            raise ValueError("The hierarchy has no top: its nodes form a cycle.")
        return whole
    top = F.col("parent").isNull() | (F.col("parent") == F.col("id"))
    if len(crown) == 1:
        return whole.withColumn("parent", F.when(top, F.col("id")).otherwise(F.col("parent")))
    root = _unused(whole)
    made = whole.sparkSession.createDataFrame([(root, root, None)], whole.schema)
    return whole.withColumn("parent", F.when(top, F.lit(root)).otherwise(F.col("parent"))).unionByName(made)


def _unused(nodes: DataFrame, block: int = 4096) -> str:
    at = 1
    while True:
        free = nodes.sparkSession.range(at, at + block).select(F.col("id").alias("n")).join(nodes, F.col("n").cast("string") == F.col("id"), "left_anti")
        least = free.agg(F.min("n")).first()[0]
        if least is not None:
            return str(least)
        at += block


def lineages(nodes: DataFrame, small: int = SMALL) -> DataFrame:
    """id, parent, rank, lineage (from the root to the node itself) of nodes with a root. A cycle raises.

    Up to ``small`` nodes are climbed by the driver. Beyond, chains of ancestors double in each
    round of joins, so deep trees take as many rounds as their depth has binary digits.
    """
    found = nodes.select("id", "parent", "rank").limit(small + 1).toArrow()
    if found.num_rows <= small:
        ids, parents = found.column("id").to_pylist(), found.column("parent").to_pylist()
        up, known = dict(zip(ids, parents, strict=True)), {}
        for i in ids:
            path = []
            while i not in known:
                path.append(i)
                if up[i] is None or up[i] == i:
                    known[path.pop()] = [i]
                elif len(path) > len(ids):
                    raise ValueError("The hierarchy holds a cycle.")
                else:
                    i = up[i]
            for child in reversed(path):
                known[child] = [*known[up[child]], child]
        lines = pa.array([known[i] for i in ids], pa.list_(pa.string()))
        return nodes.sparkSession.createDataFrame(found.append_column("lineage", lines))
    tree = settle(nodes)
    chains = tree.select("id", F.array("id").alias("chain"), F.when(F.col("parent") != F.col("id"), F.col("parent")).alias("next"))
    for _ in range(40):
        chains = settle(chains)
        state = chains.agg(F.count("next").alias("open"), F.max(F.array_contains("chain", F.col("next"))).alias("cycle")).first()
        if state["cycle"]:
            raise ValueError("The hierarchy holds a cycle.")
        if not state["open"]:
            break
        above = chains.select(F.col("id").alias("a"), F.col("chain").alias("more"), F.col("next").alias("beyond"))
        open_ = chains.filter("next is not null").join(above, F.col("next") == F.col("a"))
        grown = open_.select("id", F.concat("chain", "more").alias("chain"), F.col("beyond").alias("next"))
        chains = chains.filter("next is null").unionByName(grown)
    return tree.join(chains.select("id", F.reverse("chain").alias("lineage")), "id")


def rank_lookup(lined: DataFrame, ranks: list[str]) -> DataFrame:
    """subject, rank, taxon: the nearest ancestor, or the node itself, of each of the ranks."""
    level = lined.select("id", F.posexplode("lineage").alias("depth", "ancestor"))
    ranked = lined.filter(F.col("rank").isin(ranks)).select(F.col("id").alias("a"), "rank")
    return level.join(ranked, F.col("ancestor") == F.col("a")).groupBy(F.col("id").alias("subject"), "rank").agg(F.max_by("ancestor", "depth").alias("taxon"))


def common_prefix(a: Column, b: Column) -> Column:
    """The longest common prefix of two arrays."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    first = F.aggregate(pairs, F.lit(0), lambda n, p: F.when((n >= 0) & p.getField("a").eqNullSafe(p.getField("b")), n + 1).otherwise(F.when(n >= 0, -n - 1).otherwise(n)))
    return F.slice(a, F.lit(1), F.when(first < 0, -first - 1).otherwise(first))


def lca(groups: DataFrame, lined: DataFrame, keys: list[str], member: str = "subject") -> DataFrame:
    """keys, lca: the deepest node above all members of a group, or one of them; null if any is no node.

    The first and the last lineage in order differ as early as any two do.
    """
    joined = groups.join(lined.select(F.col("id").alias(member), "lineage"), member, "left")
    met = joined.groupBy(*keys).agg(F.min("lineage").alias("lo"), F.max("lineage").alias("hi"), F.count_if(F.col("lineage").isNull()).alias("unknown"))
    return met.select(*keys, F.when(F.col("unknown") == 0, F.try_element_at(common_prefix(F.col("lo"), F.col("hi")), F.lit(-1))).alias("lca"))


def lineage_strings(lined: DataFrame, names: DataFrame | None = None, include_self: bool = False, include_root: bool = False) -> DataFrame:
    """id, Lineage: the nodes above, joined by ';', by name where ``names`` has one."""
    rows = lined.select("id", "lineage")
    path = F.slice("lineage", F.lit(1 if include_root else 2), F.greatest(F.size("lineage") - (0 if include_root else 1) - (0 if include_self else 1), F.lit(0)))
    if names is None:
        return rows.select("id", F.array_join(path, ";").alias("Lineage"))
    level = rows.select("id", F.posexplode_outer(path).alias("i", "node"))
    named = level.join(names.select(F.col("id").alias("node"), "name"), "node", "left")
    listed = named.groupBy("id").agg(F.sort_array(F.collect_list(F.when(F.col("node").isNotNull(), F.struct("i", F.coalesce("name", "node").alias("n"))))).alias("l"))
    return listed.select("id", F.array_join(F.transform("l", lambda x: x.getField("n")), ";").alias("Lineage"))
