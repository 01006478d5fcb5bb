"""Hierarchy files: nodes and names, Newick, rank columns and lineages. Nodes are (id, parent, rank)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import last_value
from .files import compression, read_lines

# Rank codes of lineage strings, and names that stand for no taxon.
RANK_OF_CODE = {"k": "kingdom", "p": "phylum", "c": "class", "o": "order", "f": "family", "g": "genus", "s": "species", "t": "strain", "d": "kingdom"}
NO_TAXON = ["", "0", "unclassified", "unassigned"]

SCHEMA = "id string, parent string, rank string"


def _fields(lines: DataFrame) -> DataFrame:
    return lines.withColumn("f", F.split(F.replace(F.rtrim("line"), F.lit("\t|"), F.lit("")), "\t"))


def _latest(df: DataFrame, *values: str) -> DataFrame:
    """Of repeated ids the last line holds."""
    order = F.struct("path", "block", "seq")
    return df.groupBy("id").agg(*[F.max_by(v, order).alias(v) for v in values])


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """id, name: of NCBI-style rows with a name class the scientific ones, of others all."""
    rows = _fields(read_lines(spark, path)).filter((F.size("f") >= 2) & ((F.size("f") < 4) | (F.get("f", 3) == "scientific name")))
    return _latest(rows.select("path", "block", "seq", F.get("f", 0).alias("id"), F.get("f", 1).alias("name")), "name")


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """NCBI-style nodes, or id, parent and perhaps rank."""
    rows = _fields(read_lines(spark, path)).filter(F.size("f") >= 2)
    rows = rows.select("path", "block", "seq", F.get("f", 0).alias("id"), F.nullif(F.get("f", 1), F.lit("")).alias("parent"), F.get("f", 2).alias("rank"))
    return _latest(rows, "parent", "rank")


def parse_newick(text: str) -> list[tuple[str, str | None]]:
    """(id, parent) of all nodes of a tree. Lengths, comments and quotes are dropped; every node needs an id of its own."""
    token = re.compile(r"\s+|\[[^\]]*\]|'((?:[^']|'')*)'|([(),;])|:([^(),;\[]*)|([^\s()\[\],:;']+)")
    out: list[tuple[str, str | None]] = []
    seen: set[str] = set()
    open_groups: list[list[str]] = []
    children: list[str] = []  # of the group that was closed last, until it gets its name
    name, at = "", 0

    def finish() -> str:
        nonlocal children, name
        if not name:
            raise ValueError("A node of the tree has no id.")
        if name in seen:
            raise ValueError(f'Duplicate id in the tree: "{name}".')
        seen.add(name)
        out.extend((c, name) for c in children)
        done, name, children = name, "", []
        return done

    for m in token.finditer(text):
        if m.start() != at:
            raise ValueError(f"Unreadable tree at character {at}.")
        at = m.end()
        quoted, mark, _, plain = m.groups()
        if quoted is not None or plain:
            name += plain or quoted.replace("''", "'")
        elif mark == "(":
            open_groups.append([])
        elif mark in (",", ")"):
            if not open_groups:
                raise ValueError("Unbalanced tree.")
            open_groups[-1].append(finish())
            if mark == ")":
                children = open_groups.pop()
        elif mark == ";":
            break
    if open_groups:
        raise ValueError("Unbalanced tree.")
    out.append((finish(), None))
    return out


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    """One tree; a Newick file is one expression and is parsed by the driver."""
    rows = read_lines(spark, path).orderBy("block", "seq").collect()
    nodes = parse_newick("".join(r["line"] for r in rows).strip())
    return spark.createDataFrame([(i, p, None) for i, p in nodes], SCHEMA)


def read_columns(spark: SparkSession, path: str) -> DataFrame:
    """A table with an id and one column per rank, highest first; its header names the ranks.

    Blank cells and names that stand for no taxon are skipped. A taxon under two parents or of two
    ranks raises.
    """
    lines = read_lines(spark, path)
    header = lines.orderBy("block", "seq").first()
    ranks = header["line"].rstrip().split("\t")[1:]
    rows = lines.filter(~((F.col("block") == header["block"]) & (F.col("seq") == header["seq"]))).filter(F.length("line") > 0)
    rows = rows.withColumn("f", F.split(F.rtrim("line"), "\t")).withColumn(
        "taxa", F.transform(F.slice("f", F.lit(2), F.greatest(F.size("f"), F.lit(1))), lambda x: F.when(~x.isin(NO_TAXON), x)))
    tips = _latest(rows.select("path", "block", "seq", F.get("f", 0).alias("id"), last_value(F.col("taxa")).alias("parent")), "parent")
    names = F.array(*[F.lit(r) for r in ranks])
    inner = rows.select(F.posexplode("taxa").alias("i", "id"), "taxa").filter("id is not null").select(
        "id", last_value(F.slice("taxa", F.lit(1), F.col("i"))).alias("parent"), F.get(names, F.col("i")).alias("rank")).distinct()
    return _one_each(tips.withColumn("rank", F.lit(None).cast("string")).unionByName(inner))


def _one_each(nodes: DataFrame) -> DataFrame:
    """Raise where an id has two parents or two ranks; a rank that is named once holds for all."""
    rows = nodes.groupBy("id").agg(
        F.min("parent").alias("parent"), F.min("rank").alias("rank"),
        (F.max(F.struct(F.col("parent").isNotNull(), "parent")) != F.min(F.struct(F.col("parent").isNotNull(), "parent"))).alias("p"),
        F.countDistinct("rank").alias("r"))
    bad = F.raise_error(F.concat(F.lit('Conflict at taxon "'), F.col("id"), F.lit('".'))).cast("string")
    return rows.select("id", F.when(F.col("p") | (F.col("r") > 1), bad).otherwise(F.col("parent")).alias("parent"), "rank")


def read_lineages(spark: SparkSession, path: str) -> DataFrame:
    """Lines of an id and a lineage 'k__A; p__B; ...'. A taxon is named by its whole lineage.

    Empty levels at the end are dropped, those in between stay part of the names below. A code
    such as p__ gives the rank.
    """
    rows = read_lines(spark, path).filter(~F.col("line").startswith("#") & (F.length("line") > 0)).withColumn("f", F.split(F.rtrim("line"), "\t"))
    two = F.when(F.size("f") == 2, F.get("f", 1)).otherwise(F.raise_error(F.concat(F.lit("Not an id and a lineage: "), F.col("line"))).cast("string"))
    rows = rows.select("path", "block", "seq", F.get("f", 0).alias("id"), F.transform(F.split(two, ";"), lambda x: F.trim(x)).alias("levels"))
    prefix = lambda i: F.regexp_replace(F.array_join(F.slice("levels", F.lit(1), i + 1), ";"), "^;+", "")
    real = lambda x: ~F.lower(x).isin(NO_TAXON) & (F.substring(x, F.lit(2), F.length(x)) != "__")
    rows = rows.withColumn("taxa", F.transform("levels", lambda x, i: F.when(real(x), prefix(i))))
    tips = _latest(rows.select("path", "block", "seq", "id", last_value(F.col("taxa")).alias("parent")), "parent")
    code = lambda x: F.regexp_extract(x, "^([a-z])__", 1)
    table = F.create_map(*[F.lit(x) for pair in RANK_OF_CODE.items() for x in pair])
    inner = rows.select(F.posexplode("taxa").alias("i", "id"), "taxa", "levels").filter("id is not null").select(
        "id", last_value(F.slice("taxa", F.lit(1), F.col("i"))).alias("parent"), F.try_element_at(table, code(F.get("levels", F.col("i")))).alias("rank"))
    inner = inner.groupBy("id").agg(F.min("parent").alias("parent"), F.min("rank").alias("rank"))
    return tips.withColumn("rank", F.lit(None).cast("string")).unionByName(inner)


def map_nodes(pairs: DataFrame, rank: str | None = None) -> DataFrame:
    """Nodes of a map (source, target); its targets get ``rank``."""
    nodes = pairs.select(F.col("source").alias("id"), F.col("target").alias("parent"), F.lit(None).cast("string").alias("rank"))
    if rank is None:
        return nodes
    return nodes.unionByName(pairs.select(F.col("target").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(rank).alias("rank")).distinct())
