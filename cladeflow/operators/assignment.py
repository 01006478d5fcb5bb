"""Assigning queries to taxa.

Hits are rows (sample, query, subject). An assignment has one row per hit: sample, query, subject,
taxon, unique. Of a unique assignment all rows of the query carry the same taxon, null if there
is none; of an ambiguous one each row carries its subject's taxon.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import attached, dealt
from .tree import common_prefix

QUERY = ("sample", "query")


def distinct_hits(hits: DataFrame) -> DataFrame:
    """Hits dealt by query, repeats dropped; what follows by query needs no further exchange."""
    return dealt(hits.select(*QUERY, "subject"), *QUERY).dropDuplicates([*QUERY, "subject"])


def _sorted(rows: DataFrame, keys) -> DataFrame:
    """Rows in the order of all windows by query that follow, which then sort them no more."""
    return rows.sortWithinPartitions(*keys, "subject")


def assign_none(hits: DataFrame, uniq: bool = False) -> DataFrame:
    """Subjects themselves. With ``uniq`` queries of several subjects have no taxon."""
    k = F.count(F.lit(1)).over(Window.partitionBy(*QUERY))
    rows = _sorted(hits, QUERY).withColumn("k", k)
    if uniq:
        return rows.select(*QUERY, "subject", F.when(F.col("k") == 1, F.col("subject")).alias("taxon"), F.lit(True).alias("unique"))
    return rows.select(*QUERY, "subject", F.col("subject").alias("taxon"), (F.col("k") == 1).alias("unique"))


def assign_free(hits: DataFrame, lined: DataFrame, subok: bool = False) -> DataFrame:
    """The lowest common ancestor of a query's subjects, however low or high, but for the root.

    A lone subject goes to its parent, even if that is the root (with ``subok``: stays itself).
    Any subject that is no node leaves the query without a taxon.
    """
    over = Window.partitionBy(*QUERY)
    rows = attached(hits, lined, [F.col("id").alias("subject"), "parent", "lineage"], ["subject"], *QUERY)
    rows = _sorted(rows, QUERY).select(
        *QUERY, "subject", "parent", F.count(F.lit(1)).over(over).alias("k"), F.count("lineage").over(over).alias("known"),
        F.min("lineage").over(over).alias("lo"), F.max("lineage").over(over).alias("hi"))
    shared = common_prefix(F.col("lo"), F.col("hi"))
    many = F.when((F.col("known") == F.col("k")) & (F.size(shared) > 1), F.try_element_at(shared, F.lit(-1)))
    alone = F.col("subject") if subok else F.col("parent")
    return rows.select(*QUERY, "subject", F.when(F.col("k") == 1, alone).otherwise(many).alias("taxon"), F.lit(True).alias("unique"))


def assign_rank(hits: DataFrame, lookup: DataFrame, major: int | None = None, above: bool = False, uniq: bool = False, lined: DataFrame | None = None, by: tuple[str, ...] = (), ranks: list[str] | None = None) -> DataFrame:
    """Taxa of one rank: ``lookup`` (subject, taxon). With ``by`` = ("rank",) those of all ``ranks``, each kept apart.

    A query all of whose subjects have the same taxon (or none) has that. Else, in this order:
    ``major`` percent or more of the subjects agree (no taxon being one of the choices); ``above``
    takes the lowest common ancestor of the taxa, but for the root, if all have one; ``uniq``
    leaves the query without a taxon; and otherwise it is shared by the taxa.
    """
    keys = [*by, *QUERY]
    rows = hits.withColumn("rank", F.explode(F.array(*[F.lit(r) for r in ranks]))) if by else hits
    rows = attached(rows, lookup, ["subject", *by, "taxon"], ["subject", *by], *QUERY)
    over = Window.partitionBy(*keys)
    rows = _sorted(rows, keys).select(
        *keys, "subject", "taxon", F.count(F.lit(1)).over(over).alias("k"), F.count("taxon").over(over).alias("named"),
        F.min("taxon").over(over).alias("lo"), F.max("taxon").over(over).alias("hi"))
    same = (F.col("named") == 0) | ((F.col("named") == F.col("k")) & (F.col("lo") == F.col("hi")))
    if major is not None:
        rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "taxon")))
        enough = F.col("n") >= F.col("k") * F.lit(major / 100)
        rows = rows.withColumn("most", F.max(F.when(enough, F.col("taxon"))).over(over))
        return rows.select(*keys, "subject", F.when(same, F.col("lo")).otherwise(F.col("most")).alias("taxon"), F.lit(True).alias("unique"))
    if above:
        rows = rows.join(lined.select(F.col("id").alias("taxon"), "lineage"), "taxon", "left")
        rows = rows.withColumn("l", F.min("lineage").over(over)).withColumn("h", F.max("lineage").over(over))
        shared = common_prefix(F.col("l"), F.col("h"))
        met = F.when((F.col("named") == F.col("k")) & (F.size(shared) > 1), F.try_element_at(shared, F.lit(-1)))
        return rows.select(*keys, "subject", F.when(same, F.col("lo")).otherwise(met).alias("taxon"), F.lit(True).alias("unique"))
    if uniq:
        return rows.select(*keys, "subject", F.when(same, F.col("lo")).alias("taxon"), F.lit(True).alias("unique"))
    return rows.select(*keys, "subject", "taxon", same.alias("unique"))
