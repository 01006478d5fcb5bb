"""Counting assignments into profiles: (sample, [stratum,] feature, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .assignment import QUERY

UNASSIGNED = "Unassigned"


def count_taxa(assigned: DataFrame, sizes: DataFrame | None = None, strata: DataFrame | None = None, unassigned: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Sums over queries by sample and taxon.

    A unique assignment counts once; of an ambiguous one each row with a taxon counts one by the
    number of such rows. With ``sizes`` (subject, size: what a subject's length divides by) a
    unique assignment counts the mean of one by the size over all of its subjects, and an
    ambiguous row its own subject's. With ``strata`` (sample, query, stratum) counts are apart by
    stratum and queries without one are left out. ``unassigned`` counts queries that have no
    taxon, unless they are ambiguous, as Unassigned. A subject without a size raises.
    """
    keys = [*by, *QUERY]
    over = Window.partitionBy(*keys)
    taxon = F.when(F.col("taxon") != "", F.col("taxon"))
    rows = assigned.withColumn("taxon", taxon).select(
        "*", F.count(F.lit(1)).over(over).alias("k"), F.count("taxon").over(over).alias("named"), F.row_number().over(over.orderBy("subject")).alias("nth"))
    if unassigned:
        rows = rows.withColumn("taxon", F.when(F.col("taxon").isNull() & F.col("unique"), F.lit(UNASSIGNED)).otherwise(F.col("taxon")))
    rows = rows.filter("taxon is not null")
    if strata is not None:
        rows = rows.join(strata, list(QUERY))
    if sizes is None:
        rows = rows.filter("not unique or nth = 1")
        value = F.when(F.col("unique"), F.lit(1.0)).otherwise(1 / F.col("named"))
    else:
        rows = rows.join(sizes.select("subject", F.col("size").alias("_size")), "subject", "left")
        lacking = F.raise_error(F.concat(F.lit("Subject without a size: "), F.col("subject"))).cast("double")
        size = F.when(F.col("_size").isNull(), lacking).otherwise(F.col("_size"))
        value = 1 / size / F.when(F.col("unique"), F.col("k")).otherwise(F.col("named"))
    groups = [*by, "sample", *(["stratum"] if strata is not None else []), F.col("taxon").alias("feature")]
    return rows.groupBy(*groups).agg(F.sum(value).alias("value"))


def read_map(assigned: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """sample, query, taxa: the taxon, or 'taxon:count' pairs (most first, then by name) of ambiguous queries; queries without any are left out."""
    rows = assigned.filter("taxon is not null and taxon <> ''")
    counted = rows.groupBy(*QUERY, "unique", "taxon").agg(F.count(F.lit(1)).alias("n"))
    if names is not None:
        counted = counted.join(names.select(F.col("id").alias("taxon"), "name"), "taxon", "left")
    else:
        counted = counted.withColumn("name", F.lit(None).cast("string"))
    shown = F.coalesce("name", "taxon")
    entry = F.struct((-F.col("n")).alias("n"), "taxon", F.when(F.col("unique"), shown).otherwise(F.concat(shown, F.lit(":"), F.col("n").cast("string"))).alias("text"))
    listed = counted.groupBy(*QUERY).agg(F.sort_array(F.collect_list(entry)).alias("l"))
    return listed.select(*QUERY, F.array_join(F.transform("l", lambda x: x.getField("text")), "\t").alias("taxa"))
