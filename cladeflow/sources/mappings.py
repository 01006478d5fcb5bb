"""Maps, groups, sizes, strata and gene coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import read_lines


def _split(spark: SparkSession, path: str | list[str], sep: str = "\t") -> DataFrame:
    return read_lines(spark, path).withColumn("f", F.split(F.rtrim("line"), sep))


def _last(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row per key: of repeated keys the last in the file holds."""
    return df.groupBy(key).agg(F.max_by(value, F.struct("path", "block", "seq")).alias(value))


def read_unique_map(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """source, target of the lines with exactly two columns."""
    rows = _split(spark, path, sep).filter(F.size("f") == 2)
    return _last(rows.select("path", "block", "seq", F.get("f", 0).alias("source"), F.get("f", 1).alias("target")), "source", "target")


def read_first_map(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """source, target: the first two columns; further ones and lines with one are left out."""
    rows = _split(spark, path, sep).filter(F.size("f") >= 2)
    return _last(rows.select("path", "block", "seq", F.get("f", 0).alias("source"), F.get("f", 1).alias("target")), "source", "target")


def read_groups(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """grp, member: one line per group, members behind it; of repeated groups the last line holds."""
    rows = _split(spark, path, sep).filter(F.size("f") >= 2)
    rows = rows.select("path", "block", "seq", F.get("f", 0).alias("grp"), F.slice("f", F.lit(2), F.size("f")).alias("members"))
    return _last(rows, "grp", "members").select("grp", F.explode("members").alias("member"))


def read_many_map(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """source, target: many to many; repeated keys extend each other and repeats stay."""
    rows = _split(spark, path, sep).filter(F.size("f") >= 2)
    return rows.select(F.get("f", 0).alias("source"), F.explode(F.slice("f", F.lit(2), F.size("f"))).alias("target"))


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    """subject, size."""
    return read_first_map(spark, path).select(F.col("source").alias("subject"), F.col("target").cast("double").alias("size"))


def read_strata(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """sample, query, stratum from one map per sample; a sample without any raises."""
    out = None
    for sample, path in files.items():
        part = read_unique_map(spark, path).select(F.lit(sample).alias("sample"), F.col("source").alias("query"), F.col("target").alias("stratum"))
        if not part.take(1):
            raise ValueError(f"No stratification information is found in {path}.")
        out = part if out is None else out.unionByName(part)
    return out


def read_genes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """contig, gene, beg, end (0-based, half-open) from sections headed by > or #.

    Doubled marks head groups of contigs and are skipped; start and end may come in either order;
    of a contig that is headed twice the last section holds. Gene ids are led by their contig
    and _ if any id occurs twice in the files.
    """
    lines = read_lines(spark, path).filter(F.length("line") > 0)
    mark = F.substring("line", 1, 1)
    heads = mark.isin(">", "#")
    grouped = heads & (F.substring("line", 2, 1) == mark)
    # a file is forward-filled by one task: files hold one order, and there may be many
    over = Window.partitionBy("path").orderBy("block", "seq")
    named = lines.filter(~grouped).withColumn("head", F.when(heads, F.struct(F.trim(F.substring("line", F.lit(2), F.length("line"))).alias("contig"), "block", "seq")))
    filled = named.withColumn("head", F.last("head", ignorenulls=True).over(over)).filter(~heads).withColumn("f", F.split(F.rtrim("line"), "\t"))
    ok = F.when(F.size("f") == 3, F.get("f", 0)).otherwise(F.raise_error(F.concat(F.lit("Cannot extract coordinates from line: "), F.col("line"))).cast("string"))
    a, b = F.get("f", 1).cast("long"), F.get("f", 2).cast("long")
    rows = filled.select("path", "head", ok.alias("gene"), (F.least(a, b) - 1).alias("beg"), F.greatest(a, b).alias("end"))
    last = named.filter(heads).groupBy(F.col("head.contig").alias("contig")).agg(F.max(F.struct("path", "head")).alias("last"))
    rows = rows.withColumn("contig", F.col("head.contig")).join(last, "contig").filter((F.col("path") == F.col("last.path")) & (F.col("head") == F.col("last.head")))
    return prefix_repeated(rows.select("contig", "gene", "beg", "end"))


def prefix_repeated(genes: DataFrame) -> DataFrame:
    """Lead all gene ids by their contig if any id occurs twice."""
    twice = genes.groupBy("gene").count().agg(F.coalesce(F.max("count") > 1, F.lit(False)).alias("twice"))
    return genes.join(F.broadcast(twice)).withColumn("gene", F.when(F.col("twice"), F.concat_ws("_", "contig", "gene")).otherwise(F.col("gene"))).drop("twice")


def gene_lengths(genes: DataFrame) -> DataFrame:
    """subject, size."""
    return genes.select(F.col("gene").alias("subject"), (F.col("end") - F.col("beg")).cast("double").alias("size"))
