"""Interval operators: reads to genes, covered ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import dealt

BIN = 1024


def match_genes(reads: DataFrame, genes: DataFrame, overlap: float = 0.8, keys: tuple[str, ...] = ("sample", "query"), width: int = BIN) -> DataFrame:
    """keys, subject: genes that a read overlaps by ``overlap`` times its aligned length (rounded up) or more.

    ``reads``: keys, subject (the contig), length, beg, end; ``genes``: contig, gene, beg, end.
    Both sides are cut into bins of ``width`` positions and joined on contig and bin; a pair is
    taken in the bin where its overlap begins, hence once. Reads without a length are left out.
    Only pairs that may come again (of keys with several reads on a contig, or of a gene at several
    places) are dealt out to drop repeats; all others leave the join as they are.
    """
    def binned(df: DataFrame, p: str = "") -> DataFrame:
        return df.withColumn(f"{p}bin", F.explode(F.sequence(F.floor(F.col(f"{p}beg") / width), F.floor((F.col(f"{p}end") - 1) / width))))

    def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
        left, right = binned(left), binned(right, "g_")
        # a merge reads a bin's genes in a row, a hashed table would follow a chain of them for each read
        begin = F.greatest("beg", "g_beg")
        enough = F.least("end", "g_end") - begin >= F.ceil(F.col("length") * F.lit(overlap))
        joined = left.join(right.hint("merge"), (F.col("contig") == F.col("g_contig")) & (F.col("bin") == F.col("g_bin")) & (F.floor(begin / width) == F.col("bin")) & enough)
        return joined.select(*keys, F.col("gene").alias("subject"))

    many = lambda *by: F.count(F.lit(1)).over(Window.partitionBy(*by)) > 1
    left = dealt(reads.filter("length > 0 and end > beg").select(*keys, F.col("subject").alias("contig"), "length", "beg", "end"), *keys)
    left = left.withColumn("many", many(*keys, "contig"))
    right = genes.filter("end > beg").select(F.col("contig").alias("g_contig"), "gene", F.col("beg").alias("g_beg"), F.col("end").alias("g_end")).withColumn("g_many", many("gene"))
    again = pairs(left.filter("many"), right).unionByName(pairs(left.filter("not many"), right.filter("g_many")))
    return pairs(left.filter("not many"), right.filter("not g_many")).unionByName(again.distinct())


def count_genes(reads: DataFrame, genes: DataFrame, overlap: float = 0.8) -> DataFrame:
    """sample, feature, value: the genes of ``match_genes``, each counting one by the number of its query's genes.

    Pairs are made twice, first for that number, and summed where they are made: they outgrow the reads and aren't dealt out.
    """
    keys = ("sample", "query")
    known = match_genes(reads, genes, overlap).groupBy(*keys).agg(F.count(F.lit(1)).alias("k"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    weighed = reads.join(known.select(*[F.col(c).alias(f"_{c}") for c in keys], "k"), same)
    found = match_genes(weighed, genes, overlap, (*keys, "k"))
    return found.filter("subject <> ''").groupBy("sample", F.col("subject").alias("feature")).agg(F.sum(1 / F.col("k")).alias("value"))


def cover_ranges(reads: DataFrame, keys: tuple[str, ...] = ("sample", "subject"), width: int = 1 << 20) -> DataFrame:
    """keys, beg, end: the union of the ranges; ranges that touch merge.

    Ranges are first merged within stretches of ``width`` positions, so that however many reads a
    subject has, its last merge sees few ranges.
    """
    def merged(df: DataFrame, by: list[str]) -> DataFrame:
        over = Window.partitionBy(*by).orderBy("beg", "end")
        reach = F.max("end").over(over.rowsBetween(Window.unboundedPreceding, -1))
        marked = df.withColumn("new", F.when(reach.isNull() | (reach < F.col("beg")), 1).otherwise(0))
        parted = marked.withColumn("part", F.sum("new").over(over.rowsBetween(Window.unboundedPreceding, 0)))
        return parted.groupBy(*by, "part").agg(F.min("beg").alias("beg"), F.max("end").alias("end")).drop("part")

    rows = reads.filter("beg is not null and end is not null").select(*keys, "beg", "end").withColumn("stretch", F.floor(F.col("beg") / width))
    rows = rows.groupBy(*keys, "stretch", "beg").agg(F.max("end").alias("end"))
    return merged(merged(rows, [*keys, "stretch"]).drop("stretch"), list(keys))


def with_offsets(ranges: DataFrame, kind: str | None = "bed") -> DataFrame:
    """Ranges as bed, gff, or by base and end: 0e, 1e, 0i, 1i (e: half-open, i: end included)."""
    low = (kind or "bed").lower()
    if low in ("bed", "gff"):
        a, b = (0, 0) if low == "bed" else (1, 0)
    elif low[-1] in "ie" and low[:-1].lstrip("-").isdigit():
        a = int(low[:-1])
        b = a - (low[-1] == "i")
    else:
        raise ValueError(f"Invalid coverage format: {kind}.")
    return ranges.withColumn("beg", F.col("beg") + a).withColumn("end", F.col("end") + b)
