"""Feature tables: wide TSV files, or long Parquet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import read_lines

METADATA = ("Name", "Rank", "Lineage")


@dataclass
class Table:
    """A long profile with the order of its samples, feature metadata, and decimals of its text."""

    profile: DataFrame
    samples: list[str]
    metadata: DataFrame
    digits: int


def decimals(text: Column) -> Column:
    """Decimals of a number's plain form: 0 without a point; at least 1 with one, however large or small it is."""
    shown = text.cast("double").cast("string")  # from 1e7 on, and below 1e-3, as in 1.25E-4
    digits, power = (F.regexp_extract(shown, r"\.(\d+)(?:E(-?\d+))?$", i) for i in (1, 2))
    moved = F.greatest(F.length(F.rtrim(digits, F.lit("0"))) - F.when(power != "", power).cast("int"), F.lit(1))
    return F.when(F.contains(text, F.lit(".")), F.when(power == "", F.length(digits)).otherwise(moved)).otherwise(0)


def split_header(header: list[str]) -> tuple[list[str], list[str]]:
    """Samples and metadata columns, which stand last and in the order Name, Rank, Lineage."""
    left, found = list(header), []
    for name in reversed(METADATA):
        if left and left[-1] == name:
            found.insert(0, left.pop())
    return left, found


def read_table(spark: SparkSession, path: str) -> Table:
    """A TSV file with a header, or a Parquet folder of feature, sample, value."""
    if path.rstrip("/").endswith(".parquet"):
        profile = spark.read.parquet(path).select("feature", "sample", F.col("value").cast("double").alias("value"))
        samples = sorted(r[0] for r in profile.select("sample").distinct().collect())
        return Table(profile, samples, spark.createDataFrame([], "feature string"), 1)
    lines = read_lines(spark, path)
    head = lines.orderBy("block", "seq").first()
    if head is None:
        raise ValueError("The table file is empty or unreadable.")
    samples, meta = split_header(head["line"].rstrip("\r\n").split("\t")[1:])
    if not samples:
        raise ValueError("The table contains no sample.")
    rows = lines.filter(~((F.col("block") == head["block"]) & (F.col("seq") == head["seq"])) & (F.length("line") > 0))
    rows = rows.withColumn("f", F.split("line", "\t")).withColumn("feature", F.get("f", 0))
    names = F.array(*[F.lit(s) for s in samples])
    cells = rows.select("feature", F.posexplode(F.slice("f", 2, len(samples))).alias("i", "text"))
    profile = cells.select("feature", F.get(names, F.col("i")).alias("sample"), F.col("text").cast("double").alias("value"))
    deep = cells.agg(F.max(decimals(F.col("text")))).first()[0]
    metadata = rows.select("feature", *[F.coalesce(F.get("f", 1 + len(samples) + i), F.lit("")).alias(c) for i, c in enumerate(meta)])
    return Table(profile, samples, metadata, deep or 0)


def wide(profile: DataFrame, samples: list[str], metadata: DataFrame | None = None) -> DataFrame:
    """One row per feature with a value over 0 in any sample, one column per sample, metadata last; by feature."""
    sums = profile.groupBy("feature").pivot("sample", samples).agg(F.sum("value")).na.fill(0.0, samples)
    some = F.lit(False)
    for s in samples:
        some = some | (F.col(f"`{s}`") != 0)
    out = sums.filter(some)
    if metadata is not None:
        meta = [c for c in metadata.columns if c != "feature"]
        out = out.join(metadata, "feature", "left").na.fill("", meta)
    return out.orderBy("feature")


def describe(profile: DataFrame, names: DataFrame | None = None, ranks: DataFrame | None = None, lineages: DataFrame | None = None) -> DataFrame:
    """feature with Name, Rank and Lineage, as far as given, by the taxon of the feature; '' where there is none.

    A stratified feature is named by what stands behind the last |.
    """
    out = profile.select("feature").distinct().withColumn("_t", F.substring_index("feature", "|", -1))
    for table, column, label in ((names, "name", "Name"), (ranks, "rank", "Rank"), (lineages, "Lineage", "Lineage")):
        if table is not None:
            more = table.select(F.col("id").alias("_t"), F.col(column).alias(label))
            out = out.join(more, "_t", "left").withColumn(label, F.coalesce(label, F.lit("")))
    return out.drop("_t")


def name_as_id(profile: DataFrame, names: DataFrame) -> DataFrame:
    """Features by name where they have one; features that share a name stay apart as equal rows."""
    stratum = F.when(F.contains("feature", F.lit("|")), F.concat(F.substring_index("feature", "|", 1), F.lit("|"))).otherwise("")
    joined = profile.withColumn("_s", stratum).withColumn("_t", F.expr("substring(feature, length(_s) + 1)"))
    named = joined.join(names.select(F.col("id").alias("_t"), F.col("name").alias("_n")), "_t", "left")
    return named.withColumn("feature", F.concat("_s", F.coalesce("_n", "_t"))).drop("_s", "_t", "_n")


def number(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else str(x)
