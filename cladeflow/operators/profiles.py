"""Operators from profile to profile. A profile is long: feature, sample, value (and keys such as rank or stratum)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import round_to, scale_factor

CELL = ("feature", "sample")


def scale(profile: DataFrame, factor: str | float) -> DataFrame:
    return profile.withColumn("value", F.col("value") * F.lit(scale_factor(factor)))


def fraction(profile: DataFrame, by: tuple[str, ...] = ("sample",)) -> DataFrame:
    """Values by their sample's total; samples that sum to 0 stay."""
    total = F.sum("value").over(Window.partitionBy(*by))
    return profile.withColumn("_t", total).withColumn("value", F.when(F.col("_t") != 0, F.col("value") / F.col("_t")).otherwise(F.col("value"))).drop("_t")


def divide(profile: DataFrame, sizes: DataFrame) -> DataFrame:
    """Values by their feature's size (subject, size); a feature without one raises."""
    joined = profile.join(sizes.select(F.col("subject").alias("feature"), F.col("size").alias("_size")), "feature", "left")
    lacking = F.raise_error(F.concat(F.lit("Feature without a size: "), F.col("feature"))).cast("double")
    return joined.withColumn("value", F.col("value") / F.when(F.col("_size").isNull(), lacking).otherwise(F.col("_size"))).drop("_size")


def rounded(profile: DataFrame, digits: int | None = None) -> DataFrame:
    """Rounded values; cells that become 0 go."""
    return profile.withColumn("value", round_to(F.col("value"), digits)).filter("value <> 0")


def normalize(profile: DataFrame, sizes: DataFrame | None = None, factor: str | float | None = None, digits: int | None = None) -> DataFrame:
    """Fractions, or values by size, then scaled, then rounded."""
    out = fraction(profile) if sizes is None else divide(profile, sizes)
    return rounded(scale(out, factor) if factor else out, digits)


def filter_profile(profile: DataFrame, min_count: float | None = None, min_percent: float | None = None) -> DataFrame:
    """Cells of at least ``min_count``, or ``min_percent`` of their sample's total."""
    if bool(min_count) == bool(min_percent):
        raise ValueError("Specify either a minimum count or a minimum percentage.")
    if min_percent and min_percent >= 100:
        raise ValueError("The minimum percentage must be below 100.")
    threshold = min_count or min_percent / 100
    if threshold >= 1:
        return profile.filter((F.col("value") >= threshold) & (F.col("value") != 0))
    total = F.sum("value").over(Window.partitionBy("sample"))
    return profile.withColumn("_b", total * F.lit(threshold)).filter("value >= _b and value <> 0").drop("_b")


def merge(*profiles: DataFrame, keys: tuple[str, ...] = CELL) -> DataFrame:
    """Sums of equal cells; cells that are 0 go."""
    rows = profiles[0].select(*keys, "value")
    for more in profiles[1:]:
        rows = rows.unionByName(more.select(*keys, "value"))
    return rows.groupBy(*keys).agg(F.sum("value").alias("value")).filter("value <> 0")


def merge_metadata(*tables: DataFrame) -> DataFrame:
    """Union of feature metadata; a feature with different values raises."""
    columns = [c for c in tables[0].columns if c != "feature"]
    rows = tables[0]
    for more in tables[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    grouped = rows.groupBy("feature").agg(*[F.min(c).alias(c) for c in columns], *[F.max(c).alias(f"_{c}") for c in columns])
    bad = F.raise_error(F.concat(F.lit("Conflicting metadata of "), F.col("feature"))).cast("string")
    return grouped.select("feature", *[F.when(F.col(c) != F.col(f"_{c}"), bad).otherwise(F.col(c)).alias(c) for c in columns])


def _fields(sep: str):
    return F.split("feature", re.escape(sep))


def clip(profile: DataFrame, field: int, sep: str | None = None, nested: bool = False) -> DataFrame:
    """Features cut to a field (from 1), or up to it if ``nested``; those that lack it, or where it is empty, go."""
    if not field:
        raise ValueError("A field or a mapping is needed.")
    sep = sep or ("_" if nested else "|")
    at = F.get(_fields(sep), field - 1)
    name = F.array_join(F.slice(_fields(sep), 1, field), sep) if nested else at
    return merge(profile.filter(at.isNotNull() & (at != "")).withColumn("feature", name))


def collapse(profile: DataFrame, mapping: DataFrame, divided: bool = False, field: int | None = None, sep: str | None = None, nested: bool = False) -> DataFrame:
    """Values go to the target(s) of their feature: ``mapping`` (source, target), many to many.

    Repeats in the mapping count. ``divided`` shares a value among the targets instead of giving
    each the whole. With ``field`` that field of the feature is mapped: of a plain feature it is
    replaced; of a ``nested`` one, whose fields stand for all before them as well, the result is
    the field before, the target, and the whole feature if fields follow. What isn't mapped goes.
    """
    sep = sep or ("_" if nested else "|")
    rows = profile
    if field:
        parts = _fields(sep)
        if nested:
            stacked = lambda i: F.when(F.size(parts) > i, F.array_join(F.slice(parts, 1, i + 1), sep))
            rows = rows.withColumn("_source", stacked(field - 1)).withColumn("_before", stacked(field - 2) if field > 1 else F.lit(None).cast("string"))
        else:
            rows = rows.withColumn("_source", F.get(parts, field - 1))
    else:
        rows = rows.withColumn("_source", F.col("feature"))
    rows = rows.filter("_source <> ''")
    table = mapping.select(F.col("source").alias("_source"), F.col("target").alias("_target"))
    if divided:
        table = table.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy("_source")))
    joined = rows.join(table, "_source")
    if divided:
        joined = joined.withColumn("value", F.col("value") * (1 / F.col("_k")))
    if not field:
        name = F.col("_target")
    elif nested:
        behind = F.when(F.size(_fields(sep)) > field, F.col("feature"))
        name = F.concat_ws("|", "_before", "_target", behind)
    else:
        parts = _fields(sep)
        name = F.array_join(F.transform(parts, lambda x, i: F.when(i == field - 1, F.col("_target")).otherwise(x)), "|")
    return merge(joined.withColumn("feature", name))


def group_coverage(profile: DataFrame, groups: DataFrame, samples: DataFrame | None = None, threshold: float | None = None, count: bool = False) -> DataFrame:
    """feature (the group), sample, value: the share of a group's members that are present (value over 0), in percent.

    With ``threshold`` 1 where the percentage reaches it, else 0; with ``count`` the number of
    members. Groups that are 0 in all samples go; others have a row for every sample.
    """
    members = groups.select("grp", "member").distinct()
    totals = members.groupBy("grp").agg(F.count(F.lit(1)).alias("total"))
    present = profile.filter("value > 0").select(F.col("feature").alias("member"), "sample").distinct()
    met = present.join(members, "member").groupBy("grp", "sample").agg(F.count(F.lit(1)).alias("covered"))
    samples = (profile.select("sample") if samples is None else samples.select("sample")).distinct()
    share = 100 * F.col("covered") / F.col("total")
    if count:
        value = F.col("covered").cast("double")
    elif threshold:
        value = F.when(share >= threshold, 1.0).otherwise(0.0)
    else:
        value = round_exact(share)
    cells = met.join(totals, "grp").select("grp", "sample", value.alias("value")).filter("value <> 0")
    # every sample of the groups that have any: groups times samples, the size of the table itself
    grid = cells.select("grp").distinct().join(F.broadcast(samples))
    return grid.join(cells, ["grp", "sample"], "left").select(F.col("grp").alias("feature"), "sample", F.coalesce("value", F.lit(0.0)).alias("value"))


def round_exact(value):
    """Three decimals by the binary value, without tolerance."""
    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: round(x, 3), na_action="ignore").astype("float64")

    return run(value)


def shape(profile: DataFrame) -> tuple[int, int]:
    """Numbers of features and samples."""
    row = profile.agg(F.count_distinct("feature"), F.count_distinct("sample")).first()
    return row[0], row[1]
