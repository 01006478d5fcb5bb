"""Writers: profiles, read maps and covered ranges."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sources.tables import number, wide


def write_profile(profile: DataFrame, path: str, samples: list[str] | None = None, metadata: DataFrame | None = None, kind: str | None = None) -> None:
    """A profile as Parquet (long) if ``kind`` or the path's ending says so, else as one TSV file.

    The TSV has a row for each feature and a column for each sample, empty ones included.
    """
    if kind == "parquet" or kind is None and path.rstrip("/").endswith(".parquet"):
        profile.select("feature", "sample", "value").filter("value <> 0").write.mode("overwrite").parquet(path)
        return
    samples = samples or sorted(r[0] for r in profile.select("sample").distinct().collect())
    rows = wide(profile, samples, metadata)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\t".join(["#FeatureID", *rows.columns[1:]]) + "\n")
        for r in rows.toLocalIterator():
            f.write("\t".join(number(x) if isinstance(x, float) else str(x) for x in r) + "\n")


def write_ranked(profiles: DataFrame, folder: str, ranks: list[str], samples: list[str] | None = None, metadata: DataFrame | None = None, kind: str = "tsv") -> None:
    """One file per rank in ``folder``, or the file ``folder`` itself for a single rank."""
    if len(ranks) == 1 and not os.path.isdir(folder):
        return write_profile(profiles.filter(F.col("rank") == ranks[0]), folder, samples, metadata, None if kind == "tsv" else kind)
    os.makedirs(folder, exist_ok=True)
    for rank in ranks:
        write_profile(profiles.filter(F.col("rank") == rank), os.path.join(folder, f"{rank}.{kind}"), samples, metadata, kind)


def write_read_map(table: DataFrame, folder: str, codec: str = "gzip") -> None:
    """Read maps (sample, query, taxa) as text, a subfolder per sample; codec: none, gzip, bzip2 or deflate. Overwrites."""
    lines = table.select("sample", F.concat_ws("\t", "query", "taxa").alias("value"))
    lines.write.mode("overwrite").option("compression", codec).partitionBy("sample").text(folder)


def write_ranges(ranges: DataFrame, folder: str) -> None:
    """Ranges (sample, subject, beg, end) as tab-separated text, a subfolder per sample, in order. Overwrites."""
    rows = ranges.repartition("sample").sortWithinPartitions("sample", "subject", "beg", "end")
    lines = rows.select("sample", F.concat_ws("\t", "subject", F.col("beg").cast("string"), F.col("end").cast("string")).alias("value"))
    lines.write.mode("overwrite").partitionBy("sample").text(folder)
