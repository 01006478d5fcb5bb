"""What the operators share: reading, words, cutting lineage, distributed prefix sums."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space as the word pattern [^\x20\x09-\x0D]+ has it.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
#: Bytes of a batch that is sent to Python.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The text's words as an array; null and blank texts have none."""
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, BLANK_RUN))


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the folder that ``spark.checkpoint.dir`` names.

    Where the setting is absent (local tests) a temporary folder is used.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        where = sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="cladeflow-")
        sc.setCheckpointDir(where)
    return df.checkpoint()


def free(df: DataFrame) -> DataFrame:
    """The same rows, once the driver was asked to collect garbage.

    Shuffle files and old checkpoints stay on disk until no plan in the driver's memory refers to
    them, which a large idle heap may put off to the end. Called after a table is settled, so that
    what it was made from goes before more is written. The scheduler remembers its last job until
    the next one, and Python's references reach the JVM about once a second.
    """
    spark = df.sparkSession
    spark.range(2).count()
    gc.collect()
    time.sleep(1.1)
    spark.sparkContext._jvm.System.gc()
    return df


def prefix_sums(df: DataFrame, keys: list[str], order: str, value: str, out: str, width: int = 1024) -> DataFrame:
    """Exclusive running sums of ``value`` by ``order`` (long, unique within ``keys``).

    Two levels, so that no task sorts a whole key: within bands of ``width`` order values, and
    over the bands' totals.
    """
    banded = df.withColumn("_band", F.floor(F.col(order) / width))
    totals = banded.groupBy(*keys, "_band").agg(F.sum(value).alias("_total"))
    over = Window.partitionBy(*keys).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("_before", F.coalesce(F.sum("_total").over(over), F.lit(0))).drop("_total")
    within = Window.partitionBy(*keys, "_band").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = banded.withColumn("_inner", F.coalesce(F.sum(value).over(within), F.lit(0)))
    renamed = before.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_band").alias("_b"), "_before")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_band") == F.col("_b")]
    joined = inner.join(renamed, same).withColumn(out, F.col("_inner") + F.col("_before"))
    return joined.drop("_band", "_b", "_inner", "_before", *[f"_k{i}" for i in range(len(keys))])


def slices(sizes, most: int):
    """Runs (from, to) of rows with about ``most`` bytes together; a longer row stands alone."""
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def lean(df: DataFrame) -> DataFrame:
    """The same rows; the session sends them to Python in batches of BATCH_BYTES at most.

    Rows may be wide (whole texts, sets of n-grams), and by default a batch may have 64 MB, of
    which the JVM and each Python worker of an executor hold several at a time.
    """
    conf = df.sparkSession.conf
    if int(str(conf.get(BATCH_SETTING)).rstrip("b")) > BATCH_BYTES:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df
