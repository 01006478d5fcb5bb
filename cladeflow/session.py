"""Session helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table is sent to all executors.
BROADCAST_ROWS = 200_000
#: Bytes of input files for each task that rows are dealt to, and tasks at most.
TASK_BYTES, MOST_TASKS = 4 << 20, 20_000


def session(name: str = "cladeflow", **conf: str) -> SparkSession:
    """A session with adaptive execution; on a cluster the submitted settings prevail."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the folder that ``spark.checkpoint.dir`` names (a temporary one if unset)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="cladeflow-"))
    return df.checkpoint()


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The table, marked for a broadcast join if a count finds ``most`` rows or fewer; else it joins by an exchange."""
    if df.limit(most + 1).count() > most:
        return df
    sent = F.broadcast(df)
    sent.sent = True
    return sent


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that the rows come from, as the plan knows them; 0 where it doesn't."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    except AttributeError:  # a session that keeps its plans elsewhere
        return 0
    return sum(x for x in sizes if x < 1 << 50)  # more stands for unknown


def tasks_for(*tables: DataFrame) -> int:
    """Tasks for rows of the tables together, whose number grows with the input, so that what a task holds doesn't."""
    spark = tables[0].sparkSession
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return min(max(least, -(-sum(map(input_bytes, tables)) // TASK_BYTES)), MOST_TASKS)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` to as many tasks as ``tasks_for`` says; adaptive execution would join them into few large ones."""
    return df.repartition(*keys) if df.isStreaming else df.repartition(tasks_for(df), *keys)


def joined_large(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Inner join of two tables. Where they need more tasks than the session's, both are dealt to so many."""
    n = tasks_for(left, right)
    if n > int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        left, right = left.repartition(n, left_key), right.repartition(n, right_key)
    return left.join(right, F.col(left_key) == F.col(right_key))


def attached(rows: DataFrame, known: DataFrame, columns: list, on: list[str], *keys: str) -> DataFrame:
    """Left join of rows, dealt by ``keys``, with ``columns`` of a table from ``small_side``; they are dealt again where that one isn't small."""
    joined = rows.join(known.select(*columns), on, "left")
    return joined if getattr(known, "sent", False) else dealt(joined, *keys)
