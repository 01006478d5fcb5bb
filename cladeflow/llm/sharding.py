"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, prefix_sums, settle, words

#: A group with over one part in HEAVY of all bytes, tokens or rows is placed by the driver: 3 * HEAVY groups at most.
HEAVY = 20_000
#: A group that fills over one part in PIECE of a shard is split.
PIECE = 8
#: Weights of bytes, tokens and rows in the dot product: shards are to be equal in bytes above all.
EMPHASIS = np.array([4.0, 1.0, 1.0])
#: Mean rows of a cell, the unit that one task packs.
CELL_ROWS = 2_000


def place(vectors: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Shard of each group: largest first, to the highest dot product with residual capacity.

    Ties go to the first shard, and among equal groups to the earlier one. ``residual``
    (shards x dimensions) is lowered in place.
    """
    out = np.empty(len(vectors), np.int32)
    for i in np.argsort(-(vectors @ EMPHASIS), kind="stable"):
        out[i] = s = int(np.argmax(residual @ (EMPHASIS * vectors[i])))
        residual[s] -= vectors[i]
    return out


def shard_documents(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into one of ``n_shards`` shards, equal texts together.

    Returns id_col, size (UTF-8 bytes + 8), n_tokens, text_crc32, shard, slot (gapless from 0
    in each shard). A group (rows of equal text) is placed where the dot product of its share
    of bytes, tokens and rows with the shards' residual capacity is highest. Groups above
    1 / (PIECE * n_shards) of the whole are split by a hash of the id, since no shard could hold
    them evenly. Heavy groups, a bounded number, are placed first by the driver; the rest fall
    into cells by the hash of the text, and each cell packs its groups into its share of the
    capacity that is left.

    Null texts count as empty ones (size 8, crc 0) and form one group with them. Null and
    repeated ids are kept as rows. No rows give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    light = settle(docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.size(words(text)).cast("long").alias("tokens"),
        F.crc32(text).alias("crc"),
        F.md5(text).alias("key"),
    ))
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    total = light.agg(*sums).first()
    n_rows = total["rows"]
    whole = np.array([max(1, total["size"] or 0), max(1, total["tokens"] or 0), max(1, n_rows)], float)

    most = np.maximum(whole / HEAVY, 1)
    heavy = light.groupBy("key").agg(*sums).filter(
        (F.col("size") > float(most[0])) | (F.col("tokens") > float(most[1])) | (F.col("rows") > float(most[2]))
    ).orderBy("key").collect()
    residual = np.full((n_shards, 3), 1 / n_shards)
    parts, owner = [], []
    for i, g in enumerate(heavy):
        v = np.array([g["size"], g["tokens"], g["rows"]], float) / whole
        k = min(max(1, int(np.ceil(v.max() * n_shards * PIECE))), g["rows"])
        parts += [v / k] * k
        owner += [i] * k
    placed: list[list[int]] = [[] for _ in heavy]
    for i, s in zip(owner, place(np.array(parts), residual) if parts else [], strict=True):
        placed[i].append(int(s))
    table = spark.createDataFrame([(g["key"], p) for g, p in zip(heavy, placed, strict=True)], "key string, pieces array<int>")
    # at most 3 * HEAVY groups and 3 * PIECE * n_shards further pieces: a few MB whatever the input
    marked = light.join(F.broadcast(table), "key", "left").withColumn(
        "shard", F.expr("pieces[pmod(xxhash64(id, 17), size(pieces))]")
    )
    taken = np.zeros((n_shards, 3))
    for r in marked.filter("shard is not null").groupBy("shard").agg(*sums).collect():
        taken[r["shard"]] = [r["size"], r["tokens"], r["rows"]]
    left = np.maximum(1 / n_shards - taken / whole, 1e-12)
    left /= left.sum(axis=0)

    n_cells = max(1, -(-n_rows // CELL_ROWS))
    spread = marked.select(
        "id", "size", "tokens", "crc", "key", "shard",
        F.expr(f"pmod(if(shard is null, xxhash64(key), xxhash64(id, 23)), {n_cells})").alias("cell"),
    )

    def pack(table: pa.Table) -> pa.Table:
        # ids stay Arrow columns: pandas would turn longs beside a null into doubles
        table = table.take(pc.sort_indices(table, sort_keys=[("id", "ascending"), ("key", "ascending")]))
        rows = table.drop_columns(["id"]).to_pandas()
        free = rows["shard"].isna()
        if free.any():
            groups = rows[free].groupby("key", sort=True).agg(size=("size", "sum"), tokens=("tokens", "sum"), rows=("size", "size"))
            v = groups.to_numpy(float) / whole
            where = place(v, left * v.sum(axis=0))
            rows.loc[free, "shard"] = rows.loc[free, "key"].map(dict(zip(groups.index, where, strict=True)))
        rows["shard"] = rows["shard"].astype("int32")
        made = {"shard": rows["shard"], "nth": rows.groupby("shard").cumcount().astype("int64")}
        return pa.table({c: pa.array(made[c].to_numpy()) if c in made else table.column(c) for c in ("id", "size", "tokens", "crc", "shard", "cell", "nth")})

    kind = light.schema["id"].dataType.simpleString()
    packed = settle(lean(spread).groupBy("cell").applyInArrow(
        pack, f"id {kind}, size long, tokens long, crc long, shard int, cell long, nth long"
    ))
    held = packed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    starts = prefix_sums(held, ["shard"], "cell", "n", "start").drop("n")
    return packed.join(starts, ["shard", "cell"]).select(
        F.col("id").alias(id_col), "size", F.col("tokens").alias("n_tokens"), F.col("crc").alias("text_crc32"),
        "shard", (F.col("start") + F.col("nth")).alias("slot"),
    )
