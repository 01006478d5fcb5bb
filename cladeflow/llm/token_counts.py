"""Token counts: batch encoding in an Arrow function that returns lengths only."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices
from .pieces import load

#: Bytes of text that are encoded together; longer texts are cut at safe boundaries.
BATCH_BYTES = 1 << 20


def _piece_counts(path: str, texts: list[str]) -> list[int]:
    model = load(path)
    if not model.safe:
        return [len(x) for x in model.lib.encode(texts, num_threads=1)]
    out, short = [], []
    for text in texts:
        if len(text) <= BATCH_BYTES:
            short.append(model.segments(text) if text else [])
            continue
        n, parts = 0, model.segments(text)
        for i in range(0, len(parts), 100_000):
            some = parts[i:i + 100_000]
            known = model.learn(some)
            n += sum(len(known[s][0]) for s in some)
        short.append(n)
    known = model.learn({s for parts in short if isinstance(parts, list) for s in parts})
    for parts in short:
        out.append(parts if isinstance(parts, int) else sum([len(known[s][0]) for s in parts]))
    return out


@lru_cache(maxsize=2)
def _json_tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _json_counts(path: str, texts: list[str]) -> list[int]:
    return [len(x.ids) for x in _json_tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text: id_col, n_bytes, n_tokens.

    A path that ends in .json is read by the tokenizers library, any other by sentencepiece;
    either without added special tokens, truncation or padding. Texts are taken in batches of
    about BATCH_BYTES; with a model where white space is a safe boundary they are cut there and
    each distinct segment of a batch is encoded once. ``model_path`` must exist on every executor.

    Null texts count as empty: 0 bytes, 0 tokens. Null and repeated ids are kept as rows; no
    rows give no rows. Other columns are ignored.
    """
    counts = _json_counts if model_path.endswith(".json") else _piece_counts

    def lengths(batches):
        for batch in batches:
            text = batch.column("text")
            sizes = pc.binary_length(text).to_pylist()
            n = []
            for a, b in slices(sizes, BATCH_BYTES):
                n += counts(model_path, text.slice(a, b - a).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"]
            )

    rows = lean(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lengths, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
