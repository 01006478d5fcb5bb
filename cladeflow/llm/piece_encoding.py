"""Piece encoding and decoding that keeps, for every piece, its span of bytes in the source."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices
from .pieces import MARK, PieceModel, load

BATCH_BYTES = 1 << 20


class CharMap:
    """A compiled character map: a double array trie of byte strings, and their replacements.

    The blob holds the trie's size in bytes, the trie's 32-bit units, and replacements that end
    in a zero byte; a leaf's value is the place of its replacement.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4:4 + size], "<u4").tolist()
        self.texts = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that starts at ``at``, and its replacement."""
        if not self.units:
            return None
        found, units = None, self.units
        jump = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node = jump(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node ^= jump(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.texts[found[1]:self.texts.index(b"\0", found[1])]


def normalise(model: PieceModel, data: bytes) -> tuple[bytes, np.ndarray]:
    """The normalised text, and for each of its bytes (and its end) the source byte it is from.

    Source text is replaced by longest prefix through the character map; a character without an
    entry stays. Then white space is trimmed, collapsed, led by one blank and written as the
    mark, as the model says.
    """
    if not data:
        return b"", np.zeros(1, np.int64)
    mark = MARK.encode()
    if model.plain and model.normalizer.add_dummy_prefix:
        source = np.frombuffer(data, np.uint8)
        align = np.concatenate([np.zeros(3, np.int64), np.repeat(np.arange(len(source)), np.where(source == 32, 3, 1)), [len(source)]])
        return mark + data.replace(b" ", mark), align
    spec, table = model.normalizer, _char_map(model)
    chunks: list[tuple[bytes, int]] = []
    at = 0
    while at < len(data):
        hit = table.longest(data, at)
        if hit is None:
            lead = data[at]
            n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            hit = (n, data[at:at + n])
        chunks.append((hit[1], at))
        at += hit[0]
    end = len(data)
    if spec.remove_extra_whitespaces:
        while chunks and chunks[0][0].strip(b" ") == b"":
            chunks.pop(0)
    out, align, blank = [], [], spec.remove_extra_whitespaces
    space = mark if spec.escape_whitespaces else b" "
    if chunks and spec.add_dummy_prefix:
        out.append(space)
        align += [chunks[0][1]] * len(space)
    for text, at in chunks:
        if spec.remove_extra_whitespaces and blank:
            text = text.lstrip(b" ")
        if text:
            blank = text.endswith(b" ")
            text = text.replace(b" ", space)
            out.append(text)
            align += [at] * len(text)
    joined = b"".join(out)
    if spec.remove_extra_whitespaces:
        while joined.endswith(space):
            joined = joined[:-len(space)]
            end = align[len(joined)]
    return joined, np.array([*align[:len(joined)], end], np.int64)


@lru_cache(maxsize=2)
def _char_map(model: PieceModel) -> CharMap:
    return CharMap(model.normalizer.precompiled_charsmap)


@lru_cache(maxsize=2)
def _lengths(model: PieceModel) -> np.ndarray:
    return np.array(model.lengths, np.int64)


def spans(model: PieceModel, data: bytes, ids) -> np.ndarray:
    """Byte offsets in the source where the pieces begin, and at last where the final one ends.

    A piece that stands for part of a replaced character begins where that character does.
    """
    normal, align = normalise(model, data)
    ids = np.fromiter(ids, np.int64, len(ids))
    ends = np.cumsum(_lengths(model)[ids])
    if len(ids) and ends[-1] != len(normal):  # an unknown piece covers text of any length
        pieces = model.lib.encode(data.decode(), return_type="proto").pieces
        ends = np.cumsum([len(p.piece.encode()) for p in pieces])
    return align[np.concatenate([[0], ends])] if len(ids) else np.zeros(0, np.int64)


def encode(model: PieceModel, texts: list[str]) -> list[tuple[list[int], str]]:
    """Ids of each text, as a list and as decimal numbers joined by commas."""
    if not model.safe:
        return [(ids, ",".join(map(str, ids))) for ids in model.lib.encode(texts, num_threads=1)]
    cut = [model.segments(t) if t else [] for t in texts]
    known = model.learn({s for parts in cut for s in parts})
    out = []
    for parts in cut:
        found = [known[s] for s in parts]
        out.append(([i for ids, _ in found for i in ids], ",".join([x for _, x in found])))
    return out


def _mapped(docs: DataFrame, model_path: str, id_col: str, text_col: str, row, fields: dict[str, pa.DataType], schema: str) -> DataFrame:
    def run(batches):
        model = load(model_path)
        for batch in batches:
            text = batch.column("text")
            sizes = pc.binary_length(text).to_pylist()
            for a, b in slices(sizes, BATCH_BYTES):
                some = text.slice(a, b - a).to_pylist()
                rows = [row(model, t, ids, joined) for t, (ids, joined) in zip(some, encode(model, some), strict=True)]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), fields.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), *columns], ["id", *fields])

    rows = lean(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, {schema}").withColumnRenamed("id", id_col)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text's ids, source spans and decoded form: id_col, ids, begin, end, decoded.

    ``begin`` and ``end`` are byte offsets (UTF-8) of each piece in the source. No begin or end
    ids are added and nothing is sampled. Null texts count as empty: no ids, an empty decoded
    text. Null and repeated ids are kept as rows; no rows give no rows.
    """
    def row(model, text, ids, _):
        at = spans(model, text.encode(), ids)
        return ids, at[:-1], at[1:], model.lib.decode(ids)

    fields = {"ids": pa.list_(pa.int32()), "begin": pa.list_(pa.int64()), "end": pa.list_(pa.int64()), "decoded": pa.string()}
    return _mapped(docs, model_path, id_col, text_col, row, fields, "ids array<int>, begin array<long>, end array<long>, decoded string")


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of what ``encode_documents`` gives, without sending it: id_col, n_tokens,
    ids_sha256, decoded_sha256, spans_sha256 (of the offsets as little-endian longs: where each
    piece begins, and at last where the text ends)."""
    def row(model, text, ids, joined):
        at = spans(model, text.encode(), ids)
        hexes = [hashlib.sha256(x).hexdigest() for x in (joined.encode(), model.lib.decode(ids).encode(), at.astype("<i8").tobytes())]
        return len(ids), *hexes

    fields = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "spans_sha256": pa.string()}
    return _mapped(docs, model_path, id_col, text_col, row, fields, "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
