"""Toxicity: a character n-gram classifier over naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

ORDERS = (3, 4, 5)
BUCKET_BITS = 20
#: Bounds of the fit: labelled rows that it sees (on average, drawn by a hash of the id), and features it keeps.
MAX_TRAIN_ROWS = 20_000
MAX_FEATURES = 2_048
#: Standard errors by which a feature must be more frequent in toxic texts.
SURE = 3.5
#: Characters that are hashed at a time.
CHUNK = 1 << 18
_MIX = np.uint32(2654435761)


def grams(text: str):
    """Buckets of the character n-grams of the lower-cased text, in parts of bounded size."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(codes), CHUNK):
        c = codes[at:at + CHUNK + max(ORDERS) - 1] * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
        c ^= c >> np.uint32(15)
        h = c.copy()
        for k in range(1, max(ORDERS)):
            if len(c) <= k:
                break
            h = h[:-1] * np.uint32(0x01000193) + c[k:]
            if k + 1 in ORDERS:
                yield ((h + np.uint32(k)) * _MIX >> np.uint32(32 - BUCKET_BITS))[:CHUNK]


def present(text: str) -> np.ndarray:
    parts = list(grams(text))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint32)


@dataclass
class Model:
    """score = 1 / (1 + exp(-(bias + sum of the weights of the buckets present)))."""

    bias: float
    weights: np.ndarray  # float32, one per bucket

    def score(self, text: str) -> float:
        w, found = self.weights, []
        for part in grams(text):
            values = w[part]
            found.append(part[values != 0])
        hits = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        z = self.bias + float(w[hits].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def descend(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, l2: float = 1e-4, rounds: int = 200, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Logistic regression (Adam) on features that are present (1) times their log-count ratio.

    Works through the rows in parts of bounded size: only feature numbers are held for all.
    """
    n = len(rows)
    parts, at, size = [], 0, 0
    for i, r in enumerate(rows):
        size += len(r)
        if size > 500_000 or i == n - 1:
            lengths = np.array([len(x) for x in rows[at:i + 1]])
            parts.append((at, i + 1, lengths, np.concatenate(rows[at:i + 1])))
            at, size = i + 1, 0
    w, b = np.zeros(len(ratios)), float(np.log((labels.sum() + 1) / (n - labels.sum() + 1)))
    m, s = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        g, scaled = np.zeros(len(w) + 1), w * ratios
        for lo, hi, lengths, what in parts:
            z = np.full(hi - lo, b)
            some = lengths > 0
            if some.any():
                z[some] += np.add.reduceat(scaled[what], np.cumsum([0, *lengths])[:-1][some])
            err = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels[lo:hi]
            g[:-1] += np.bincount(what, weights=np.repeat(err, lengths), minlength=len(w))
            g[-1] += err.sum()
        g /= max(1, n)
        g[:-1] = g[:-1] * ratios + l2 * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Fit on labelled documents, ``max_rows`` of them at most on average.

    First pass: in how many toxic and clean texts each bucket occurs; one array of fixed size
    reaches the driver. It takes the log-count ratios and keeps the buckets that most surely
    lean to toxic texts: what leans the other way says little of a long text, and would add up.
    Second pass: which of those each text has; logistic regression on the ratios.
    """
    spark = docs.sparkSession
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y is not null")
    marks = marks.groupBy("id").agg(F.max("y").alias("y"))
    n = marks.count()
    if n > max_rows:
        marks = marks.filter(F.expr(f"pmod(xxhash64(id, 5), 1000000) < {int(1e6 * max_rows / n)}"))
    marks = marks.select(F.col("id").alias("label_id"), "y")
    rows = lean(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")) \
        .join(F.broadcast(marks), F.col("id") == F.col("label_id")).select("id", "y", "text")  # 2 * max_rows ids: under 1 MB
    size = 1 << BUCKET_BITS

    def count(batches):
        seen, n = np.zeros((2, size), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text"), strict=True):
                seen[int(y > 0), present(text.as_py())] += 1
                n[int(y > 0)] += 1
        yield pa.RecordBatch.from_arrays([pa.array([int(n[0])]), pa.array([int(n[1])]), pa.array([seen.tobytes()])], ["clean", "toxic", "seen"])

    def add(batches):
        seen, n = np.zeros((2, size), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            for i, row in enumerate(batch.column("seen")):
                seen += np.frombuffer(row.as_buffer(), np.int32).reshape(2, size)
                n += [batch.column("clean")[i].as_py(), batch.column("toxic")[i].as_py()]
        yield pa.RecordBatch.from_arrays([pa.array([int(n[0])]), pa.array([int(n[1])]), pa.array([seen.tobytes()])], ["clean", "toxic", "seen"])

    sample = rows.repartition(8)  # bounded rows; each task sends one array of counts, and one task adds them up
    shape = "clean long, toxic long, seen binary"
    whole = sample.mapInArrow(count, shape).repartition(1).mapInArrow(add, shape).toArrow()
    totals = [whole.column(c)[0].as_py() for c in ("clean", "toxic")]
    seen = np.frombuffer(whole.column("seen")[0].as_buffer(), np.int32).reshape(2, size)
    mass = seen.sum(axis=1, dtype=np.float64) + size
    often = np.flatnonzero(seen.sum(axis=0) >= 3)
    clean, toxic = seen[:, often].astype(np.float64)
    ratio = np.log((toxic + 1) / mass[1]) - np.log((clean + 1) / mass[0])
    p, q = (toxic + 0.5) / (totals[1] + 1), (clean + 0.5) / (totals[0] + 1)
    sure = (p - q) / np.sqrt(p * (1 - p) / (totals[1] + 1) + q * (1 - q) / (totals[0] + 1) + 1e-12)
    order = np.lexsort((often, -sure))[:MAX_FEATURES]
    chosen = np.sort(order[sure[order] > SURE])
    kept, ratio = often[chosen], ratio[chosen]
    if not len(kept) or not min(totals):
        return Model(float(np.log((totals[1] + 1) / (totals[0] + 1))), np.zeros(size, np.float32))

    def select(batches):
        for batch in batches:
            found = []
            for text in batch.column("text"):
                at = present(text.as_py())
                place = np.minimum(np.searchsorted(kept, at), len(kept) - 1)
                found.append(place[kept[place] == at].astype(np.int16).tobytes())  # MAX_FEATURES fits
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(found, pa.binary())], ["y", "found"])

    table = sample.select("y", "text").mapInArrow(select, "y int, found binary").toArrow()
    got = sorted((int(y > 0), found) for y, found in zip(*(table.column(c).to_pylist() for c in ("y", "found")), strict=True))  # the same order, hence the same weights, in every run
    w, bias = descend([np.frombuffer(f, np.int16) for _, f in got], np.array([y for y, _ in got], float), ratio)
    weights = np.zeros(size, np.float32)
    weights[kept] = w * ratio
    return Model(bias, weights)


def _sent(model: Model):
    """A function that rebuilds the model where it is called; MAX_FEATURES numbers go with it."""
    at = np.flatnonzero(model.weights)
    values, bias = model.weights[at], model.bias

    def rebuilt() -> Model:
        full = np.zeros(1 << BUCKET_BITS, np.float32)
        full[at] = values
        return Model(bias, full)

    return rebuilt


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, all columns kept, whose score is below 0.5; null texts count as empty."""
    sent, place = _sent(model), docs.columns.index(text_col)

    def run(batches):
        own = sent()
        for batch in batches:
            yield batch.filter(pa.array([own.score(t.as_py() or "") < 0.5 for t in batch.column(place)], pa.bool_()))

    return lean(docs).mapInArrow(run, docs.schema)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The toxicity of every whole text: id_col, score (0 to 1), predicted (1 from 0.5 on).

    Null texts count as empty; an empty text scores by the bias alone. Null and repeated ids are
    kept as rows, no rows give no rows, other columns are ignored. The text alone is scored.
    """
    sent = _sent(model)

    def run(batches):
        own = sent()
        for batch in batches:
            scores = [own.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64())], ["id", "score"])

    rows = lean(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double").select(
        F.col("id").alias(id_col), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
