"""Language model scoring: a log-bilinear model trained in numpy by noise-contrastive estimation."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, settle, slices

#: Words that the neural model tells apart (the end of a text is one more, all other words together another).
CLASSES = 511
DIMENSIONS = 16
#: Noise words drawn for a step, and for how many each example counts them.
NOISE, NOISE_WEIGHT = 64, 16
#: Words whose counts every worker holds: this many at most, each of LONG bytes at most. The others' come by a join.
HELD_WORDS, LONG = 300_000, 64
BATCH_BYTES = 1 << 20
STEP_ROWS = 512
PARTS = 16  # rows in which summed parameters reach the driver


def tokens(text: str) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z in lower case: what bytes.lower and bytes.split do."""
    return text.encode().lower().split()


def _texts(batch):
    text = batch.column("text")
    for a, b in slices(pc.binary_length(text).to_pylist(), BATCH_BYTES):
        yield a, b, text.slice(a, b - a).to_pylist()


def count_words(rows: DataFrame) -> DataFrame:
    """Every token's count over all rows of ``text``: word, c. The empty word is the end of a text."""
    def run(batches):
        seen: Counter = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()).cast(pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for _, _, texts in _texts(batch):
                for t in texts:
                    seen.update(tokens(t))
                seen[b""] += len(texts)
                if len(seen) > 300_000:
                    yield rows()
        yield rows()

    return rows.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Parameters:
    """score(w | u, v) = (r[v] * c1 + r[u] * c2) . q[w] + b[w], v the word before, u the one before that."""

    r: np.ndarray
    q: np.ndarray
    b: np.ndarray
    c1: np.ndarray
    c2: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.r, self.q, self.b, self.c1, self.c2)]).astype(np.float32)

    @staticmethod
    def of(flat: np.ndarray, n: int) -> Parameters:
        at = np.cumsum([n * DIMENSIONS, n * DIMENSIONS, n, DIMENSIONS])
        r, q, b, c1, c2 = np.split(np.array(flat, np.float32), at)
        return Parameters(r.reshape(n, -1), q.reshape(n, -1), b, c1, c2)

    @staticmethod
    def start(shares: np.ndarray, seed: int = 1) -> Parameters:
        rng, n = np.random.default_rng(seed), len(shares)
        draw = lambda: rng.normal(0, 0.1, (n, DIMENSIONS)).astype(np.float32)
        return Parameters(draw(), draw(), np.log(shares).astype(np.float32), np.ones(DIMENSIONS, np.float32), np.full(DIMENSIONS, 0.5, np.float32))

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by the word before and by the one before that, and the log-normaliser of each pair of them."""
        near = (self.r * self.c1) @ self.q.T + self.b
        far = (self.r * self.c2) @ self.q.T
        norm = np.empty((len(self.b), len(self.b)), np.float32)
        for u in range(len(self.b)):
            both = near + far[u]
            high = both.max(axis=1)
            norm[u] = high + np.log(np.exp(both - high[:, None]).sum(axis=1))
        return near, far, norm


def improve(p: Parameters, codes: np.ndarray, weights: np.ndarray, shares: np.ndarray, rng, state: list, rate: float = 0.5) -> None:
    """Noise-contrastive steps (AdaGrad) over trigrams, each weighted by its count; changes ``p``."""
    n = len(shares)
    fields = ("r", "q", "b", "c1", "c2")
    if not state:
        state += [np.full(getattr(p, f).shape, 1e-3, np.float32) for f in fields]
    log_noise = np.log(NOISE_WEIGHT * shares).astype(np.float32)
    order = rng.permutation(len(codes))

    def scatter(where, what):
        return np.stack([np.bincount(where, weights=what[:, d], minlength=n) for d in range(what.shape[1])], axis=1).astype(np.float32)

    for at in range(0, len(order), STEP_ROWS):
        some = order[at:at + STEP_ROWS]
        code, weight = codes[some], weights[some].astype(np.float32)
        weight /= weight.sum()
        w, v, u = code % n, code // n % n, code // (n * n)
        noise = rng.choice(n, NOISE, p=shares)
        rv, ru = p.r[v], p.r[u]
        made = rv * p.c1 + ru * p.c2
        true = np.einsum("ij,ij->i", made, p.q[w]) + p.b[w] - log_noise[w]
        false = made @ p.q[noise].T + p.b[noise] - log_noise[noise]
        g = weight / (1 + np.exp(np.clip(true, -30, 30)))
        h = -(weight * np.float32(NOISE_WEIGHT / NOISE))[:, None] / (1 + np.exp(-np.clip(false, -30, 30)))
        d_made = g[:, None] * p.q[w] + h @ p.q[noise]
        d_q = scatter(w, g[:, None] * made)
        np.add.at(d_q, noise, h.T @ made)
        d_b = np.bincount(w, weights=g, minlength=n).astype(np.float32)
        np.add.at(d_b, noise, h.sum(axis=0))
        d_r = scatter(v, d_made * p.c1) + scatter(u, d_made * p.c2)
        grads = (d_r, d_q, d_b, (rv * d_made).sum(axis=0), (ru * d_made).sum(axis=0))
        for f, s, d in zip(fields, state, grads, strict=True):
            s += d * d
            getattr(p, f)[...] += rate * d / np.sqrt(s)


def trigrams(ids: list[list[int]], end: int, n: int) -> np.ndarray:
    """Codes (u * n + v) * n + w of all words w; before a text stands its end mark, twice."""
    w = np.fromiter((i for x in ids for i in x), np.int64)
    v = np.concatenate([[end], w[:-1]])
    u = np.concatenate([[end, end], w[:-2]])[:len(w)]
    u[np.cumsum([0, *(len(x) for x in ids)])[:-1]] = end  # the text before ends with its end mark: v is right
    return (u * n + v) * n + w


def train(rows: DataFrame, classes: list[bytes], shares: np.ndarray) -> Parameters:
    """Fit to all rows of ``text``. A first round over a sixteenth of them gives a common start;
    in the second, every task improves its own copy on all of its texts. Each round ends with
    the mean of the copies, weighted by tokens, summed by PARTS tasks."""
    n, end = len(shares), len(classes)
    spark = rows.sparkSession
    number = {w: i for i, w in enumerate(classes)}
    now = Parameters.start(shares).flat()

    def round_of(part: DataFrame, flat: np.ndarray) -> np.ndarray:
        given = spark.sparkContext.broadcast((flat, number, shares))

        def run(batches):
            flat, number, shares = given.value
            p, state, rng, total = Parameters.of(flat, n), [], np.random.default_rng(7), 0
            held, size, other = [], 0, n - 1

            def learn():
                codes, counts = np.unique(np.concatenate(held), return_counts=True)
                improve(p, codes, counts, shares, rng, state)
                held.clear()

            for batch in batches:
                for _, _, texts in _texts(batch):
                    held.append(trigrams([[number.get(w, other) for w in tokens(t)] + [end] for t in texts], end, n))
                    size += len(held[-1])
                    total += len(held[-1])
                    if size > 1_000_000:
                        learn()
                        size = 0
            if size:
                learn()
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([int(rng.integers(PARTS))]), pa.array([total]), pa.array([(p.flat().astype(np.float64) * total).tobytes()])], ["part", "n", "sum"])

        def add(table: pa.Table) -> pa.Table:
            whole = sum(np.frombuffer(x.as_py()) for x in table.column("sum"))
            return pa.table({"n": [pc.sum(table.column("n")).as_py()], "sum": [whole.tobytes()]})

        made = part.select("text").mapInArrow(run, "part long, n long, sum binary")
        got = made.groupBy("part").applyInArrow(add, "n long, sum binary").collect()
        total = sum(r["n"] for r in got)
        return (sum(np.frombuffer(r["sum"]) for r in got) / total).astype(np.float32) if total else flat

    now = round_of(rows.filter("pmod(xxhash64(text), 16) = 0"), now)
    now = round_of(rows, now)
    return Parameters.of(now, n)


def score_documents(docs: DataFrame, is_held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Log-probabilities (base 10) of every whole text, learnt from the rows that aren't held out.

    Returns id_col, held_out, n_tokens, n_known, train_tokens, base_score, score. Tokens are the
    words, A-Z in lower case, and then one end. base_score: the sum over tokens of
    log10((c + 1) / (N + V + 1)), c the token's count, N the number of tokens and V of distinct
    ones, all in training rows. score: the model's normalised log-probability. The CLASSES most
    frequent words, the end, and "any other word" are predicted by the log-bilinear model from
    the two words before, whose normalisers are had for all pairs by matrix products; another
    word's share among the others is (c + 1) / (N' + V' + 1), N' and V' being theirs.

    Counts of frequent words are held by the workers; the rest of a text's words are looked up by
    a join on a 64-bit hash. Null texts count as empty (one token, the end). A null held-out
    mark means training. Null and repeated ids are kept as rows; no rows give no rows. Without
    training rows c, N and V are 0.
    """
    spark = docs.sparkSession
    rows = lean(docs).select(F.col(id_col).alias("id"), F.coalesce(is_held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    training = rows.filter("not held_out")
    counts = settle(count_words(training))
    whole = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.col("word") == "", F.col("c"))).alias("ends")).first()
    n_tokens, n_types, ends = whole["n"] or 0, whole["v"], whole["ends"] or 0

    short = counts.filter(f"word != '' and octet_length(word) <= {LONG}")
    levels, left, least = short.groupBy("c").count().orderBy(F.desc("c")), HELD_WORDS, 1
    for level in levels.toLocalIterator():
        left -= level["count"]
        if left < 0:
            least = level["c"] + 1
            break
    held = short.filter(F.col("c") >= least).toArrow()
    order = np.lexsort((np.array(held.column("word").to_pylist(), dtype=object).astype(str), -held.column("c").to_numpy())) if len(held) else []
    words = [held.column("word")[int(i)].as_py().encode() for i in order]
    count = np.array([held.column("c")[int(i)].as_py() for i in order], np.int64)
    classes = words[:CLASSES]
    n_classes, end, other = len(classes) + 2, len(classes), len(classes) + 1
    named = count[:len(classes)]
    rest_tokens, rest_types = n_tokens - int(named.sum()) - ends, n_types - len(classes) - (ends > 0)
    shares = np.concatenate([named, [ends, rest_tokens]]) + 1.0
    shares /= shares.sum()
    near, far, norm = train(training, classes, shares).tables()
    given = spark.sparkContext.broadcast((b"\n".join(words), count, near, far, norm))
    base_of = math.log10(n_tokens + n_types + 1)
    rest_of = math.log10(rest_tokens + rest_types + 1)

    def run(batches):
        joined, count, near, far, norm = given.value
        place = {w: i for i, w in enumerate(joined.split(b"\n"))} if joined else {}
        logs = np.append(np.log10(count + 1.0), 0.0)
        for batch in batches:
            for a, b, texts in _texts(batch):
                out = {k: [] for k in ("n_tokens", "n_known", "base", "score", "rare", "times")}
                for t in texts:
                    w = tokens(t)
                    at = np.fromiter((place.get(x, -1) for x in w), np.int64, len(w))
                    rare = Counter([w[i] for i in np.flatnonzero(at < 0)])
                    kind = np.append(np.where((at >= 0) & (at < len(classes)), at, other), end)
                    v = np.concatenate([[end], kind[:-1]])
                    u = np.concatenate([[end, end], kind[:-2]])[:len(kind)]
                    p = near[v, kind].astype(np.float64) + far[u, kind] - norm[u, v]
                    sum_all = logs[at].sum()
                    tail = kind[:-1] == other
                    out["n_tokens"].append(len(kind))
                    out["n_known"].append(int((at >= 0).sum()) + (ends > 0))
                    out["base"].append(float(sum_all + math.log10(ends + 1) - len(kind) * base_of))
                    out["score"].append(float(p.sum() / math.log(10) + logs[at[tail]].sum() - tail.sum() * rest_of))
                    out["rare"].append([xxhash.xxh64_intdigest(x, 42) for x in rare])
                    out["times"].append(list(rare.values()))
                lengths = np.cumsum([0, *map(len, out["rare"])])
                flat = np.fromiter((h for x in out["rare"] for h in x), np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(a, b - a), batch.column("held_out").slice(a, b - a),
                    *(pa.array(out[k], pa.int64()) for k in ("n_tokens", "n_known")), *(pa.array(out[k], pa.float64()) for k in ("base", "score")),
                    pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat)), pa.array(out["times"], pa.list_(pa.int32())),
                ], ["id", "held_out", "n_tokens", "n_known", "base", "score", "rare", "times"])

    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<long>, times array<int>")
    scored = settle(scored.withColumn("row", F.monotonically_increasing_id()))
    looked = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("k"))
    table = counts.filter(f"word != '' and (octet_length(word) > {LONG} or c < {least})").select(F.xxhash64("word").alias("h"), "c")
    # words that training never showed add nothing to either sum
    more = looked.join(table, "h").groupBy("row").agg(F.sum("k").alias("more_known"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("more"))
    out = scored.drop("rare", "times").join(more, "row", "left")
    extra = F.coalesce(F.col("more"), F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"), (F.col("base") + extra).alias("base_score"), (F.col("score") + extra).alias("score"),
    )
