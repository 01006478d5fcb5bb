"""N-gram Jaccard join: rare-first prefixes, length, positional and suffix filters, exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, lean, settle, slices
from .components import connected_components

WORDS = 5
#: Jaccard similarity from which two documents link, in hundredths.
PERCENT = 75
#: N-grams whose document frequencies every worker holds, at most; any others count as rare.
HELD_GRAMS = 300_000
#: Sharers of a prefix n-gram up to which all of its pairs are candidates at once.
SMALL_RUN = 8
#: Centres that texts are verified against where many share their n-grams, before pairs are.
CENTRES = 4
#: Prefix n-grams of a partition, on average.
PART_ROWS = 600_000
#: Parts of the hash space in a set's profile.
BINS = 128
FILTER_BITS = 25
BATCH_BYTES = 1 << 20
COUNTED = 1_500_000
#: Texts that a task remembers, so that copies are met once; then it starts anew.
REMEMBERED = 500_000
#: N-grams that a row of a shared one names, so that few pairs are made twice.
NAMED = 16
_P = np.uint64(0x9E3779B97F4A7C15)


def _words(texts: pa.Array):
    """Hashes of all texts' words, where each text's begin, and the key of each text that has any, by its place.

    A-Z is lowered and words are what stands between ASCII white space. Equal sequences of words
    have equal keys. Hashes and keys have 64 bits. All texts are worked on at once, as arrays.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, at = lists.flatten(), np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py()
    full = np.asarray(pc.greater(pc.binary_length(words), 0))
    if not full.all():  # white space before the first word or behind the last
        words = words.filter(pa.array(full))
        at = np.concatenate([[0], np.cumsum(full)])[at]
    coded = words.dictionary_encode()
    table = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    h = table[np.asarray(coded.indices)]
    lengths = np.diff(at)
    nth = np.arange(len(h), dtype=np.int64) - np.repeat(at[:-1], lengths)
    keyed = (h ^ (nth.astype(np.uint64) * _P)) * np.uint64(0xC2B2AE3D27D4EB4F)
    keyed ^= keyed >> np.uint64(31)
    some = np.flatnonzero(lengths)
    keys = np.add.reduceat(keyed * _P, at[some]) if len(some) else keyed
    return h, at, dict(zip(some.tolist(), keys.view(np.int64).tolist(), strict=True))


def shingles(texts: pa.Array):
    """For each text its key and its sorted distinct n-grams, by 64-bit hashes; (None, none) without words.

    With fewer words than an n-gram has, the whole sequence is the one n-gram.
    """
    h, at, place = _words(texts)
    n = len(h)
    g = np.zeros(n, np.uint64)
    for k in range(WORDS):
        m = max(0, n - k)
        g[:m] = (g[:m] ^ h[k:k + m]) * _P
        g ^= g >> np.uint64(29)
    for i, (start, end) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if start == end:
            yield None, g[:0]
        elif end - start < WORDS:
            yield place[i], np.array([place[i] ^ (end - start)], np.int64).view(np.uint64)
        else:
            own = np.sort(g[start:end - WORDS + 1])
            yield place[i], own[np.append(True, own[1:] != own[:-1])]


def _remember(met: set, key: int) -> None:
    if len(met) >= REMEMBERED:
        met.clear()
    met.add(key)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-n * percent // 100) + 1


def _slices(text):
    for a, b in slices(pc.binary_length(text).to_pylist(), BATCH_BYTES):
        yield a, b, text.slice(a, b - a)


def _texts(batch):
    yield from _slices(batch.column("text"))


def profile(grams: np.ndarray) -> bytes:
    """How many n-grams fall into each of BINS parts of the hash space, up to 255: what the suffix filter needs of a set."""
    return np.minimum(np.bincount((grams >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()


def _survey(rows: DataFrame) -> DataFrame:
    """A row (id, key, n, bins) for each document, and rows (gram, df) for n-grams that a task met in two texts or more."""
    def run(batches):
        met, held, size = set(), [], 0
        names = ["id", "key", "n", "bins", "gram", "df"]
        kind = None

        def frequent():
            g, n = np.unique(np.concatenate(held), return_counts=True)
            g, n = g[n > 1].view(np.int64), n[n > 1]
            none = pa.nulls(len(g), pa.int64())
            return pa.RecordBatch.from_arrays([pa.nulls(len(g), kind), none, none, pa.nulls(len(g), pa.binary()), pa.array(g), pa.array(n)], names)

        for batch in batches:
            kind = batch.column("id").type
            for a, b, texts in _texts(batch):
                keys, sizes, bins = [], [], []
                for key, grams in shingles(texts):
                    keys.append(key)
                    sizes.append(len(grams))
                    bins.append(profile(grams))
                    if key is not None and key not in met:
                        _remember(met, key)
                        held.append(grams)
                        size += len(grams)
                none = pa.nulls(b - a, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bins, pa.binary()), none, none], names)
                if size > COUNTED:
                    yield frequent()
                    held, size = [], 0
        if held:
            yield frequent()

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, key long, n long, bins binary, gram long, df long")


def _frequent(survey: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams and how often they were met, by n-gram; HELD_GRAMS at most."""
    table = settle(survey.filter("gram is not null").groupBy("gram").agg(F.sum("df").alias("df")).filter("df > 3"))
    left, least = HELD_GRAMS, 0
    for level in table.groupBy("df").count().orderBy(F.desc("df")).toLocalIterator():
        left -= level["count"]
        if left < 0:
            least = level["df"] + 1
            break
    got = table.filter(F.col("df") >= least).toArrow()
    gram, df = got.column("gram").to_numpy().view(np.uint64), got.column("df").to_numpy()
    order = np.argsort(gram)
    return gram[order], df[order]


class Order:
    """The one order of n-grams that all documents follow: rarest first, ties by hash."""

    def __init__(self, frequent: tuple[np.ndarray, np.ndarray]):
        self.table, self.df = frequent
        self.marks = np.zeros(1 << 22, bool)
        self.marks[(self.table >> np.uint64(42)).astype(np.int64)] = True

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        """Sorted n-grams in that order."""
        maybe = np.flatnonzero(self.marks[(grams >> np.uint64(42)).astype(np.int64)])
        if not len(maybe):
            return grams
        at = np.minimum(np.searchsorted(self.table, grams[maybe]), len(self.table) - 1)
        known = self.table[at] == grams[maybe]
        maybe, at = maybe[known], at[known]
        last = maybe[np.argsort(self.df[at], kind="stable")]
        return np.concatenate([np.delete(grams, maybe), grams[last]])


def passes(n1, i1, n2, i2, percent: int = PERCENT):
    """Whether pairs may link, by arrays of sizes and places of a shared n-gram.

    Length: the smaller set must be large enough. Positional: were it the rarest n-gram that they
    share, all of the overlap would lie in what is left of both sets from there on. Sets that
    link pass at the rarest n-gram that they share.
    """
    need = -(-(n1 + n2) * percent // (100 + percent))
    ok = 100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)
    return ok & (np.minimum(n1 - i1, n2 - i2) >= need)


def overlap_bound(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Most n-grams that pairs of sets can share, by rows of their counts in parts of the hash space: the suffix filter.

    That filter cuts two sorted suffixes at a probe and at its place in the other, again and again
    to a given depth; in every part the sizes' difference is a lower bound on how many elements
    differ. Here the probes are the same hashes for all sets, BINS - 1 of them, which makes the
    parts of all sets comparable without either set at hand, to depth log2(BINS) instead of the
    usual two or three, and over whole sets. A part with 255 n-grams or more bounds nothing.
    """
    least = np.minimum(one, other).astype(np.int64)
    return np.where((least == 255).any(axis=1), np.iinfo(np.int64).max, least.sum(axis=1))


def _postings(rows: DataFrame, frequent) -> DataFrame:
    given = rows.sparkSession.sparkContext.broadcast(frequent)  # HELD_GRAMS entries of 16 bytes at most

    def run(batches):
        met, order = set(), Order(given.value)
        for batch in batches:
            for _, _, texts in _texts(batch):
                out = []
                for key, grams in shingles(texts):
                    if key is None or key in met:
                        continue
                    _remember(met, key)
                    n = len(grams)
                    k = prefix_length(n)
                    out.append(np.stack([order(grams)[:k].view(np.int64), (n << 32) + np.arange(k), np.full(k, key)]))
                if out:
                    yield pa.RecordBatch.from_arrays([*map(pa.array, np.concatenate(out, axis=1))], ["gram", "place", "key"])

    return rows.mapInArrow(run, "gram long, place long, key long")  # in this order rows of a text have equal bytes together


def _pairs(i, j, key, n, at):
    ok = passes(n[i], at[i], n[j], at[j]) & (key[i] != key[j])
    i, j = i[ok], j[ok]
    return np.minimum(key[i], key[j]), np.maximum(key[i], key[j])


def _whole(batches, *columns: str) -> tuple:
    """The columns of all of a partition's rows."""
    parts = [[batch.column(c).to_numpy() for c in columns] for batch in batches]
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else tuple(np.zeros(0, np.int64) for _ in columns)


def _first_pairs(batches):
    """Pairs (a, b) of a partition's n-grams; rows of n-grams with many sharers are returned as well."""
    gram, key, place = _whole(batches, "gram", "key", "place")
    if not len(gram):
        return
    order = np.lexsort((place, gram))
    gram, key, place = gram[order], key[order], place[order]
    n, at = place >> 32, place & 0xFFFFFFFF
    starts = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    sizes = np.diff(np.append(starts, len(gram)))
    run = np.repeat(np.arange(len(starts)), sizes)
    left = starts[run] + sizes[run] - np.arange(len(gram)) - 1  # rows of the run that follow
    small = sizes[run] <= SMALL_RUN
    found = []
    for step in range(1, SMALL_RUN):
        i = np.flatnonzero(small & (left >= step))
        found.append(_pairs(i, i + step, key, n, at))
    large = []
    for s, size in zip(starts[sizes > SMALL_RUN], sizes[sizes > SMALL_RUN], strict=True):
        own = s + np.unique(key[s:s + size], return_index=True)[1]
        own = own[np.argsort(n[own], kind="stable")]
        large.append(own)
        turn = key[own].view(np.uint64) * np.uint64(int(_P) * (int(gram[s]) % CENTRES * 2 + 1) % 2**64)
        first = 0
        while first < len(own):  # one star for each class of lengths; n-grams that the same texts share have different centres
            end = np.searchsorted(n[own] * PERCENT, n[own[first]] * 100, "right")
            centre = own[first + np.argmin(turn[first:end])]
            found.append(_pairs(np.full(end - first, centre), own[first:end], key, n, at))
            first = end
    a, b = (np.concatenate(c) for c in zip(*found, strict=True))
    both = np.unique(np.stack([a, b]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
    rows = np.concatenate(large) if large else np.zeros(0, int)
    none = lambda k: pa.nulls(k, pa.int64())
    k, m = both.shape[1], len(rows)
    columns = [pa.concat_arrays([pa.array(x), none(m)]) for x in both] + [pa.concat_arrays([none(k), pa.array(x[rows])]) for x in (gram, key, place)]
    yield pa.RecordBatch.from_arrays(columns, ["a", "b", "gram", "key", "place"])


def _cross_pairs(batches):
    """Pairs of n-grams with many sharers, of rows that no component joins yet, which the profiles don't rule out.

    A pair is made for the first n-gram, in their order, that both rows name among ``shared``,
    where the positional filter leaves it the most room, and hence once; pairs that have no such
    n-gram are made for each that they share, and met again when pairs are made distinct.
    """
    gram, key, place, part, bins, shared = [], [], [], [], [], []
    for batch in batches:
        for c, held in (("gram", gram), ("key", key), ("place", place), ("part", part)):
            held.append(batch.column(c).to_numpy())
        bins.append(np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, BINS))
        shared += batch.column("shared").to_pylist()
    if not gram:
        return
    gram, key, place, part, bins = (np.concatenate(c) for c in (gram, key, place, part, bins))
    order = np.lexsort((place >> 32, gram))
    gram, key, place, part, bins = gram[order], key[order], place[order], part[order], bins[order]
    lists, sets = [shared[i] for i in order], {}

    def first(i: int, j: int) -> bool:
        if j not in sets:
            sets[j] = frozenset(lists[j])
        return next((g for g in lists[i] if g in sets[j]), gram[i]) == gram[i]

    n, at = place >> 32, place & 0xFFFFFFFF
    ends = np.searchsorted(gram, gram, "right")
    found, held = [np.zeros((2, 0), np.int64)], 0

    def batch():
        both = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    for i in range(len(gram)):
        end = i + 1 + np.searchsorted(n[i + 1:ends[i]] * PERCENT, n[i] * 100, "right")
        j = np.arange(i + 1, end)
        j = j[(part[j] != part[i]) & passes(n[i], at[i], n[j], at[j])]
        if len(j):
            j = j[_enough(bins[i][None, :], bins[j], n[i] + n[j])]
            j = np.array([x for x in j.tolist() if first(i, x)], np.int64)
        if len(j):
            found.append(np.stack(_pairs(np.full(len(j), i), j, key, n, at)))
            held += found[-1].shape[1]
        if held > 500_000:
            yield batch()
            found, held = found[:1], 0
    yield batch()


def _enough(one: np.ndarray, other: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Whether profiles of sets with ``total`` n-grams together leave room for the overlap that a link needs."""
    return (100 + PERCENT) * np.minimum(overlap_bound(one, other), total) >= PERCENT * total


def _bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose profiles leave room for the overlap that a link needs."""
    first = nodes.select(F.col("key").alias("k1"), F.col("n").alias("n1"), F.col("bins").alias("p1"))
    second = nodes.select(F.col("key").alias("k2"), F.col("n").alias("n2"), F.col("bins").alias("p2"))

    def run(batches):
        for batch in batches:
            one, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("p1", "p2"))
            ok = pa.array(_enough(one, other, batch.column("n1").to_numpy() + batch.column("n2").to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])

    joined = pairs.join(first, F.col("a") == F.col("k1")).join(second, F.col("b") == F.col("k2"))
    return joined.select("a", "b", "n1", "p1", "n2", "p2").mapInArrow(run, "a long, b long")


def _wanted(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """key and text of one text for each of ``keys``.

    A bit array of fixed size, a filter that lets some others pass, keeps most of the other
    texts from being sent to the join that follows.
    """
    size = 1 << FILTER_BITS

    def mark(batches):
        bits = np.zeros(size, bool)
        for batch in batches:
            bits[batch.column("key").to_numpy() & (size - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()])], ["bits"])

    marks = np.zeros(size // 8, np.uint8)
    for r in keys.select("key").repartition(2).mapInArrow(mark, "bits binary").collect():
        marks |= np.frombuffer(r["bits"], np.uint8)
    given = rows.sparkSession.sparkContext.broadcast(marks.tobytes())

    def run(batches):
        bits = np.frombuffer(given.value, np.uint8)
        met = set()
        for batch in batches:
            for _, _, texts in _texts(batch):
                out = []
                for i, key in _words(texts)[2].items():
                    low = key & (size - 1)
                    if bits[low >> 3] >> (7 - (low & 7)) & 1 and key not in met:
                        _remember(met, key)
                        out.append((i, key))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([k for _, k in out], pa.int64()), texts.take(pa.array([i for i, _ in out]))], ["key", "text"])

    made = rows.mapInArrow(run, "key long, text string")
    return made.join(keys.select(F.col("key").alias("k")), F.col("key") == F.col("k"), "left_semi").dropDuplicates(["key"])


def _verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs whose sets' similarity reaches PERCENT; each is verified once, from the two texts."""
    keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    texts = _wanted(rows, keys)  # both joins read the one exchange in which texts are dealt by key
    first = texts.select(F.col("key").alias("k1"), F.col("text").alias("t1"))
    second = texts.select(F.col("key").alias("k2"), F.col("text").alias("t2"))
    both = pairs.join(first, F.col("a") == F.col("k1")).join(second, F.col("b") == F.col("k2"))

    def run(batches):
        for batch in batches:
            sets = {}
            for keys, column in (("a", "t1"), ("b", "t2")):
                new = {k: i for i, k in enumerate(batch.column(keys).to_pylist()) if k not in sets}
                if new:
                    some = batch.column(column).take(pa.array(new.values()))
                    sets |= zip(new, (grams for _, _, part in _slices(some) for _, grams in shingles(part)), strict=True)
            ok = []
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = sets[x], sets[y]
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * shared >= PERCENT * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok, pa.bool_())), batch.column("b").filter(pa.array(ok, pa.bool_()))], ["a", "b"])

    return settle(both.select("a", "b", "t1", "t2").mapInArrow(run, "a long, b long"))


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents that links of Jaccard similarity PERCENT or more connect.

    Returns id_col, n_shingles (distinct n-grams of WORDS words, A-Z in lower case) and
    component_id, the smallest id reachable by links, the own one included. Texts with equal
    words are one node. A document's prefix holds its rarest n-grams, so many that two
    documents that link share one of them. Pairs that share a prefix n-gram and pass the filters
    are verified once, by their whole sets. Where many share one, they are first verified
    against one of them, and then only pairs that are still in different components: no link
    between components is missed, and groups of near copies are not expanded into pairs.

    Documents without words, null texts included, have 0 n-grams and link with nothing. Null and
    repeated ids are kept as rows; a group whose ids are all null has a null component. No rows
    give no rows; other columns are ignored.
    """
    rows = lean(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    survey = free(settle(_survey(rows)))
    light = survey.filter("gram is null").select("id", "key", "n")
    nodes = survey.filter("key is not null").groupBy("key").agg(F.first("n").alias("n"), F.first("bins").alias("bins"))
    frequent = _frequent(survey)
    n_grams = light.agg(F.sum("n")).first()[0] or 0
    n_parts = max(1, int(n_grams * (1 - PERCENT / 100)) // PART_ROWS + 1)
    first = free(settle(_postings(rows, frequent).repartition(n_parts, "gram").mapInArrow(_first_pairs, "a long, b long, gram long, key long, place long")))
    pairs = settle(_bounded(first.filter("a is not null").select("a", "b").distinct(), nodes))
    links = free(_verified(pairs, rows))
    large = first.filter("gram is not null").select("gram", "key", "place")
    if large.limit(1).count():
        parts = connected_components(links)
        named = large.join(parts, F.col("key") == F.col("node"), "left").select("gram", "key", "place", F.coalesce("component", "key").alias("part"))
        mixed = named.groupBy(F.col("gram").alias("g")).agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi")
        lists = large.groupBy(F.col("key").alias("s")).agg(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("place", "gram"))), 1, NAMED), lambda x: x["gram"]).alias("shared"))
        rest = named.join(mixed, F.col("gram") == F.col("g"), "left_semi").join(nodes.select(F.col("key").alias("k"), "bins"), F.col("key") == F.col("k")).join(lists, F.col("key") == F.col("s"))
        at = F.array_position("shared", F.col("gram")).cast("int")
        upto = F.slice("shared", F.lit(1), F.when(at > 0, at).otherwise(NAMED))  # what stands behind can't come first
        rest = rest.select("gram", "key", "place", "part", "bins", upto.alias("shared")).repartition(n_parts, "gram")
        cross = rest.mapInArrow(_cross_pairs, "a long, b long").distinct()
        done = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"))
        cross = settle(cross.join(done, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left_anti"))
        if cross.limit(1).count():
            links = links.unionByName(free(_verified(cross, rows)))
    parts = connected_components(links)
    least = light.filter("key is not null").groupBy("key").agg(F.min("id").alias("least"))
    parted = least.join(parts, F.col("key") == F.col("node"), "left").select("key", "least", F.coalesce("component", "key").alias("part"))
    heads = parted.groupBy("part").agg(F.min("least").alias("head")).select(F.col("part").alias("p"), "head")
    named = parted.join(heads, F.col("part") == F.col("p")).select(F.col("key").alias("k"), "head")
    return light.join(named, F.col("key") == F.col("k"), "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("head")).alias("component_id"),
    )
