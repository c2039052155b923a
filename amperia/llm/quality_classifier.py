"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with a calibrated temperature.

Every word, and every shape of words, has a fixed sparse random index vector, a word's drawn by its own 64-bit hash: there is no table of words that grows or fills up. A word's context vector is the mean of the index vectors of its neighbours: over all its occurrences in the corpus, summed up by Spark, if it makes up more than LEAST_SHARE of all words, else over the occurrence at hand. So every word has vectors, and at most 1 / LEAST_SHARE words have learnt ones at any size of the corpus: these are broadcast. A document is the pooled vectors of its words and a few counts. The network is trained in numpy on the driver, on at most MOST_LABELLED pooled rows of labelled documents (never on held-out rows, never texts); a part of them sets the temperature. Scoring is one pass over all documents.

Null and empty texts have no words and get the score of zero vectors. A very long text is worked on by CHUNK words. Rows that repeat are scored each; a null doc_id is scored but never learnt from. Without labels of both classes, every score is the share of label 1 (0.5 without labels). Ties: a score of exactly the threshold passes. An empty table gives an empty result. Other columns are not read (quality_scores) or pass through (quality_filter), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .flat import slices, word_bounds, word_hashes
from .labelled import bounded, fold, with_label

#: Shapes of words; dimensions of the vectors; neighbours on each side.
SHAPES, DIMS, WINDOW = 256, 32, 2
#: A word has a learnt vector if it stands twice and makes up more than this share of all words.
LEAST_SHARE = 2e-6
#: Labelled rows that the network is trained on at most; hidden units; passes over them.
MOST_LABELLED, HIDDEN, EPOCHS = 20_000, 32, 60
THRESHOLD = 0.3
FEATURES = 3 * DIMS + 6
#: Words worked on at once; words whose counts a task holds before it sends them; words after which a task sends its sums.
CHUNK, HELD_WORDS, HELD_SUMS = 1 << 13, 300_000, 20_000_000
#: Keys of the number of all words, and of the shapes (from SHAPE on), among the words' hashes.
TOTAL, SHAPE = -1, -1000
#: Learnt vectors are kept as whole numbers of this part of one.
STEP = 127


def index_vectors() -> np.ndarray:
    """The random index vector of each shape: four entries of +1 or -1."""
    r = np.random.default_rng(7)
    v = np.zeros((SHAPES, DIMS), np.int8)
    for _ in range(4):
        v[np.arange(len(v)), r.integers(0, DIMS, len(v))] += r.choice([-1, 1], len(v)).astype(np.int8)
    return v


def _two_entries() -> np.ndarray:
    """By 12 bits two entries: 5 bits of place and one of sign each."""
    k = np.arange(4096)
    v = np.zeros((4096, DIMS), np.int8)
    for bits in (k & 63, k >> 6):
        v[k, bits >> 1] += (1 - 2 * (bits & 1)).astype(np.int8)
    return v


TWO = _two_entries()


def own_index(h: np.ndarray) -> np.ndarray:
    """The random index vector of each word by its hash: four entries of +1 or -1."""
    return TWO[(h & np.uint64(4095)).astype(np.int64)] + TWO[((h >> np.uint64(12)) & np.uint64(4095)).astype(np.int64)]


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: its shape, its row, its 64-bit hash. The shape: kind of the first and the last two bytes, capitals."""
    starts, ends, row = word_bounds(data, offsets)
    h = word_hashes(data, starts, ends)
    kind = np.full(256, 4, np.int16)  # other signs
    for k, (a, b) in enumerate(((97, 123), (65, 91), (48, 58), (128, 256))):
        kind[a:b] = k
    if not len(h):
        return np.zeros(0, np.int16), row, h
    capitals = np.concatenate(([0], np.cumsum((data >= 65) & (data < 91), dtype=np.int32)))
    many = (2 * (capitals[ends] - capitals[starts]) > ends - starts).astype(np.int16)
    shape = ((kind[data[starts]] * 5 + kind[data[ends - 1]]) * 5 + kind[data[np.maximum(ends - 2, starts)]]) * 2 + many
    return shape % SHAPES, row, h


def neighbours(shape: np.ndarray, row: np.ndarray, h: np.ndarray, index: np.ndarray, a: int, b: int) -> np.ndarray:
    """Of the words from a to b the sums of the index vectors (of word and shape) of their neighbours in the same row."""
    lo, hi = max(0, a - WINDOW), min(len(h), b + WINDOW)
    own, r = own_index(h[lo:hi]) + index[shape[lo:hi]], row[lo:hi]
    near = np.zeros_like(own)
    for k in range(1, WINDOW + 1):
        same = (r[k:] == r[:-k])[:, None]
        near[k:] += own[:-k] * same
        near[:-k] += own[k:] * same
    return near[a - lo : b - lo]


def added(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each key once, sorted, with its sums."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[cut], *(np.add.reduceat(v[order], cut, axis=0, dtype=np.int32 if v.dtype == np.int8 else v.dtype) if len(cut) else v for v in values)


def packed(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(rows)])


def as_batches(keys: np.ndarray, n: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    """h, n, sums; sums as bytes where they fit, for the shuffle."""
    small = np.abs(sums).max(1, initial=0) < 128
    for at, kind in ((small, np.int8), (~small, np.int64)):
        if at.any():
            yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(n[at]), packed(sums[at].astype(kind))], ["h", "n", "sums"])


def unpacked(sums: pa.Array) -> np.ndarray:
    x = np.zeros((len(sums), DIMS), np.int64)
    wide = pa.compute.binary_length(sums).to_numpy(zero_copy_only=False) > DIMS
    for kind, at in ((np.int8, ~wide), (np.int64, wide)):
        x[at] = np.frombuffer(b"".join(sums.filter(pa.array(at)).to_pylist()), kind).reshape(-1, DIMS)
    return x


class Lookup:
    """Places of keys (64-bit hashes, each once) in a list of them, by open addressing."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.mask = keys, np.int64((1 << max(4, (4 * len(keys)).bit_length())) - 1)
        self.slot = np.full(int(self.mask) + 1, -1, np.int32)
        left, at = np.arange(len(keys)), keys & self.mask
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]
            open_ = self.slot[at] != left
            left, at = left[open_], (at[open_] + 1) & self.mask

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each h, -1 where it is not among the keys."""
        out, left, at = np.full(len(h), -1, np.int32), np.arange(len(h)), h & self.mask
        while len(left):
            s = self.slot[at]
            hit = (s >= 0) & (self.keys[s] == h[left]) if len(self.keys) else np.zeros(len(s), bool)
            out[left[hit]] = s[hit]
            go = (s >= 0) & ~hit
            left, at = left[go], (at[go] + 1) & self.mask
        return out


def word_counts(docs: DataFrame) -> DataFrame:
    """h, n: how often each word stands in docs, and all words under TOTAL."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, every = [], 0, 0
        batch = lambda h, n: pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])
        for b in batches:
            for _, _, data, at in slices(b.column(0)):
                h = word_hashes(data, *word_bounds(data, at)[:2]).view(np.int64)
                held.append(np.unique(h, return_counts=True))
                every, rows = every + len(h), rows + len(held[-1][0])
                if rows > HELD_WORDS:
                    held = [added(*map(np.concatenate, zip(*held)))]
                    rows = len(held[0][0])
                    if rows > HELD_WORDS:
                        yield batch(*held[0])
                        held, rows = [], 0
        held.append((np.array([TOTAL]), np.array([every])))
        yield batch(*added(*map(np.concatenate, zip(*held))))

    return docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def common_words(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes and counts of the words that have a learnt vector, sorted by hash, and the number of all words."""
    counts = written(word_counts(docs).filter(F.col("n") > 1), "word-counts")
    total = counts.filter(F.col("h") == TOTAL).agg(F.sum("n")).first()[0] or 0
    got = counts.filter((F.col("h") != TOTAL) & (F.col("n") > LEAST_SHARE * total)).toArrow()  # 1 / LEAST_SHARE rows at most
    keys, n = got.column(0).to_numpy(), got.column(1).to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order], total


def word_sums(docs: DataFrame, words: Broadcast) -> DataFrame:
    """h, n, sums: of each word of the lookup, and of each shape (h = SHAPE - shape), how often it stands in docs and the sum of its neighbours' index vectors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, find = index_vectors(), words.value
        names = np.concatenate((find.keys, SHAPE - np.arange(SHAPES)))
        sums, n, rows = np.zeros((len(names), DIMS), np.int32), np.zeros(len(names), np.int64), 0

        def out() -> Iterator[pa.RecordBatch]:
            at = np.flatnonzero(n)
            for k in range(0, len(at), CHUNK):
                yield from as_batches(*(x[at[k : k + CHUNK]] for x in (names, n, sums)))

        for b in batches:
            for _, _, data, at in slices(b.column(0)):
                shape, row, h = tokens(data, at)
                place = find.find(h.view(np.int64))
                for a in range(0, len(h), CHUNK):
                    z = min(len(h), a + CHUNK)
                    near, part = neighbours(shape, row, h, index, a, z), place[a:z]
                    known = part >= 0
                    for keys, x in ((part[known], near[known]), (shape[a:z].astype(np.int64) + len(find.keys), near)):
                        keys, m, x = added(keys, np.ones(len(keys), np.int64), x)
                        sums[keys] += x
                        n[keys] += m
                rows += len(h)
                if rows > HELD_SUMS:
                    yield from out()
                    sums[:], n[:], rows = 0, 0, 0
        yield from out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:  # sorted by h: the last one may go on in the next batch
            if not len(b):
                continue
            part = (b.column(0).to_numpy(), b.column(1).to_numpy(), unpacked(b.column(2)))
            part = added(*(part if last is None else map(np.concatenate, zip(last, part))))
            last = tuple(x[-1:] for x in part)
            yield from as_batches(*(x[:-1] for x in part))
        if last is not None:
            yield from as_batches(*last)

    kind = "h long, n long, sums binary"
    return docs.select("text").mapInArrow(count, kind).repartition("h").sortWithinPartitions("h").mapInArrow(add, kind)


def normal(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(1e-9, np.linalg.norm(v, axis=1, keepdims=True))


class Vectors:
    """What pooling needs: centre of all neighbourhoods; the learnt vectors and weights of words, the vectors of shapes; the weight of all other words."""

    def __init__(self, keys: np.ndarray, seen: np.ndarray, total: int, sums: pa.Table) -> None:
        h, n = (sums.column(k).to_numpy() for k in (0, 1))
        s = unpacked(sums.column(2).combine_chunks()) if len(sums) else np.zeros((0, DIMS))
        shape = (h <= SHAPE) & (h > SHAPE - SHAPES)
        self.centre = (s[shape].sum(0) / max(1, total)).astype(np.float32)
        self.shapes, self.words = np.zeros((SHAPES, DIMS), np.float32), np.zeros((len(keys), DIMS), np.int8)
        v = normal(s / np.maximum(1, n)[:, None] - self.centre)
        self.shapes[SHAPE - h[shape]] = v[shape]
        self.words[np.searchsorted(keys, h[~shape])] = np.rint(v[~shape] * STEP)
        self.weight = np.append(np.log((total + 1) / (seen + 1)), np.log((total + 1) / (max(1, LEAST_SHARE * total) + 1))).astype(np.float32)
        self.find = Lookup(keys)


def vectors_of(docs: DataFrame) -> Broadcast:
    """Vectors learnt from all docs."""
    sc = docs.sparkSession.sparkContext
    keys, seen, total = common_words(docs)
    words = sc.broadcast(Lookup(keys))
    vectors = sc.broadcast(Vectors(keys, seen, total, word_sums(docs, words).toArrow()))  # 1 / LEAST_SHARE rows at most
    words.unpersist()
    return vectors


def by_row(x: np.ndarray, row: np.ndarray, out: np.ndarray, kind: type = np.float32) -> None:
    """Adds the rows of x to those of out that row (sorted) names."""
    if len(x):
        cut = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        out[row[cut]] += np.add.reduceat(x, cut, axis=0, dtype=kind)


def pooled(texts: pa.Array, v: Vectors) -> np.ndarray:
    """One row of features for each text."""
    index, out = index_vectors(), np.zeros((len(texts), FEATURES), np.float32)
    for i, j, data, at in slices(texts):
        shape, row, h = tokens(data, at)
        rows = j - i
        n = np.bincount(row, minlength=rows).astype(np.float32)
        some = np.maximum(1, n)[:, None]
        context, spread = np.zeros((rows, DIMS), np.float32), np.zeros(rows * DIMS, np.float32)
        shapes = np.zeros((rows, SHAPES), np.float32)
        place = v.find.find(h.view(np.int64))
        for a in range(0, len(h), CHUNK):
            z = min(len(h), a + CHUNK)
            p, r = place[a:z], row[a:z]
            known = p >= 0
            learnt = np.zeros((rows, DIMS), np.float32)
            by_row(v.words[p[known]], r[known], learnt, np.int32)
            context += learnt / STEP
            if not known.all():
                near = neighbours(shape, row, h, index, a, z)[~known]
                by_row(normal(near - v.centre), r[~known], context)
            # Four entries of a word's own index vector, each under its document and place.
            w, first = v.weight[p], int(r[0])
            for k in range(4):
                bits = ((h[a:z] >> np.uint64(6 * k)) & np.uint64(63)).astype(np.int64)
                got = np.bincount((r - first) * DIMS + (bits >> 1), w * (1 - 2 * (bits & 1)))
                spread[first * DIMS : first * DIMS + len(got)] += got
            got = np.bincount((r - first) * SHAPES + shape[a:z], minlength=(int(r[-1]) - first + 1) * SHAPES)
            shapes[first : int(r[-1]) + 1] += got.reshape(-1, SHAPES)
        context = (context + shapes @ v.shapes) / some
        spread = spread.reshape(rows, DIMS) / some
        same = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        twin = np.bincount(row[1:], same, rows).astype(np.float32) if len(h) > 1 else np.zeros(rows, np.float32)
        # How many different words the text has.
        key = np.sort((row.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
        cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        kinds = np.bincount((key[cut] >> np.uint64(44)).astype(np.int64), minlength=rows)
        lines = np.diff(np.searchsorted(np.flatnonzero(data == 10), at))
        out[i:j] = np.hstack((context, shapes @ index.astype(np.float32) / some, spread, np.log1p(n)[:, None], (np.linalg.norm(spread, axis=1) * np.sqrt(n))[:, None], twin[:, None] / some, (kinds / np.sqrt(np.maximum(1, n)))[:, None], (kinds / some[:, 0])[:, None], np.log1p(n / (1 + lines))[:, None]))
    return out


class Network:
    """Two layers, logistic output, trained by Adam; then one temperature for its log-odds."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        r = np.random.default_rng(11)
        self.rate = float(y.mean()) if len(y) else 0.5
        self.constant = len(y) < 8 or y.min() == y.max()
        if self.constant:
            return
        order = r.permutation(len(x))
        self.shift, self.scale = x.mean(0), x.std(0) + 1e-3
        x, y = ((x - self.shift) / self.scale)[order], y[order].astype(np.float32)
        part = max(4, len(x) // 5)  # sets the temperature
        hold, hold_y, x, y = x[:part], y[:part], x[part:], y[part:]
        self.w = [r.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w], 0
        for _ in range(max(EPOCHS, 200_000 // len(x) if len(x) < 4000 else 0)):
            for at in np.array_split(r.permutation(len(x)), max(1, len(x) // 128)):
                hidden, p = self._forward(x[at])
                d = (p - y[at]) / len(at)
                back = d[:, None] * self.w[2] * (1 - hidden**2)
                grads = [x[at].T @ back + 1e-4 * self.w[0], back.sum(0), hidden.T @ d + 1e-4 * self.w[2], d.sum(keepdims=True)]
                t += 1
                for k, g in enumerate(grads):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - 0.004 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        odds = self._odds(hold)
        losses = {q: np.logaddexp(0, -np.where(hold_y > 0, odds, -odds) / q).mean() for q in np.geomspace(0.3, 10, 60)}
        self.temperature = min(losses, key=losses.get)

    def _odds(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(x @ self.w[0] + self.w[1])
        return hidden, 1 / (1 + np.exp(-np.clip(hidden @ self.w[2] + self.w[3], -30, 30)))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant:
            return np.full(len(x), self.rate)
        return 1 / (1 + np.exp(-np.clip(self._odds((x - self.shift) / self.scale) / self.temperature, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> tuple[Broadcast, Network]:
    """Vectors of words, learnt from all docs, and network, learnt from labels outside the held-out fold."""
    shared = vectors_of(docs)
    learn = labels.filter(fold(F.col("doc_id"), folds) != held_out)
    rows = with_label(docs, bounded(learn, MOST_LABELLED, learn.count(), 3), "quality")

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), packed(pooled(b.column(1), shared.value))], ["doc_id", "label", "x"])

    got = rows.select("doc_id", "text", "label").mapInArrow(pool, "doc_id long, label int, x binary").toPandas().sort_values(["doc_id", "x"])
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, FEATURES)
    return shared, Network(x.astype(np.float64), got["label"].to_numpy())


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out and score of every document."""
    shared, network = fit(docs, labels, folds, held_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(network.score(pooled(b.column(1), shared.value).astype(np.float64)), pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score")


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, folds: int = 5, held_out: int = 0) -> DataFrame:
    """The rows of docs, with all their columns, that score threshold or more: texts are scored where they are read."""
    shared, network = fit(docs, labels, folds, held_out)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(network.score(pooled(b.column(at), shared.value).astype(np.float64)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op9_quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality_scores(docs, labels).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
