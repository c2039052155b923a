"""Toxicity by class-conditional Kneser-Ney models over bytes.

Two models of order 5, one for toxic and one for ordinary documents, each with its own counts for orders 5, 4 and 3 (continuation counts below the highest), back off to the same continuation counts of order 2 and 1, learnt from both classes: expressions that are rare in one class are smoothed by what both share. A document's log-likelihoods under both, normalised by length, are compared for the whole text and for its words; a logistic calibration, fit on labelled documents that the counts do not hold, makes a score of them.

The counts are gathered by Spark from every labelled document outside the held-out fold but those of the calibration, are kept under their full gram and grow with the corpus. Up to MOST_GRAMS grams of five bytes they are broadcast as sorted tables; more stay in Spark, and each text's distinct grams are joined to them. The calibration is fit on the driver on one labelled document in CALIBRATION, MOST_LABELLED rows of numbers at most.

Few labels miss some: of documents of 30 words, half of them with one planted toxic word, THRESHOLD caught 75.0% with 120 labelled documents (two thirds to learn from) and left 98.3% of the others alone; with 480, 100% and 99.6%, all toxic scores above all others.

Null and empty texts have zero for all comparisons and get that score. Letters A-Z count as a-z. Rows that repeat are scored each; a null doc_id is scored but never learnt from. Without labels of both classes, every score is the share of label 1 (0 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .flat import LOWER, slices, word_bounds
from .labelled import chosen, fold, with_label

ORDER, DISCOUNT = 5, 0.75
#: Grams of five bytes that may be broadcast (16 bytes each, about as much again for contexts and lower orders).
MOST_GRAMS = 4_000_000
THRESHOLD, MOST_LABELLED = 0.7, 20_000
CLASSES = ("toxic", "ordinary")
#: One labelled document in so many, up to MOST_LABELLED, is for the calibration instead of the counts.
CALIBRATION = 4
SPACE = 32


def plain(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Lower case, white space as one kind of byte, and every document's first byte too: what is before it belongs to another one."""
    low = LOWER[data]
    low[(low >= 9) & (low <= 13)] = SPACE
    return low


def grams(low: np.ndarray, at: np.ndarray) -> np.ndarray:
    """At each byte the integer of the five bytes that end there; before a document stand spaces."""
    x = np.full(len(low) + 4, SPACE, np.int64)
    x[4:] = low
    g = x[4:].copy()
    since = np.arange(len(low)) - np.repeat(at[:-1], np.diff(at))
    for k in range(1, ORDER):
        g |= np.where(since >= k, x[4 - k : len(x) - k], SPACE) << (8 * k)
    return g


def count_grams(rows: DataFrame) -> DataFrame:
    """gram, toxic, ordinary: how often each five bytes stand in documents (text, label) of either class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j, data, at in slices(b.column(0), 4 << 20):
                key = grams(plain(data, at), at) * 2 + np.repeat(label[i:j], np.diff(at))
                kinds, n = np.unique(key, return_counts=True)
                toxic = kinds & 1
                yield pa.RecordBatch.from_arrays([pa.array(kinds >> 1), pa.array(n * toxic), pa.array(n * (1 - toxic))], ["gram", "toxic", "ordinary"])

    counted = rows.select("text", "label").mapInArrow(run, "gram long, toxic long, ordinary long")
    return counted.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def levels(counts: DataFrame) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """For orders 5, 4 and 3: gram with its (continuation) counts, and context with totals and kinds of continuations, by class; then gram, both of order 2."""
    tables, level = [], counts
    for k in range(ORDER, 2, -1):
        context = level.groupBy(F.shiftright("gram", 8).alias("context")).agg(*(F.sum(c).alias(c) for c in CLASSES), *(F.count_if(F.col(c) > 0).alias(f"{c}_kinds") for c in CLASSES))
        tables.append((level.select("gram", *CLASSES), context))
        # Continuation counts: in how many kinds of left context the shorter gram stands.
        level = level.groupBy(F.col("gram").bitwiseAND(F.lit((1 << (8 * (k - 1))) - 1)).alias("gram")).agg(*(F.count_if(F.col(c) > 0).alias(c) for c in CLASSES), F.count("*").alias("both"))
    return tables, level.select("gram", "both")


def shared_orders(level: DataFrame) -> np.ndarray:
    """P(byte | one before) of both classes by pair of bytes."""
    pairs = np.zeros(65536)
    for g, n in level.collect():  # pairs of bytes, 65536 at most
        pairs[g] = n
    pairs = pairs.reshape(256, 256)
    single = (pairs > 0).sum(0) + 0.5
    single = single / single.sum()
    total, kinds = pairs.sum(1, keepdims=True), (pairs > 0).sum(1, keepdims=True)
    two = (np.maximum(pairs - DISCOUNT, 0) + DISCOUNT * kinds * single) / np.maximum(total, 1)
    return np.where(total > 0, two, single).astype(np.float32).ravel()


def found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The rows of values whose sorted keys are wanted; zero where there is none."""
    if not len(keys):
        return np.zeros((len(wanted), *values.shape[1:]), values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return np.where(hit[:, None], values[at], 0)


class Models:
    """What scoring needs, by order from 5 to 3 in tables sorted by their keys. seen[k]: counts of grams[k]; over[k], kinds[k]: totals and numbers of continuations of contexts[k]; columns toxic, ordinary."""

    def __init__(self, counts: DataFrame) -> None:
        counts = counts.persist()
        self.grams, self.seen, self.contexts, self.over, self.kinds = [], [], [], [], []
        tables, pairs = levels(counts)
        for own, context in tables:
            keys, values = self._table(own)
            self.grams.append(keys)
            self.seen.append(values)
            keys, values = self._table(context)
            self.contexts.append(keys)
            self.over.append(values[:, :2])
            self.kinds.append(values[:, 2:])
        self.shared = shared_orders(pairs)
        counts.unpersist()

    @staticmethod
    def _table(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        got = rows.toArrow()  # MOST_GRAMS rows at most
        keys = got.column(0).to_numpy()
        order = np.argsort(keys)
        return keys[order], np.stack([c.to_numpy().astype(np.float32)[order] for c in got.columns[1:]], 1)

    def gain(self, g: np.ndarray) -> np.ndarray:
        """log P(byte | four before, toxic) - log P(the same, ordinary) at each byte."""
        g, at = np.unique(g, return_inverse=True)
        p = np.repeat(self.shared[g & 0xFFFF][:, None], 2, 1)
        for k in range(3, ORDER + 1):  # from order 3 up
            j = ORDER - k
            own = g & ((1 << (8 * k)) - 1)
            over, kinds = found(self.contexts[j], self.over[j], own >> 8), found(self.contexts[j], self.kinds[j], own >> 8)
            p = np.where(over > 0, (np.maximum(found(self.grams[j], self.seen[j], own) - DISCOUNT, 0) + DISCOUNT * kinds * p) / np.maximum(over, 1), p)
        p = np.log(np.maximum(p, 1e-9))
        return (p[:, 0] - p[:, 1])[at]


class Gains:
    """What scoring one text needs: its own grams, sorted, and their gains."""

    def __init__(self, grams: np.ndarray, gains: np.ndarray) -> None:
        order = np.argsort(grams)
        self.grams, self.gains = grams[order], gains[order]

    def gain(self, g: np.ndarray) -> np.ndarray:
        return found(self.grams, self.gains[:, None], g)[:, 0]


def joined_gains(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """gram, gain of the wanted grams (gram) as Models.gain has it, by joins."""
    tables, pairs = levels(counts)
    shared = shared_orders(pairs)
    two = counts.sparkSession.createDataFrame([(k, float(p)) for k, p in enumerate(shared)], "pair long, p double")
    rows = wanted.withColumn("pair", F.col("gram").bitwiseAND(F.lit(0xFFFF))).join(F.broadcast(two), "pair")
    rows = rows.select("gram", *(F.col("p").alias(f"p_{c}") for c in CLASSES))
    for k, (own, context) in zip((3, 4, 5), reversed(tables)):
        own = own.select(F.col("gram").alias("own"), *(F.col(c).alias(f"seen_{c}") for c in CLASSES))
        context = context.select("context", *(F.col(c).alias(f"over_{c}") for c in CLASSES), *(F.col(f"{c}_kinds").alias(f"kinds_{c}") for c in CLASSES))
        rows = rows.withColumn("own", F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1))).withColumn("context", F.shiftright("own", 8))
        rows = rows.join(own, "own", "left").join(context, "context", "left")

        def p(c: str) -> Column:
            seen = F.greatest(F.coalesce(F.col(f"seen_{c}"), F.lit(0)) - DISCOUNT, F.lit(0.0))
            return F.when(F.col(f"over_{c}") > 0, (seen + DISCOUNT * F.col(f"kinds_{c}") * F.col(f"p_{c}")) / F.col(f"over_{c}")).otherwise(F.col(f"p_{c}")).alias(f"p_{c}")

        rows = rows.select("gram", *map(p, CLASSES))
    least = lambda c: F.log(F.greatest(F.col(f"p_{c}"), F.lit(1e-9)))
    return rows.select("gram", (least("toxic") - least("ordinary")).alias("gain"))


def comparisons(texts: pa.Array, models: Models | Gains) -> np.ndarray:
    """For each text: the log-likelihood ratio by byte; its highest by word; of its five highest words; the share of words above 4."""
    out = np.zeros((len(texts), 4))
    for i, j, data, at in slices(texts, 1 << 19):
        if not len(data):
            continue
        gain = np.clip(models.gain(grams(plain(data, at), at)), -6, 6)
        sums = np.concatenate(([0.0], np.cumsum(gain, dtype=np.float64)))
        size = np.diff(at)
        out[i:j, 0] = (sums[at[1:]] - sums[at[:-1]]) / np.maximum(1, size)
        starts, ends, row = word_bounds(data, at)
        if not len(starts):
            continue
        word = sums[ends] - sums[starts]
        order = np.lexsort((-word, row))
        word, row = word[order], row[order]
        n = np.bincount(row, minlength=j - i)
        begin = np.concatenate(([0], np.cumsum(n)[:-1]))
        some = n > 0
        out[i:j, 1][some] = word[begin[some]]
        nth = np.arange(len(word)) - begin[row]
        out[i:j, 2] = np.bincount(row[nth < 5], word[nth < 5], j - i) / np.maximum(1, np.minimum(n, 5))
        out[i:j, 3] = np.log1p(100 * np.bincount(row, word > 4, j - i) / np.maximum(1, n))
    return out


class Calibration:
    """Logistic regression on the comparisons, by Newton's method with a small ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.rate = float(y.mean()) if len(y) else 0.0
        self.constant = len(y) < 8 or y.min() == y.max()
        if self.constant:
            return
        self.shift, self.scale = x.mean(0), x.std(0) + 1e-6
        z = np.hstack(((x - self.shift) / self.scale, np.ones((len(x), 1))))
        self.w = np.zeros(z.shape[1])
        ridge = 0.5 * np.eye(len(self.w))
        ridge[-1, -1] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (y - p) - ridge @ self.w)
            self.w += step / max(1.0, np.abs(step).max())

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant:
            return np.full(len(x), self.rate)
        return 1 / (1 + np.exp(-np.clip((x - self.shift) / self.scale @ self.w[:-1] + self.w[-1], -30, 30)))


COMPARED = "a double, b double, c double, d double"


def compared(rows: DataFrame, counts: DataFrame, shared: Broadcast | None) -> DataFrame:
    """The first column of rows (any, text), and the four comparisons of each text: by broadcast models or, without, by joins to the counts."""
    name = rows.columns[0]
    schema = f"{name} {rows.schema[0].dataType.simpleString()}, {COMPARED}"

    def out(first: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([first, *(pa.array(x[:, k]) for k in range(4))], [name, *"abcd"])

    def by_models(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield out(b.column(0), comparisons(b.column(1), shared.value))

    def own_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(len(b)):
                for _, _, data, at in slices(b.column(2).slice(r, 1)):
                    kinds = np.unique(grams(plain(data, at), at))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kinds), b.column(k)[r].as_py())) for k in (0, 1)] + [pa.array(kinds)], ["h1", "h2", "gram"])

    def by_gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.zeros((len(b), 4))
            for r in range(len(b)):
                known = b.column(2)[r].values
                if known is not None:
                    x[r] = comparisons(b.column(1).slice(r, 1), Gains(known.field(0).to_numpy(), known.field(1).to_numpy()))[0]
            yield out(b.column(0), x)

    if shared is not None:
        return rows.mapInArrow(by_models, schema)
    keyed = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
    held = written(keyed.select("h1", "h2", "text").mapInArrow(own_grams, "h1 long, h2 long, gram long").distinct(), "text-grams")
    looked = held.join(joined_gains(held.select("gram").distinct(), counts), "gram").groupBy("h1", "h2").agg(F.collect_list(F.struct("gram", "gain")).alias("known"))
    return keyed.join(looked, ["h1", "h2"], "left").select(*rows.columns, "known").mapInArrow(by_gains, schema)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> tuple[DataFrame, Broadcast | None, Calibration]:
    """Counts, models as a broadcast value unless there are too many grams, and calibration, learnt from labels outside the held-out fold."""
    sc = docs.sparkSession.sparkContext
    learn = labels.filter((fold(F.col("doc_id"), folds) != held_out) & F.col("toxic").isNotNull())
    n = learn.count()
    part = chosen(min(MOST_LABELLED, n / CALIBRATION), n, 5)
    counts = count_grams(with_label(docs, learn.filter(~part), "toxic")).persist()
    if counts.count() <= MOST_GRAMS:
        shared = sc.broadcast(Models(counts))
    else:
        stored, shared = written(counts, "gram-counts"), None
        counts.unpersist()
        counts = stored
    rows = with_label(docs, learn.filter(part), "toxic").select("label", "text")
    got = compared(rows, counts, shared).orderBy("a", "b", "c", "d", "label").toPandas().to_numpy(float)
    return counts, shared, Calibration(got[:, 1:], got[:, 0])


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score, and the length-normalised log-likelihood ratio of every document."""
    counts, shared, calibration = fit(docs, labels, folds, held_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(k).to_numpy() for k in range(1, 5)], 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(calibration.score(x)), pa.array(x[:, 0])], ["doc_id", "score", "ratio"])

    scored = compared(docs.select("doc_id", "text"), counts, shared).mapInArrow(run, "doc_id long, score double, ratio double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", "ratio")


def op1_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return toxicity_scores(docs, labels).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
