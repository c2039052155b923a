"""Licence scans: a trained paragraph classifier. Every paragraph (lines up to a blank one), and every line in it, is scored by multinomial logistic regression over hashed word uni- and bigrams, with a class for each licence family and one for unknown; a temperature set on held-out examples calibrates the probabilities. A prediction counts only if comparison with the family's templates confirms it. A paragraph of which, without lines of other words at its ends, most word pairs are the template's is reported in one, as a notice that is wrapped; of others, such as prose around a notice, the lines that are confirmed alone.

Training examples are the templates, shortened, joined and reworded at random with a fixed seed, against sentences of similar words and lines of the documents that no template resembles: whole lines at any position, of MOST_DOCS documents at most, in order of a hash until there are MOST_LINES of them or MOST_CHARS characters. Training runs on the driver on this bounded set, once for each call; scanning is one pass over all documents.

A null, empty or blank text has no paragraphs. Positions count code points, end exclusive, without white space at a paragraph's end. Ties between families go to the first by name. Rows that repeat are scanned each; a null doc_id stays. A very long text is scanned whole. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS
from .flat import IS_SPACE, LOWER, mix, slices, word_bounds, word_hashes
from .labelled import chosen, fitting
from .license_texts import NOT_LICENSES, TEMPLATES

FAMILIES = (*sorted(TEMPLATES), "unknown")
UNKNOWN = len(FAMILIES) - 1
#: Hash buckets of n-grams; examples of each family and of unknown from templates; passes over all examples; lines, characters of them and documents sampled at most.
BUCKETS, EXAMPLES, EPOCHS, MOST_LINES, MOST_CHARS, MOST_DOCS = 1 << 18, 150, 80, 4_000, 2_000_000, 2_000
#: A prediction needs this probability, and this share of the paragraph's or of one template's word pairs in common.
AT_LEAST, CONFIRMED, RESEMBLES, TRIMMED = 0.6, 0.5, 0.3, 0.6
#: Letters and digits in lower case, other signs a space, the line feed itself.
SIGNS = np.where(np.array([chr(b).isalnum() or b >= 128 for b in range(256)]), LOWER, 32).astype(np.uint8)
SIGNS[10] = 10


def lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where lines begin, with the end of all at last, and the row each is in."""
    begins = np.union1d(at[:-1][np.diff(at) > 0], np.flatnonzero(data[:-1] == 10) + 1 if len(data) else []).astype(np.int64)
    return np.append(begins, len(data)), np.searchsorted(at, begins, "right") - 1


def paragraphs(data: np.ndarray, cuts: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lines, which of them begin a paragraph, and the paragraph that each is in (-1 before the first)."""
    full = np.add.reduceat((~IS_SPACE[data]).astype(np.int64), cuts[:-1]) > 0 if len(data) else np.zeros(0, bool)
    before = np.concatenate(([False], full[:-1] & (row[1:] == row[:-1]))) if len(full) else full
    begin = full & ~before
    return np.flatnonzero(begin), np.cumsum(begin) - 1


def features(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all uni- and bigrams, and the paragraph each is in, in order of paragraphs."""
    starts, ends, row = word_bounds(data, cuts)
    h = word_hashes(data, starts, ends)
    two = mix(h[:-1] * np.uint64(3) ^ h[1:])
    same = row[1:] == row[:-1]
    bucket = np.concatenate((h, two[same])) % np.uint64(BUCKETS)
    where = np.concatenate((row, row[:-1][same]))
    order = np.argsort(where, kind="stable")
    return bucket[order].astype(np.int64), where[order]


def summed(w: np.ndarray, bucket: np.ndarray, where: np.ndarray, n: int) -> np.ndarray:
    """For each of n paragraphs the sum of its features' weights, divided by the root of their number."""
    out = np.zeros((n, w.shape[1]), np.float32)
    if len(where):
        cut = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
        size = np.diff(np.append(cut, len(where)))
        out[where[cut]] = np.add.reduceat(w[bucket], cut, axis=0) / np.sqrt(size)[:, None]
    return out


def plain_words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def pairs(text: str) -> set[tuple[str, str]]:
    w = plain_words(text)
    return set(zip(w, w[1:]))


PAIRS = {f: [pairs(t) for t in ts] for f, ts in TEMPLATES.items()}


def resemblance(text: str, family: str, own: bool = False) -> float:
    """The largest share of word pairs in common with one template, of the paragraph (own) or, if that is more, of the template."""
    p = pairs(text)
    return max((len(p & t) / max(1, len(p) if own else min(len(p), len(t))) for t in PAIRS[family]), default=0.0) if len(p) > 1 else 0.0


WORDS = {f: {w for t in ts for w in plain_words(t)} for f, ts in TEMPLATES.items()}


def trimmed(text: str, family: str) -> tuple[int, str]:
    """A paragraph without the lines at its ends of which less than TRIMMED of the words are in the family's templates: how many characters go at its beginning, and the rest."""
    parts = text.split("\n")
    own = [k for k, w in enumerate(map(plain_words, parts)) if w and sum(x in WORDS[family] for x in w) >= TRIMMED * len(w)]
    if not own:
        return 0, text
    return sum(len(x) + 1 for x in parts[: own[0]]), "\n".join(parts[own[0] : own[-1] + 1]).rstrip(WS_CHARS)


def resembles_any(text: str) -> bool:
    p = pairs(text)
    return len(p) > 1 and any(len(p & t) >= RESEMBLES * max(1, min(len(p), len(t))) for ts in PAIRS.values() for t in ts)


class Classifier:
    def __init__(self, texts: list[str], labels: list[int]) -> None:
        r = np.random.default_rng(5)
        data = SIGNS[np.frombuffer("\n".join(t.replace("\n", " ") for t in texts).encode(), np.uint8)]
        cuts, _ = lines(data, np.array([0, len(data)]))
        bucket, where = features(data, cuts)
        n, k = len(texts), len(FAMILIES)
        size = np.maximum(1, np.bincount(where, minlength=n))
        y = np.eye(k, dtype=np.float32)[labels]
        hold = r.random(n) < 0.2
        value = (1 / np.sqrt(size)).astype(np.float32)[where]
        used = np.unique(bucket)
        small = np.searchsorted(used, bucket)
        w, square, bias = np.zeros((len(used), k), np.float32), np.full((len(used), k), 1e-6, np.float32), np.zeros(k, np.float32)
        weight = np.where(hold, 0, 1 / np.maximum(1, np.bincount(labels, ~hold, k))[labels]).astype(np.float32)
        order = np.argsort(small, kind="stable")
        cut = np.flatnonzero(np.concatenate(([True], np.diff(small[order]) > 0)))
        from_, times = where[order], value[order][:, None]
        for _ in range(EPOCHS):  # AdaGrad on all examples
            p = self._soft(self._sums(w, small, where, value, n) + bias)
            d = (p - y) * weight[:, None]
            g = np.add.reduceat(d[from_] * times, cut, axis=0) + 1e-6 * w
            square += g * g
            w -= 0.5 * g / np.sqrt(square)
            bias -= 0.05 * d.sum(0)
        z = (self._sums(w, small, where, value, n) + bias)[hold]
        truth = np.array(labels)[hold]
        loss = {t: -np.mean(np.log(np.maximum(1e-12, self._soft(z / t)[np.arange(len(z)), truth]))) for t in np.geomspace(0.3, 10, 40)}
        self.temperature = min(loss, key=loss.get)
        self.held_out_accuracy = float((z.argmax(1) == truth).mean())
        self.w = np.zeros((BUCKETS, k), np.float32)
        self.w[used], self.bias = w, bias

    @staticmethod
    def _sums(w: np.ndarray, bucket: np.ndarray, where: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, w.shape[1]), w.dtype)
        cut = np.flatnonzero(np.concatenate(([True], np.diff(where) > 0)))
        out[where[cut]] = np.add.reduceat(w[bucket] * value[:, None], cut, axis=0)
        return out

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def probabilities(self, data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """By paragraph of signs (see SIGNS)."""
        return self._soft((summed(self.w, *features(data, cuts), len(cuts) - 1) + self.bias) / self.temperature)


def examples() -> tuple[list[str], list[int]]:
    """Templates as they may stand in a text: cut short, with other words around, in capitals."""
    r = np.random.default_rng(3)
    texts, labels = [], []
    for k, f in enumerate(FAMILIES):
        source = TEMPLATES.get(f, NOT_LICENSES)
        for n in range(EXAMPLES):
            w = source[n % len(source)].split()
            if n >= len(source):
                if len(w) > 14 and r.random() < 0.6:
                    at = r.integers(0, len(w) - 12)
                    w = w[at : at + int(r.integers(12, len(w) - at + 1))]
                w = [x for x in w if len(w) < 7 or r.random() > 0.05]
                if r.random() < 0.3:
                    w = [*r.choice(["Copyright", "2019", "2021", "(c)", "The", "Authors.", "Note:", "*", "#"], 2), *w]
            t = " ".join(w)
            texts.append(t.upper() if r.random() < 0.1 else t)
            labels.append(k)
    return texts, labels


def sampled_lines(docs: DataFrame) -> list[str]:
    """Whole lines at any position, in order of a hash, as many as the bounds allow; a line too long for what is left of them is passed over."""
    sample = docs.select("doc_id", "text").filter(chosen(MOST_DOCS, docs.count(), 4))
    rows = sample.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select(F.xxhash64("doc_id", "pos", "line").alias("turn"), "line")
    rows = rows.filter(F.length(F.trim("line", F.lit(WS_CHARS))) > 0)
    first = rows.select("turn", F.length("line").alias("n")).filter(F.col("n") <= MOST_CHARS).orderBy("turn", "n").limit(MOST_LINES).collect()
    turns = fitting([(r.turn, r.n) for r in first], MOST_CHARS)
    if not turns:
        return []
    taken = F.broadcast(docs.sparkSession.createDataFrame([(t,) for t in sorted(set(turns))], "turn long"))  # MOST_LINES rows
    return [r[0] for r in rows.join(taken, "turn").filter(F.length("line") <= MOST_CHARS).orderBy("turn", "line").limit(len(turns)).select("line").collect()]


def fit(docs: DataFrame) -> Classifier:
    texts, labels = examples()
    plain = [t for t in sampled_lines(docs) if not resembles_any(t)]
    return Classifier(texts + plain, labels + [UNKNOWN] * len(plain))


def scanned(classifier: Classifier, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[tuple[int, str, int, int, float]]]:
    """How many paragraphs each row has; and (row, family, start, end, probability) of the licences found, in order."""
    cuts, row = lines(data, at)
    begin, of = paragraphs(data, cuts, row)
    out: list[tuple[int, str, int, int, float]] = []
    if not len(begin):
        return np.zeros(len(at) - 1, np.int64), out
    signs = SIGNS[data]

    def likely(p: np.ndarray) -> np.ndarray:
        return np.flatnonzero((p.argmax(1) != UNKNOWN) & (p.max(1) >= AT_LEAST))

    def note(r: int, a: int, lead: int, text: str, p: np.ndarray) -> None:
        start = len(data[at[r] : a].tobytes().decode()) + lead
        out.append((r, FAMILIES[p.argmax()], start, start + len(text), float(p.max())))

    ends = np.append(cuts[begin[1:]], len(data))
    p = classifier.probabilities(signs, np.append(cuts[begin], len(data)))
    whole = set()
    for k in likely(p):
        r, a = int(row[begin[k]]), int(cuts[begin[k]])
        text = data[a : min(int(ends[k]), int(at[r + 1]))].tobytes().decode().rstrip(WS_CHARS)
        lead, text = trimmed(text, FAMILIES[p[k].argmax()])
        if resemblance(text, FAMILIES[p[k].argmax()], own=True) >= CONFIRMED:
            whole.add(int(k))
            note(r, a, lead, text, p[k])
    p = classifier.probabilities(signs, cuts)
    for k in likely(p):
        if int(of[k]) not in whole:
            a = int(cuts[k])
            text = data[a : int(cuts[k + 1])].tobytes().decode().rstrip(WS_CHARS)
            if resemblance(text, FAMILIES[p[k].argmax()]) >= CONFIRMED:
                note(int(row[k]), a, 0, text, p[k])
    return np.bincount(row[begin], minlength=len(at) - 1), sorted(out, key=lambda x: (x[0], x[2]))


def license_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs and licenses: array of (family, start, end, probability) of the paragraphs and lines that state one."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))
    kind = pa.list_(pa.struct([("family", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[list[dict]] = [[] for _ in range(len(b))]
            count = np.zeros(len(b), np.int64)
            for i, j, data, at in slices(b.column(1)):
                count[i:j], got = scanned(shared.value, data, at)
                for r, family, start, end, p in got:
                    found[i + r].append({"family": family, "start": start, "end": end, "probability": p})
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count), pa.array(found, kind)], ["doc_id", "n_paragraphs", "licenses"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_paragraphs long, licenses array<struct<family:string,start:int,end:int,probability:double>>")


def op10_licenses(docs: DataFrame) -> DataFrame:
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x.family))), ",")
    spans = F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x.family, x.start, x.end)), ",")
    return license_spans(docs).select("doc_id", "n_paragraphs", F.size("licenses").cast("long").alias("n_licenses"), families.alias("families"), spans.alias("spans"))
