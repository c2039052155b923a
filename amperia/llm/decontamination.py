"""Words of documents that stand in test items: windows of WINDOW consecutive words of an item, or a whole item of fewer words.

The items of a block become one suffix automaton, built in a task: its states are the classes of word sequences of the items that end in the same places. A document is read once, word by word, as a stream: the automaton's state and the length of the longest suffix that any item has go along. Where it reaches WINDOW, the words of that suffix are hit, and the state that stands for its last WINDOW words knows the items; whole short items are the marked states on the way to the root. No window of a document is ever written down or shuffled.

An automaton is broadcast; its size is bounded by WORDS_IN_BLOCK words of items. More items make more blocks, and the documents pass them one after the other, each adding what it finds. Items longer than WORDS_IN_PIECE are cut into pieces that overlap by WINDOW - 1 words, so that every window is in one of them.

Null or empty texts have no words, are never hit, and items of such hit nothing. Rows that repeat are treated alike. Items that repeat an item_id count once; one without item_id hits words, but is not counted or named. An empty benchmark hits nothing, an empty table gives an empty result. Other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import pickle
import re
import uuid
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ascii_lower, written

WINDOW = 10
WORDS_IN_BLOCK, WORDS_IN_PIECE = 1 << 19, 10_000
#: What separates words, once A-Z are in lower case, for Java and Python.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Bytes to lower case, and separators to blanks.
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())
#: Bytes of a text that are split into words at once.
CHUNK = 1 << 20


# -- the automaton ----------------------------------------------------------------------------------


class Automaton:
    """Suffix automaton of word sequences.

    State 0 is the root. Most states have one way on: token and target, in arrays; those with more have a dict in ways. link: the state of the longest suffix in another class; length: of the longest sequence of the state; whole: the nearest state, itself or along links, at which a short item ends, 0 if none; window: the state of its last WINDOW words, 0 if it has fewer.
    """

    def __init__(self, sequences: list[tuple[str | None, list[str]]], window: int = WINDOW) -> None:
        """sequences: item ids and words; those of fewer than window words count as a whole only."""
        self.size, self.words = window, {}
        ids = [[self.words.setdefault(w, len(self.words)) for w in words] for _, words in sequences]
        ways: list[dict[int, int]] = [{}]
        link, length = array("i", [-1]), array("i", [0])

        def state(ways_on: dict[int, int], link_to: int, n: int) -> int:
            ways.append(ways_on)
            link.append(link_to)
            length.append(n)
            return len(length) - 1

        def split(p: int, w: int, q: int) -> int:
            """The state of the sequences of q that p and w lead to, where q also has longer ones."""
            if length[q] == length[p] + 1:
                return q
            part = state(dict(ways[q]), link[q], length[p] + 1)
            link[q] = part
            while p >= 0 and ways[p].get(w) == q:
                ways[p][w] = part
                p = link[p]
            return part

        for words in ids:
            last = 0
            for w in words:
                if w in ways[last]:
                    last = split(last, w, ways[last][w])
                    continue
                new, p = state({}, 0, length[last] + 1), last
                while p >= 0 and w not in ways[p]:
                    ways[p][w] = new
                    p = link[p]
                if p >= 0:
                    link[new] = split(p, w, ways[p][w])
                last = new
        self.link, self.length = link, length
        self._mark(sequences, ids, ways)
        self._pack(ways)

    def _mark(self, sequences: list[tuple[str | None, list[str]]], ids: list[list[int]], ways: list[dict[int, int]]) -> None:
        n, link, length = len(self.length), self.link, self.length
        self.whole, self.window, self.items = array("i", bytes(4 * n)), array("i", bytes(4 * n)), {}
        order = sorted(range(1, n), key=length.__getitem__)
        for s in order:
            if length[s] >= self.size:
                self.window[s] = self.window[link[s]] or s
        for (item, _), words in zip(sequences, ids, strict=True):
            s = 0
            for k, w in enumerate(words, 1):
                s = ways[s][w]
                if k >= self.size:
                    self.items.setdefault(self.window[s], set()).add(item)
            if 0 < len(words) < self.size:
                self.whole[s] = s
                self.items.setdefault(s, set()).add(item)
        for s in order:
            self.whole[s] = self.whole[s] or self.whole[link[s]]

    def _pack(self, ways: list[dict[int, int]]) -> None:
        one = [next(iter(w.items())) if len(w) == 1 else (-1, 0) for w in ways]
        self.token, self.target = array("i", [t for t, _ in one]), array("i", [s for _, s in one])
        self.ways = {s: w for s, w in enumerate(ways) if len(w) > 1}

    def read(self, text: bytes | None) -> tuple[int, list[list[int]], set[str]]:
        """Number of words of a text, its hit words as disjoint spans (first, behind the last) in order, ids of the items that hit them."""
        spans: list[list[int]] = []
        found: set[int] = set()
        link, length, token, target, ways, whole, window, size = self.link, self.length, self.token, self.target, self.ways, self.whole, self.window, self.size
        n = s = long = 0
        for words in _words(text or b""):
            for n, w in enumerate(map(self.words.get, words), n + 1):  # noqa: B020
                if w is None:
                    s = long = 0
                    continue
                while True:
                    if token[s] == w:
                        s, long = target[s], long + 1
                        break
                    if s in ways and w in ways[s]:
                        s, long = ways[s][w], long + 1
                        break
                    if not s:
                        break
                    s = link[s]
                    long = length[s]
                first = n
                if long >= size:
                    first = n - long
                    found.add(window[s])
                m = whole[s]
                while m:
                    if length[m] <= long:
                        first = min(first, n - length[m])
                        found.add(m)
                    m = whole[link[m]]
                if first < n:
                    while spans and spans[-1][0] >= first:
                        spans.pop()
                    if spans and spans[-1][1] >= first:
                        spans[-1][1] = n
                    else:
                        spans.append([first, n])
        return n, spans, {item for k in found for item in self.items[k] if item is not None}


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists, each of about CHUNK bytes or one word."""
    begin = 0
    while begin < len(text):
        end = begin + CHUNK
        while end < len(text) and _PLAIN[text[end]] != 32:  # up to the end of a word
            end += 1
        yield text[begin:end].translate(_PLAIN).split()
        begin = end


# -- blocks of items --------------------------------------------------------------------------------


def pieces(benchmark: DataFrame, window: int = WINDOW, most: int = WORDS_IN_PIECE) -> DataFrame:
    """item (item_id as text) and words of all items with words, long ones in overlapping pieces."""
    split = F.split(ascii_lower(F.coalesce("text", F.lit(""))), SEPARATORS)
    words = F.filter(split, lambda w: w != "")
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), words.alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)), F.lit(most - window + 1))
    return rows.withColumn("start", F.explode(starts)).select("item", F.slice("all", F.col("start") + 1, F.lit(most)).alias("words"))


def automata(benchmark: DataFrame, window: int = WINDOW, most: int = WORDS_IN_BLOCK) -> DataFrame:
    """block and automaton (pickled), each built in a task of its own from about most words."""

    def build(t: pa.Table) -> pa.Table:
        found = Automaton(list(zip(t.column("item").to_pylist(), [[w.encode() for w in ws] for ws in t.column("words").to_pylist()], strict=True)), window)
        return pa.table({"block": t.column("block").slice(0, 1), "automaton": pa.array([pickle.dumps(found, 5)], pa.binary())})

    rows = written(pieces(benchmark, window, max(window, min(WORDS_IN_PIECE, most))), "item-pieces")
    total = rows.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    block = F.pmod(F.xxhash64("item", "words"), F.lit(max(1, -(-total // most))))
    return written(rows.withColumn("block", block).groupBy("block").applyInArrow(build, "block long, automaton binary"), "automata")


# -- documents --------------------------------------------------------------------------------------

_FOUND = "n_words long, spans array<array<long>>, items array<string>"


def _merged(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    """Union of disjoint sorted spans."""
    out: list[list[int]] = []
    for first, end in sorted(a + b):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return out


def hits(docs: DataFrame, benchmark: DataFrame, carry: list[str], window: int = WINDOW, most: int = WORDS_IN_BLOCK) -> DataFrame:
    """For every row of docs: row (a struct of the columns carry), n_words, spans of hit words (first, behind the last), items that hit them."""
    kept = automata(benchmark, window, most)
    blocks = sorted(r.block for r in kept.select("block").collect())  # one number for each block
    rows = docs.select("text", F.struct(*carry).alias("row"), F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<array<long>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    if not blocks:
        return _passed(rows, None, keep_text=False)
    for k in blocks:
        shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, kept.filter(F.col("block") == k).first().automaton))
        rows = _passed(rows, shared, keep_text=k != blocks[-1])
        if k != blocks[-1]:
            rows = written(rows, "texts-and-hits")
            shared.unpersist()
    return rows


#: The automaton that a worker has unpacked last, by its name.
_LOADED: dict[str, Automaton] = {}


def _loaded(name: str, packed: bytes) -> Automaton:
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = pickle.loads(packed)
    return _LOADED[name]


def _passed(rows: DataFrame, shared: object, keep_text: bool) -> DataFrame:
    """rows with what one automaton adds to them; without text, unless another one follows."""
    out = StructType([f for f in rows.schema.fields if keep_text or f.name != "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _loaded(*shared.value) if shared else Automaton([])
        for b in batches:
            got = [found.read(t.as_py()) for t in b.column("text").cast(pa.binary())]
            spans = [_merged(new, old) if old else new for (_, new, _), old in zip(got, b.column("spans").to_pylist(), strict=True)]
            items = [sorted(new | set(old)) for (_, _, new), old in zip(got, b.column("items").to_pylist(), strict=True)]
            kept = [b.column("text")] if keep_text else []
            yield pa.RecordBatch.from_arrays([*kept, b.column("row"), pa.array([n for n, _, _ in got], pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))], out.names)

    return rows.mapInArrow(run, out)


def without(text: str, spans: list[list[int]]) -> str:
    """text without the words of spans and what stands between them."""
    raw = text.encode()
    out, at, words, n = [], 0, _WORD.finditer(raw), 0
    for first, end in spans:
        while n < end:
            word, n = next(words), n + 1
            if n == first + 1:
                out.append(raw[at : word.start()])
        at = word.end()
    return b"".join([*out, raw[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_words: int = 0, most_coverage: float = 0.5, most: int = WORDS_IN_BLOCK) -> DataFrame:
    """docs without spans of more than most_words hit words; documents of which more than most_coverage of the words are hit go whole. n_chars is not changed."""
    found = hits(docs, benchmark, docs.columns, window, most)
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    stay = found.filter(size <= F.col("n_words") * most_coverage).select("row", F.filter("spans", lambda s: s[1] - s[0] > most_words).alias("spans"))
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = b.column("row").flatten()
            columns[at] = pa.array([without(t.as_py(), s) if s else t.as_py() for t, s in zip(columns[at], b.column("spans").to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return stay.mapInArrow(run, docs.schema)


def op13_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = hits(docs, benchmark, ["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    named = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return found.select("row.doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), named.alias("items_sha256"), (n_hit > 0).alias("contaminated"))
