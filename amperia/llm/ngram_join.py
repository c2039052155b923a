"""N-gram Jaccard join by parity sketches: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more, and their connected components. No link is lost.

1. Equal sets are collapsed by a 128-bit signature; one document of each class goes on.
2. A set's shingles fall into the parts of a sketch; each part keeps the parity of its bits (as the XOR of the shingles' codes). A shingle that only one of two sets has changes one part of one of them, so the number of parts in which two sketches differ is a lower bound of the symmetric difference. At similarity 0.8 that is at most (a + b) / 9 for sets of a and b shingles. Pigeonhole: of each sketch the (a + b) / 9 + 1 fullest occupied parts are joined with those of the sketches of its size band and the next. A sketch with too few occupied parts for this is sketched again with other hashes, as any partner that it could miss is too.
3. Sketches that share a part are candidates. Each is first paired with the smallest document of a part that it shares most parts with; then, wherever documents in one part are still in different components, with the nearest of those by bit sketch, and then with all that are still in different components. A pair is dropped if the Hamming distance of the whole bit sketches exceeds (a + b) / 9, else the sets are compared. Documents that share a part with many others, yet are similar to few, are compared by bit sketches in blocks: this step's work grows with the square of such a group, its results do not.

Words are runs without white space, A-Z in lower case; with fewer than five words the whole sequence is one shingle. Null or empty texts have no shingles and no links. A row without doc_id is linked with nothing and has no component. Rows that repeat are equal sets. A doc_id stands for one text: of a doc_id with several different texts, links of only one of them may be found. Ties: of equal sets the smallest doc_id stands for all. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components, merged
from .flat import LOWER, mix, slices, word_bounds, word_hashes

N = 5
#: A band's sizes grow by this factor; shingles in a part at the band's upper end; parts at least; tries with other hashes.
BAND_GROWTH, PART_LOAD, LEAST_PARTS, TRIES = 1.6, 2.7, 16, 6
#: Rows of one id that may be broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Documents of one token that are compared with one another in one place, about.
BLOCK = 512
#: Pairs of a document that are compared first, in each such place, round by round.
NEAREST = (2, 2)
U = np.uint64


def bands(most: int) -> np.ndarray:
    """The lower ends of the size bands up to most, and one more."""
    ends = [1]
    while ends[-1] <= most:
        ends.append(max(ends[-1] + 1, int(np.ceil(ends[-1] * BAND_GROWTH))))
    return np.array([*ends, max(ends[-1] + 1, int(np.ceil(ends[-1] * BAND_GROWTH)))])


BANDS = bands(1 << 40)


def shingle_sets(texts: pa.Array, n: int = N) -> Iterator[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles."""
    for i, j, data, at in slices(texts):
        low = LOWER[data]
        starts, ends, row = word_bounds(low, at)
        h = word_hashes(low, starts, ends)
        count = np.bincount(row, minlength=j - i)
        first = np.concatenate(([0], np.cumsum(count)))
        g = np.zeros(len(h), U)
        for k in range(min(n, len(h))):
            m = len(h) - k
            g[:m] += mix(h[k:] + U(k + 1))  # words of the next text may get in here: those windows are not read
        g = mix(g)
        for r in range(j - i):
            a, b = first[r], first[r + 1]
            if b - a >= n:
                yield np.unique(g[a : b - n + 1])
            elif b > a:
                yield mix(sum((mix(h[a + k : a + k + 1] + U(k + 1)) for k in range(b - a)), np.zeros(1, U)) + U(b - a))
            else:
                yield np.zeros(0, U)


def bit_sketch(s: np.ndarray) -> bytes:
    """Parity bits: shingle h toggles bit h mod m, where m, a power of two, is about twice the size."""
    m = 1 << max(6, int(2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((mix(s ^ U(0xA5A5)) & U(m - 1)).astype(np.int64), minlength=m).astype(np.uint8) & 1, bitorder="little").tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Distance of two bit sketches; the longer is folded to the length of the shorter."""
    x, y = (np.frombuffer(s, np.uint8) for s in (a, b))
    m = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(s.reshape(-1, m), axis=0) for s in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def part_tokens(s: np.ndarray) -> np.ndarray:
    """The keys under which a set looks for partners."""
    n, out = len(s), []
    k = int(np.searchsorted(BANDS, n, "right")) - 1
    largest = n * 5 // 4
    for band, partner in ((k, min(largest, int(BANDS[k + 1]) - 1)), (k + 1, largest)):
        if partner < BANDS[band]:
            continue
        differing = (n + partner) // 9
        parts = max(LEAST_PARTS, int(np.ceil(BANDS[band + 1] / PART_LOAD)))
        for seed in range(TRIES):
            where = (mix(s + U(2 * seed + 1)) % U(parts)).astype(np.int64)
            order = np.argsort(where)
            where = where[order]
            cut = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
            value = np.bitwise_xor.reduceat(mix(s[order] ^ U(0xC0FFEE + seed)), cut)
            load = np.diff(np.concatenate((cut, [n])))
            token = mix(value ^ mix(where[cut].astype(U) + U(((band * TRIES) + seed) << 40)))
            best = np.lexsort((value, -load))[: differing + 1]
            out.append(token[best])
            if len(cut) > differing:
                break
        else:
            out.append(mix(np.array([band], U) + U(0xFA11)))  # all of these meet
    return np.concatenate(out)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, the set's 128-bit signature and its bit sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, s1, s2, sketch = [], [], [], []
            for s in shingle_sets(b.column(1)):
                n.append(len(s))
                s1.append(int(np.add.reduce(mix(s)).astype(np.int64)) if len(s) else 0)
                s2.append(int(np.add.reduce(mix(s ^ U(0x5EED))).astype(np.int64)) if len(s) else 0)
                sketch.append(bit_sketch(s) if len(s) else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sketch, pa.binary())], ["doc_id", "n_shingles", "s1", "s2", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, sketch binary")


def tokens(docs: DataFrame) -> DataFrame:
    """token and doc_id for every part that a document joins by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, found = b.column(0).to_numpy(), []
            size = []
            for s in shingle_sets(b.column(1)):
                found.append(part_tokens(s) if len(s) else s)
                size.append(len(found[-1]))
            if sum(size):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).astype(np.int64)), pa.array(np.repeat(ids, size))], ["token", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, "token long, doc_id long")


def runs_of_tokens(rows: DataFrame) -> DataFrame:
    """token, leader and doc_id for every document that shares a token with a smaller one of its partition; leader: the smallest there. A partition's first and last token also give the row of the leader itself. Rows are range-partitioned by token and document, so that a token of very many documents is spread over partitions; each is read as a sorted stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, leader, turned = None, 0, False
        for b in batches:
            token, doc = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(token):
                continue
            new = np.concatenate(([last is None or token[0] != last], token[1:] != token[:-1]))
            start = np.maximum.accumulate(np.where(new, np.arange(len(token)), -1))
            lead = np.where(start < 0, leader, doc[np.maximum(start, 0)])
            keep = lead != doc
            keep[0] |= last is None
            turned |= bool(new[1:].any() or (last is not None and new[0]))
            last, leader = token[-1], int(lead[-1])
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(lead[keep]), pa.array(doc[keep])], ["token", "leader", "doc_id"])
        if turned:
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (last, leader, leader)], ["token", "leader", "doc_id"])

    dealt = rows.repartitionByRange("token", "doc_id").sortWithinPartitions("token", "doc_id")
    return dealt.mapInArrow(run, "token long, leader long, doc_id long")


def meetings(rows: DataFrame) -> DataFrame:
    """token, leader and doc_id for every document that shares a token with a smaller one; leader: the smallest. Leaders of tokens that go on over partitions are taken from the rows at the edges, which are broadcast: two a partition at most."""
    met = written(runs_of_tokens(written(rows, "tokens")), "meetings")
    edges = met.filter("leader = doc_id").groupBy("token").agg(F.min("leader").alias("smallest"))
    return met.join(F.broadcast(edges), "token", "left").select("token", F.coalesce("smallest", "leader").alias("leader"), "doc_id").filter("leader <> doc_id")


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def links(docs: DataFrame, sketches: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar: by size and bit sketch first, then by the sets."""
    near = "(na + nb) div 9"

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = b.column(2).to_pylist()
            keep = [hamming(x.as_py(), y.as_py()) <= d for x, y, d in zip(b.column(3), b.column(4), most)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    s = sketches.select("doc_id", "n_shingles", "sketch")
    sided = pairs.join(s.toDF("a", "na", "sa"), "a").join(s.toDF("b", "nb", "sb"), "b").filter("5 * na >= 4 * nb and 5 * nb >= 4 * na")
    likely = written(sided.select("a", "b", F.expr(near).alias("most"), "sa", "sb").mapInArrow(close, "a long, b long"), "likely-pairs")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in shingle_sets(b.column(1))], pa.binary())], ["doc_id", "s"])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), U) for v in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= 80 * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ids = likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).distinct()
    held = written(docs.select("doc_id", "text").join(_small(ids), "doc_id", "left_semi").mapInArrow(sets, "doc_id long, s binary"), "shingle-sets")
    full = likely.join(held.toDF("a", "sa"), "a").join(held.toDF("b", "sb"), "b")
    return written(full.select("a", "b", "sa", "sb").mapInArrow(similar, "a long, b long"), "links")


def close_pairs(unit: list[tuple], nearest: int | None = None) -> list[tuple[int, int]]:
    """Of a unit's documents (doc_id, comp, block, n_shingles, sketch) those pairs of different components and, if there are two blocks, of different blocks, that sizes and bit sketches do not rule out; of each document's only the nearest, if so many are given."""
    out = []
    by_length: dict[int, list[tuple]] = {}
    for r in unit:
        by_length.setdefault(len(r[4]), []).append(r)
    groups = []
    for rows in by_length.values():
        ids, comp, block, n = (np.array([r[k] for r in rows]) for k in range(4))
        groups.append((ids, comp, block, n, np.frombuffer(b"".join(r[4] for r in rows), U).reshape(len(rows), -1)))
    crossed = len({r[2] for r in unit}) > 1
    for g, (ids, comp, block, n, sketch) in enumerate(groups):
        for ids2, comp2, block2, n2, sketch2 in groups[g:]:
            w = min(sketch.shape[1], sketch2.shape[1])
            x, y = (np.bitwise_xor.reduce(v.reshape(len(v), -1, w), axis=1) for v in (sketch, sketch2))
            for k in range(len(ids)):
                fit = (comp2 != comp[k]) & (5 * n2 >= 4 * n[k]) & (4 * n2 <= 5 * n[k])
                if crossed:
                    fit &= block2 != block[k]
                if ids2 is ids:
                    fit[: k + 1] = False
                at = np.flatnonzero(fit)
                if len(at):
                    apart = np.bitwise_count(y[at] ^ x[k]).sum(1)
                    close = apart <= (n2[at] + n[k]) // 9
                    at, apart = at[close], apart[close]
                    if nearest is not None and len(at) > nearest:
                        at = at[np.argpartition(apart, nearest - 1)[:nearest]]
                    out += [(int(ids[k]), int(ids2[i])) for i in at]
    return out


def units(members: DataFrame, comps: DataFrame) -> DataFrame:
    """token, doc_id, comp and n, the token's number of documents, for the tokens whose documents are in different components. Of tokens that the same documents share (by number and a 128-bit signature of them) one stays: near copies share hundreds."""
    own = members.join(comps, members.doc_id == comps.node, "left").select("token", "doc_id", F.coalesce("comp", "doc_id").alias("comp"))
    signature = [F.expr("bit_xor(xxhash64(doc_id))").alias("e1"), F.expr("bit_xor(xxhash64(1, doc_id))").alias("e2")]
    apart = own.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n"), *signature).filter("x <> y")
    kept = apart.groupBy("n", "e1", "e2").agg(F.min("token").alias("token")).select("token", "n")
    return written(own.join(kept, "token"), "units")


def still_apart(members: DataFrame, sketches: DataFrame, nearest: int | None = None) -> DataFrame:
    """a, b: the pairs of documents that share a token, are in different components and that bit sketches do not rule out. members: token, doc_id, comp, n.

    A token's documents are dealt to blocks of about BLOCK; each pair of blocks is a unit, compared in one place, of which only what is left comes out: no task meets more than two blocks of a token.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, unit, found = None, [], []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:3] != key:
                    found += close_pairs(unit, nearest) if len(unit) > 1 else []
                    key, unit = row[:3], []
                unit.append(row[3:])
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])
            found = []
        found = close_pairs(unit, nearest) if len(unit) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = members.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("doc_id"), blocks).cast("int")})
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(sketches.select("doc_id", "n_shingles", "sketch"), "doc_id")
    unit = rows.select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc_id", "comp", "block", "n_shingles", "sketch")
    return unit.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(run, "a long, b long").distinct()


def ngram_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    docs = docs.select("doc_id", "text")
    signed = written(signatures(docs), "signatures")
    sets = ["s1", "s2", "n_shingles"]
    classes = signed.filter("n_shingles > 0 and doc_id is not null").groupBy(*sets).agg(F.min("doc_id").alias("rep"))
    named = written(signed.drop("sketch").join(classes, sets, "left"), "classes")
    copies = named.filter("doc_id <> rep or rep is null or doc_id is null").select("doc_id").distinct()
    single = docs.filter("doc_id is not null").join(_small(copies), "doc_id", "left_anti")
    met = meetings(tokens(single))

    # First each document with one leader, then what is still apart though it shares a part.
    first = met.groupBy("doc_id", "leader").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.max_by("leader", F.struct("n", -F.col("leader"))).alias("a"))
    found = links(docs, signed, first.select("a", F.col("doc_id").alias("b")))
    comps = written(components(found), "components")
    members = met.select("token", "doc_id").union(met.select("token", "leader").distinct()).toDF("token", "doc_id")
    # Nearest pairs at least halve the components of a group of near copies each time, with work in proportion to it; all pairs that are left then follow.
    for nearest in (*NEAREST, None):
        rest = units(members, comps)
        more = links(docs, signed, still_apart(rest, signed, nearest))
        comps = written(merged(comps, more), "components")
        members = rest.select("token", "doc_id")  # tokens of one component stay so
    out = named.join(comps, named.rep == comps.node, "left")
    # A row without doc_id may have the set of a class of others, but is in no component.
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "rep", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without those of documents that have a similar one with a smaller doc_id in their component. Rows without doc_id stay."""
    gone = ngram_join(docs).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(_small(written(gone, "near-duplicates")), "doc_id", "left_anti").select(*docs.columns)


def op2_ngram_join(docs: DataFrame) -> DataFrame:
    return ngram_join(docs)
