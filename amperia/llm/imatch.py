"""I-Match fingerprints: the terms whose inverse document frequency lies in a band form a lexicon; a text's distinct lexicon terms, sorted, are hashed once for each of several randomised subsets of the lexicon.

Main path: DataFrame functions only. Document frequencies cover all documents. A term in the band stands in more than LEAST_SHARE of the documents, so the lexicon holds at most (mean number of distinct terms) / LEAST_SHARE terms however many documents there are; it is a constant of the plan. Subsets come in GROUPS of falling share, and go on in groups of half the share until one holds about one term of the lexicon; those in which a text has one to MOST_TERMS terms are hashed: the large ones for short texts, the small ones for long texts, so that an edit changes few of them. A text can't have more terms than the lexicon, so no text is too long for all subsets.

A text for which no subset is hashed has the hash of all its lexicon terms as fingerprint or, without any, such as a null or empty one, its own hash: likeness 1 to equal texts, 0 to others. Rows are in order of doc_id, null first, rows with the same doc_id in order of the text's hash. Other columns are not read. Without documents the result is empty.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WS, ascii_lower, let

#: The band: share of documents that hold a term, above and up to.
LEAST_SHARE, MOST_SHARE = 0.002, 0.2
#: Groups of subsets that hold 1 in so many terms of the lexicon; subsets in each group; terms of a text in a subset that is hashed, at most.
GROUPS, SUBSETS, MOST_TERMS = (4, 16, 16, 64, 64, 256, 256), 8, 3
#: The sparser groups all draw from the same 1 in so many terms of the lexicon.
DRAWN = 64
#: Hash buckets by which a term is looked up in the lexicon.
SLOTS = 1 << 13
#: Documents in a run of neighbours, about; runs at most.
RUN_ROWS, MOST_RUNS = 256, 32_768


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text: runs without white space and stops, A-Z in lower case."""
    split = F.filter(F.split(ascii_lower(text), f"[.,;:!?{WS[1:]}+"), lambda w: w != "")
    return F.transform(F.array_distinct(split), lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> list[list[int]]:
    """By slot, the hashes of the terms of docs (text) that lie in the band."""
    n = docs.count()
    df = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    band = df.filter((F.col("df") > max(1, least * n)) & (F.col("df") <= max(2, most * n)))
    slots: list[list[int]] = [[] for _ in range(SLOTS)]
    for (term,) in band.select("term").collect():  # bounded by the band, see above
        slots[term % SLOTS].append(term)
    return [sorted(s) for s in slots]


def constant(value: object, kind: str) -> Column:
    """A nested value as one constant of the plan."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def sparser(n: int) -> list[int]:
    """Shares of the groups after GROUPS for a lexicon of n terms: 1 in so many, until one is left."""
    shares = [2 * GROUPS[-1]]
    while shares[-1] < n:
        shares.append(2 * shares[-1])
    return shares


def fingerprint(text: Column, lex: Column, sparse: list[int]) -> Column:
    """One 32-bit hash for each subset of GROUPS and of the shares in sparse, null where the text has no or too many terms in it; a text without any has one hash alone."""
    known = F.sort_array(F.filter(terms(text), lambda t: F.array_contains(F.get(lex, F.pmod(t, F.lit(SLOTS)).cast("int")), t)))

    def group(k: int, share: int) -> Callable[[Column], Column]:
        lot = lambda t: F.xxhash64(F.lit(k), t)
        inside = lambda r, j: F.shiftright(r, 8 * j).bitwiseAND(F.lit(255)) < 256 // share
        drawn_by_any = lambda r: reduce(Column.__or__, (inside(r, j) for j in range(SUBSETS)))

        def subsets(drawn: Column) -> Column:
            held = lambda j: let(F.filter(drawn, lambda r: inside(r, j)), lambda x: F.when(F.size(x).between(1, MOST_TERMS), F.hash(x)))
            return F.array(*map(held, range(SUBSETS)))

        return lambda known: let(F.filter(F.transform(known, lot), drawn_by_any), subsets)

    def sparse_group(k: int, share: int) -> Callable[[Column], Column]:
        # Of the drawn terms a subset gets DRAWN in share, and none is in two of a group.
        def subsets(lots: Column) -> Column:
            held = lambda j: let(F.filter(lots, lambda r: r.bitwiseAND(F.lit(share // DRAWN - 1)) == j), lambda x: F.when(F.size(x).between(1, MOST_TERMS), F.hash(x)))
            return F.array(*map(held, range(SUBSETS)))

        return lambda drawn: let(F.transform(drawn, lambda t: F.xxhash64(F.lit(k), t)), subsets)

    def hashed(x: Column) -> Column:
        drawn = F.filter(x, lambda t: F.xxhash64(F.lit(-1), t).bitwiseAND(F.lit(DRAWN - 1)) == 0)
        after = let(drawn, lambda d: F.concat(*(sparse_group(len(GROUPS) + k, share)(d) for k, share in enumerate(sparse))))
        return F.concat(*(group(k, share)(x) for k, share in enumerate(GROUPS)), after)

    def alone(x: Column) -> Column:
        return F.array(F.when(F.size(x) > 0, F.hash(x)).otherwise(F.hash(text)))

    return let(known, lambda x: let(hashed(x), lambda fp: F.when(F.exists(fp, lambda h: h.isNotNull()), fp).otherwise(alone(x))))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal hashes among the subsets that are hashed for either text."""
    both = F.filter(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: p.x.isNotNull() | p.y.isNotNull())
    share = let(both, lambda p: F.size(F.filter(p, lambda q: q.x.eqNullSafe(q.y))) / F.greatest(F.size(p), F.lit(1)))
    return F.when(F.size(a) != F.size(b), 0.0).otherwise(share)


def shown(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.coalesce(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), F.lit("-"))), " ")


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs (doc_id, th, columns) with next_<column> of the next row by doc_id; after the last comes the first.

    The rows are cut into runs at quantiles of doc_id, which are doc_ids themselves; the first row of each run is also handed to the run before it.
    """
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    n = docs.count()
    runs = max(1, min(MOST_RUNS, n // RUN_ROWS))
    cuts = docs.select(key.alias("k")).agg(F.min("k"), F.percentile_approx("k", [k / runs for k in range(1, runs)] or [0.0], max(10_000, 20 * runs))).first()
    bounds = sorted({cuts[0], *cuts[1]}) if n else [0]
    held, steps = constant(bounds, "array<bigint>"), [1 << k for k in range(len(bounds).bit_length(), -1, -1)]
    # Binary search: the last bound that is not above the key.
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when((at + step < len(bounds)) & (F.get(held, at + step) <= F.col("k")), at + step).otherwise(at))
    rows = docs.withColumn("k", key).withColumn("run", found)
    before = F.when(F.get(held, F.col("run")) == F.col("k"), F.array(F.struct(F.pmod(F.col("run") - 1, F.lit(len(bounds))).alias("run"), F.lit(True).alias("lent")))).otherwise(F.array().cast("array<struct<run:int,lent:boolean>>"))
    rows = rows.withColumn("_at", F.explode(F.concat(F.array(F.struct("run", F.lit(False).alias("lent"))), before)))
    line = W.partitionBy("_at.run").orderBy("_at.lent", "k", "th")
    rows = rows.select("*", *(F.lead(c).over(line).alias(f"next_{c}") for c in columns))
    return rows.filter(~F.col("_at.lent")).drop("_at", "run", "k")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, the fingerprints of each text and of its edited text, the hash of the edited text, and the likenesses."""
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    slots = lexicon(slim)
    lex, sparse = constant(slots, "array<array<bigint>>"), sparser(sum(map(len, slots)))
    c = F.col
    own = slim.select("doc_id", "text", F.xxhash64("text").alias("th"), fingerprint(c("text"), lex, sparse).alias("fp"))
    rows = with_next(own, ["text", "fp"]).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(c("n_chars") / 2).cast("int")
    edited = rows.withColumn("edited", F.concat(F.left("text", c("n_chars").cast("int") - half), F.left("next_text", half)))
    printed = edited.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fp", "next_fp", fingerprint(c("edited"), lex, sparse).alias("edited_fp"))
    return printed.select("doc_id", "n_chars", "edited_sha256", shown(c("fp")).alias("fingerprint"), shown(c("edited_fp")).alias("edited_fingerprint"), likeness(c("fp"), c("edited_fp")).alias("near_edited"), likeness(c("fp"), c("next_fp")).alias("near_next"))


def op7_fingerprints(docs: DataFrame) -> DataFrame:
    return fingerprints(docs)
