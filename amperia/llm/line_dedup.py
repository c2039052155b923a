"""Lines that many documents share are kept in one of them.

A line's key is the line without white space at its ends and with A-Z in lower case. Keys travel as 128-bit hashes. Lines are range-partitioned by hash and sorted by hash, document (largest first) and position: in that order the first document of a key is the one that keeps it, and numbering documents along the run tells how many there are. No line is joined back and nothing is grouped by key. Hash ranges with many more lines than others, as a line of very many documents makes them, are split by document first; what their parts say about a run, one row each, is added up afterwards. The decisions come back as sparse bitmaps of line positions, never as text. Main path: DataFrame functions only.

A null or empty text is one empty line, which is too short to be dropped. Rows with the same doc_id are one document; a null doc_id is a document of its own, smaller than all others. Rows that repeat get the same decisions. Ties: of equal lines in the keeping document all stay. Empty tables give empty results. Other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WS_CHARS, ascii_lower, let, written

MIN_CHARS, MIN_DOCS = 20, 3
#: Hash ranges whose lines are counted; a range is split if it has so many times the mean, and so many lines at least.
RANGES, HEAVY, LEAST_HEAVY = 4096, 4, 2048


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2 (hash of the key), doc_id, th (hash of the text) and pos of every line whose key has min_chars code points."""
    # Text is hashed and split below the generator, so neither is done, nor text carried, once a line. Outer: else Spark would split once more to see that there are lines.
    split = docs.select("doc_id", F.xxhash64("text").alias("th"), _lines(F.col("text")).alias("lines"))
    rows = split.select("doc_id", "th", F.posexplode_outer("lines").alias("pos", "line"))
    rows = rows.withColumn("key", ascii_lower(F.trim(F.col("line"), F.lit(WS_CHARS)))).filter(F.length("key") >= min_chars)
    return rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "th", "pos")


def with_parts(lines: DataFrame) -> DataFrame:
    """lines with parts, in how many their hash range is split, and part, a document's."""
    place = F.pmod("h1", F.lit(RANGES))
    loads = lines.groupBy(place.alias("place")).agg(F.count("*").alias("n"))
    loads = loads.withColumn("heavy", F.greatest(F.lit(LEAST_HEAVY), HEAVY * F.avg("n").over(W.partitionBy())))  # RANGES rows at most
    splits = loads.filter("n > heavy").select("place", F.ceil(2 * F.col("n") / F.col("heavy")).cast("int").alias("parts"))
    rows = lines.withColumn("place", place).join(F.broadcast(splits), "place", "left")
    parts = F.coalesce("parts", F.lit(1))
    return rows.withColumns({"parts": parts, "part": F.pmod(F.xxhash64("doc_id"), parts).cast("int")}).drop("place")


def streamed(rows: DataFrame) -> DataFrame:
    """rows, in sorted range partitions, with what stands along their run (of a key, in one part): line, the how manieth line it is, keeper, the first document, n_docs, the number of documents."""
    run = W.partitionBy("h1", "h2", "part")
    by_doc = F.col("doc_id").desc_nulls_last()
    along, docs_along = run.orderBy(by_doc, "pos"), run.orderBy(by_doc)
    # The range partitioning serves the windows, and one sort all of them.
    ranged = rows.repartitionByRange("h1", "h2", "part")
    seen = ranged.withColumns({"line": F.row_number().over(along), "keeper": F.first("doc_id").over(along)})
    return seen.withColumn("nth", F.dense_rank().over(docs_along)).withColumn("n_docs", F.max("nth").over(run)).drop("nth")


def lost_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, th, pos of the lines that go."""
    seen, c = streamed(with_parts(written(line_keys(docs, min_chars), "line-keys"))), F.col
    goes = lambda n, keeper: (n >= min_docs) & ~c("doc_id").eqNullSafe(keeper)
    found = written(seen.filter((c("parts") > 1) | goes(c("n_docs"), c("keeper"))), "line-runs")
    whole, split = found.filter("parts = 1"), found.filter("parts > 1")
    key = W.partitionBy("h1", "h2")
    # One row for each run and part: as many for a key as its range has parts.
    runs = split.filter("line = 1").select("h1", "h2", "part", F.sum("n_docs").over(key).alias("of_all"), F.max("keeper").over(key).alias("last"))
    settled = split.join(runs, ["h1", "h2", "part"]).filter(goes(c("of_all"), c("last")))
    return whole.select("doc_id", "th", "pos").union(settled.select("doc_id", "th", "pos"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, th, n_dropped and keep of the documents that lose lines. keep: array of (word, bits), bit i of word w for line 64 * w + i, 1 if it stays; words that are absent are all ones."""
    lost = lost_lines(docs, min_chars, min_docs)
    bits = lost.groupBy("doc_id", "th", F.expr("pos div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("gone"))
    packed = F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits"))))
    return bits.groupBy("doc_id", "th").agg(F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"), packed.alias("keep"))


def kept_lines(text: Column, keep: Column) -> Column:
    """The lines that a bitmap keeps, joined again."""

    def staying(dense: Column) -> Column:
        return F.filter(_lines(text), lambda _, i: F.getbit(dense[F.floor(i / 64).cast("int")], i % 64) == 1)

    last = F.floor((F.size(_lines(text)) - 1) / 64).cast("int")
    dense = F.transform(F.sequence(F.lit(0), last), lambda k: F.coalesce(F.get(F.filter(keep, lambda w: w.word == k), 0).bits, F.lit(-1).cast("long")))
    return F.array_join(let(dense, staying), "\n")


def drop_lines(docs: DataFrame, bitmaps: DataFrame, counts: bool = True) -> DataFrame:
    """docs with the bitmaps applied to text; n_lines and n_dropped are added, or put in the place of columns of these names, if counts."""
    rows = docs.select(F.col("doc_id"), F.xxhash64("text").alias("th"), F.col("text"), F.struct(*docs.columns).alias("row"))  # columns of any name
    b = bitmaps.select(F.struct("doc_id", "th").alias("of"), "n_dropped", "keep")
    joined = rows.join(b, F.col("doc_id").eqNullSafe(F.col("of.doc_id")) & (F.col("th") == F.col("of.th")), "left")
    kept = F.when(F.col("keep").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept_lines(F.col("text"), F.col("keep")))
    own = {c: F.col("row").getField(c) for c in docs.columns} | {"text": kept}
    added = {"n_lines": F.size(_lines(F.col("text"))).cast("long"), "n_dropped": F.coalesce("n_dropped", F.lit(0).cast("long"))} if counts else {}
    return joined.select(*(v.alias(k) for k, v in (own | added).items()))


def op5_line_dedup(docs: DataFrame) -> DataFrame:
    slim = docs.select("doc_id", "text")
    return drop_lines(slim, keep_bitmaps(slim)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
