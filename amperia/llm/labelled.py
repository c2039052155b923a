"""Joining labels to documents, and the folds that models learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Label rows that may be broadcast (24 bytes each, about); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of doc_id as text, modulo k."""
    return F.crc32(doc_id.cast("string")) % k


def with_label(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """doc_id, text, label of the labelled documents. Null labels and doc_ids drop out; of several labels of a doc_id the largest counts."""
    own = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    if labels.count() <= BROADCAST_ROWS:
        own = F.broadcast(own)
    return docs.select("doc_id", "text").join(own, "doc_id")


def chosen(most: float, n: int, seed: int) -> Column:
    """Whether a row is one of about most of n, the same ones in every run: by a hash of doc_id. A share of 2 ** 62 is fine enough for any n."""
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 62)) < int(min(1.0, most / max(1, n)) * (1 << 62))


def fitting(sizes: list[tuple[int, int]], most: int) -> list[int]:
    """Of (turn, size) in order of turn, the turns of all that fit into most together; one that does not is passed over."""
    out, room = [], most
    for turn, size in sorted(sizes):
        if size <= room:
            out.append(turn)
            room -= size
    return out


def bounded(rows: DataFrame, most: int, n: int, seed: int) -> DataFrame:
    """About most of the n rows at most, the same ones in every run."""
    return rows if most >= n else rows.filter(chosen(most, n, seed))
