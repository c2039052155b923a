"""Mixing sources to target weights by Sainte-Lague apportionment.

The mix is cut into blocks of equal word counts. Blocks go to sources, and within a source to its shards, one by one to the highest quotient target / (2 s + 1). Each shard then fills its quota from its documents in a seeded order: whole rounds through the shard first, then blocks from the start of one more round; the last block may end inside a document. Main path: DataFrame functions only.

A shard is a set of hash buckets, so a source with a third of all rows is spread over up to BUCKETS tasks. What is gathered is one row for each source and bucket, never documents.

A null text has no words and is taken zero times; null is a source like any other, last in order. Rows that repeat are documents each. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WS, written

#: Weights by source in code point order, repeating; epochs: a document is taken so many times at most.
WEIGHTS, MAX_EPOCHS = (5, 2, 1), 3
#: Words of a block and of a shard, about; hash buckets of a source, a power of two.
BLOCK_WORDS, SHARD_WORDS, BUCKETS = 32, 10_000, 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WS[1:]}+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sources (source, source_size) with target: shares of the total by weight, none above max_epochs times its source's size, the rest reshared by weight. One row a source goes through one task."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    named = sources.withColumn("nth", F.row_number().over(order) - 1)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    named = named.withColumn("w", w).withColumn("cap", max_epochs * F.col("source_size"))
    # Sources meet their caps in the order of cap / w; those before have met theirs.
    before = W.orderBy((F.col("cap") / F.col("w")).asc(), "nth").rowsBetween(W.unboundedPreceding, -1)
    left = named.withColumns({
        "rest": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "rest_w": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)),
    }).withColumn("full", F.col("cap") * F.col("rest_w").cast("double") <= F.col("rest") * F.col("w").cast("double"))
    open_rest = F.sum("source_size").over(everything) - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything)
    open_w = F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(everything)
    share = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(open_rest * F.col("w") / F.greatest(open_w, F.lit(1)))
    return left.withColumn("target", share).select("source", "source_size", "nth", "target")


def sainte_lague(rows: DataFrame, group: list[str], order: list[str], votes: str, seats: str, out: str) -> DataFrame:
    """rows with out: how many of its group's seats each gets by highest quotients votes / (2 s + 1), ties to the first in order.

    All seats that any outcome gives are given at once; the rest, one for each row at most, go by the quotients of the seats next in turn.
    """
    g = W.partitionBy(*group)
    n, total = F.count("*").over(g), F.sum(votes).over(g)
    divisor = F.when(F.col(seats) > n / 2, total / (F.col(seats) - n / 2) * (1 + 1e-12))
    rows = rows.withColumns({"_n": n, "_total": total, "_sure": F.coalesce(F.floor(F.col(votes) / F.when(divisor > 0, divisor) + 0.5), F.lit(0)).cast("long")})
    rows = rows.withColumn("_left", F.col(seats) - F.sum("_sure").over(g))
    turns = F.sequence(F.lit(0).cast("long"), F.ceil(F.col(votes) / F.col("_total") * (F.col("_n") + 1)) + 1)
    tried = rows.filter(F.col(votes) > 0).select(*group, *order, votes, "_left", "_sure", F.explode(turns).alias("_turn"))
    quotient = F.col(votes) / (F.col("_sure") + F.col("_turn") + 0.5)
    ranked = tried.withColumn("_rank", F.row_number().over(g.orderBy(quotient.desc(), *[F.col(c).asc_nulls_last() for c in order], "_turn")))
    won = ranked.filter(F.col("_rank") <= F.col("_left")).groupBy(*group, *order).agg(F.count("*").alias("_more"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"m.{c}")) for c in dict.fromkeys([*group, *order])]
    joined = rows.alias("r").join(won.alias("m"), same, "left")
    return joined.select(*[f"r.{c}" for c in rows.columns if c[0] != "_"], (F.col("_sure") + F.coalesce("_more", F.lit(0))).alias(out))


def quotas(by_bucket: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """by_bucket (source, bucket, size) with its source's size and target, its shard, the shard's size and the words that the shard is to give."""
    sources = targets(by_bucket.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    blocks = F.floor(F.sum("source_size").over(W.partitionBy()) / block_words)
    sources = sainte_lague(sources.withColumns({"all": F.lit(0), "blocks": blocks}), ["all"], ["nth"], "target", "blocks", "source_blocks")
    shards = F.least(F.lit(BUCKETS), F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("source_size") / shard_words))))).cast("long")
    named = by_bucket.alias("b").join(sources.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")))
    placed = named.select("b.source", "bucket", "size", "nth", "source_size", "target", "source_blocks", (F.col("bucket") % shards).alias("shard"))
    by_shard = placed.groupBy("nth", "shard", "source_blocks").agg(F.sum("size").alias("shard_size"))
    given = sainte_lague(by_shard, ["nth"], ["shard"], "shard_size", "source_blocks", "shard_blocks")
    given = given.select("nth", "shard", "shard_size", F.least(F.col("shard_blocks") * block_words, max_epochs * F.col("shard_size")).alias("quota"))
    return placed.drop("size", "source_blocks").join(given, ["nth", "shard"])


def mix(docs: DataFrame, seed: int = 17, carry: tuple[str, ...] = (), **how: object) -> DataFrame:
    """doc_id, carried columns, size, source_size, target and taken (the document's words in the mix, repeats counted)."""
    own = [F.xxhash64(F.lit(seed + k), F.col("doc_id"), F.col("source"), F.col("text")) for k in (0, 1)]
    base = docs.select("doc_id", "source", *carry, n_words(F.col("text")).alias("size"), F.pmod(own[0], F.lit(BUCKETS)).alias("bucket"), own[1].alias("turn"))
    slim = written(base.drop(*carry), "mix-sizes")
    quota = quotas(slim.groupBy("source", "bucket").agg(F.sum("size").alias("size")), **how)
    rows = (base if carry else slim).alias("d").join(quota.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.bucket") == F.col("q.bucket")))
    line = W.partitionBy("nth", "shard").orderBy("turn", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    c = F.col
    rows = rows.select("d.doc_id", c("d.source").alias("source"), *carry, "size", "source_size", "target", "shard_size", "quota", F.coalesce(F.sum("size").over(line), F.lit(0)).alias("start"))
    shard = F.greatest("shard_size", F.lit(1))
    part = F.greatest(F.lit(0), F.least(c("size"), c("quota") % shard - c("start")))
    return rows.withColumn("taken", (F.floor(c("quota") / shard) * c("size") + part).cast("long")).drop("shard_size", "quota", "start")


def first_words(text: Column, n: Column) -> Column:
    """The text up to its n-th word, if it has more."""
    lead = F.when(text.rlike(f"^{WS}"), 1).otherwise(0)
    rest = F.element_at(F.split(text, f"{WS}+", n + lead + 1), -1)
    return F.regexp_replace(F.left(text, F.length(text) - F.length(rest)), f"{WS}+$", "")


def mixed(docs: DataFrame, seed: int = 17, **how: object) -> DataFrame:
    """The mix itself, with the columns of docs: a document's row as often as it is taken whole, and its first words where a block ends inside it."""
    packed = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("_row"))  # columns of any name
    rows = mix(packed, seed, ("_row",), **how).filter(F.col("taken") > 0)
    text, whole, part = F.col("_row.text"), F.floor(F.col("taken") / F.col("size")).cast("int"), (F.col("taken") % F.col("size")).cast("int")
    texts = F.concat(F.array_repeat(text, whole), F.when(part > 0, F.array(first_words(text, part))).otherwise(F.array().cast("array<string>")))
    taken = rows.select("_row", F.explode(texts).alias("_text"))
    return taken.select(*(F.col("_text").alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns))


def op4_mixing(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken", "source")
