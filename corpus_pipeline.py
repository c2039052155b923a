"""A training corpus from documents: junk goes, shared lines stay once, of similar documents one stays, sources are mixed to weights, the mix is encoded.

Columns of other names pass through every stage but the last, untouched, whatever they are called. A null in lang, source or any other column stays. Empty tables give empty results with the same columns. Texts are never cut but where a block of the mix ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amperia.llm.bpe import round_trip
from amperia.llm.common import documents, labels, ship, written
from amperia.llm.line_dedup import drop_lines, keep_bitmaps
from amperia.llm.mixing import mixed
from amperia.llm.ngram_join import one_of_each
from amperia.llm.quality_classifier import quality_filter


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that came in, n_chars as the text now is."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject, scores at the threshold included.

    Null and empty texts are scored like others, as texts without words. Rows that repeat are decided each, alike; a row without doc_id is scored and kept or not, but never learnt from.
    """
    ship(spark)
    return quality_filter(docs, labels(spark, sf_dir))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that another one keeps; the largest doc_id keeps them, in all its rows.

    A null text becomes an empty one; no document goes, one that loses all lines is empty. Rows of one doc_id are one document and lose the same lines; rows without doc_id are together one, smaller than all others. Repeats of a line in the document that keeps it stay.
    """
    return _measured(drop_lines(docs, keep_bitmaps(docs), counts=False), docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: the one with the smallest doc_id, in all its rows.

    Null, empty and blank texts are similar to nothing and stay. Rows without doc_id stay. A doc_id is taken to stand for one text: rows that repeat it stay or go together.
    """
    ship(spark)
    return one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as they are taken, three times at most, the last of a block cut where the block ends.

    Null, empty and blank texts have no words and go. A null source is a source of its own. Rows that repeat are documents each. Ties of quotients go to the first source or shard, of turns to the smaller doc_id.
    """
    return _measured(mixed(docs), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of each row of the mix.

    A null or empty text has no tokens and the digests of nothing. Rows that repeat are encoded each; a null doc_id stays.
    """
    ship(spark)
    return round_trip(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: A trained classifier and seeded choices: SQL can't express them; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
