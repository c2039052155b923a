"""Nulls in any column, empty and very long texts, repeated rows, empty tables and columns of clashing names, for every operator and stage."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from amperia.llm.bpe import decode, encode, op3_bpe
from amperia.llm.imatch import op7_fingerprints
from amperia.llm.licenses import op10_licenses
from amperia.llm.line_dedup import op5_line_dedup
from amperia.llm.mixing import mixed, op4_mixing
from amperia.llm.ngram_join import one_of_each, op2_ngram_join
from amperia.llm.pii import op6_pii
from amperia.llm.quality_classifier import op9_quality_classifier, quality_filter
from amperia.llm.quality_rules import op8_quality_rules
from amperia.llm.toxicity import op1_toxicity

PLAIN = (op2_ngram_join, op3_bpe, op4_mixing, op5_line_dedup, op6_pii, op7_fingerprints, op8_quality_rules, op10_licenses)
LABELLED = (op1_toxicity, op9_quality_classifier)
#: Names that the operators use for columns of their own.
CLASHES = ("th", "fp", "size", "bucket", "token", "label", "score", "keep", "_row", "key", "rep", "target", "taken", "n_words", "_at", "run", "turn", "component_id", "_id", "kept", "w", "spans", "ids", "x", "pos", "nth", "shard", "quality", "toxic")

COPY = "the same words stand here again and again in this row " * 3
ROWS = [
    (1, None, "a"), (2, "", None), (3, " \n\t  \n", "a"), (None, "words without an id stand here and are kept", "b"), (None, None, None),
    (4, "x", "b"), (5, COPY, "b"), (6, COPY, None), (6, COPY, None), (7, "long " * 40_000 + "é" * 3000, "c"), (8, "a" * 70_000, "c"),
    (9, "mail a.b@c.org or +1 (555) 010-9999, 4111 1111 1111 1111, 10.0.0.1", "c"), (10, "Released under the MIT License.\nплохой текст\x00😀", "c"),
]


@pytest.fixture(scope="module")
def odd(table):
    docs = table(ROWS)
    for k, c in enumerate(CLASHES):
        docs = docs.withColumn(c, F.lit(None).cast("string") if k % 2 else F.lit(k))
    return docs


@pytest.fixture(scope="module")
def some_labels(label_table):
    return label_table([(1, 0, 1), (2, None, 0), (4, 1, None), (5, 1, 0), (6, 0, 1), (6, 1, 0), (7, 1, 0), (None, 1, 1), (99, 0, 0), (3, 1, 1), (8, 0, 0), (9, 1, 1), (10, 1, 0)])


@pytest.mark.parametrize("op", PLAIN, ids=lambda f: f.__name__)
def test_one_row_for_each_document(odd, table, op):
    assert sorted(str(r[0]) for r in op(odd).select("doc_id").collect()) == sorted(str(r[0]) for r in ROWS)
    assert op(table([])).count() == 0


def by_id(df):
    """Rows by doc_id, of which 6 and null stand twice."""
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_values_of_null_empty_long_and_repeated_rows(odd):
    """Defined results: by hand for each case."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = by_id(op2_ngram_join(odd))
    assert [(got[d][0].n_shingles, got[d][0].component_id) for d in (1, 2, 3, 4, 5, 6, 7, 8)] == [(0, 1), (0, 2), (0, 3), (1, 4), (got[5][0].n_shingles, 5), (got[5][0].n_shingles, 5), (2, 7), (1, 8)]
    assert {r.component_id for r in got[None]} == {None} and len(got[6]) == 2
    got = by_id(op3_bpe(odd))
    assert all((got[d][0].n_tokens, got[d][0].ids_sha256, got[d][0].decoded_sha256) == (0, sha(""), sha("")) for d in (1, 2, 3)) and got[6][0] == got[6][1]
    got = by_id(op4_mixing(odd))
    assert [got[d][0].size for d in (1, 2, 3, 4, 7, 8)] == [0, 0, 0, 1, 40_001, 1] and all(0 <= r.taken <= 3 * r.size for rows in got.values() for r in rows) and len(got[6]) == 2
    got = by_id(op5_line_dedup(odd))
    assert [(got[d][0].n_lines, got[d][0].n_dropped) for d in (1, 2, 3, 4, 8)] == [(1, 0), (1, 0), (3, 0), (1, 0), (1, 0)] and got[1][0].kept_sha256 == sha("") and got[3][0].kept_sha256 == sha(" \n\t  \n")
    got = by_id(op6_pii(odd))
    assert all((got[d][0].n_email, got[d][0].n_ip, got[d][0].n_card, got[d][0].n_phone, got[d][0].spans, got[d][0].base_sha256) == (0, 0, 0, 0, "", sha("")) for d in (1, 2, 3, 4, 8))
    assert (got[9][0].n_email, got[9][0].n_ip, got[9][0].n_card, got[9][0].n_phone) == (1, 1, 1, 1)
    got = by_id(op7_fingerprints(odd))
    assert [got[d][0].n_chars for d in (1, 2, 7, 8)] == [0, 0, 203_000, 70_000] and got[1][0].fingerprint == got[2][0].fingerprint and got[5][0].fingerprint == got[6][0].fingerprint == got[6][1].fingerprint
    got = by_id(op8_quality_rules(odd))
    assert [(got[d][0].n_words, got[d][0].word_chars, got[d][0].base_failed, got[d][0].kept) for d in (1, 2, 3, 4)] == [(0, 0, True, False)] * 3 + [(1, 1, True, False)] and got[7][0].n_repeat_words == 40_000 and got[7][0].base_failed
    got = by_id(op10_licenses(odd))
    assert [(got[d][0].n_paragraphs, got[d][0].families) for d in (1, 2, 3, 4, 8, 10)] == [(0, ""), (0, ""), (0, ""), (1, ""), (1, ""), (1, "MIT")]


@pytest.mark.parametrize("op", LABELLED, ids=lambda f: f.__name__)
def test_labelled(odd, table, label_table, some_labels, op):
    for labels in (some_labels, label_table([])):
        got = op(odd, labels).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in got)
    assert op(table([]), some_labels).count() == 0


@pytest.mark.parametrize("stage", [one_of_each, mixed, lambda d: corpus_pipeline.dedup_lines(d.sparkSession, d, "")], ids=["one_of_each", "mixed", "dedup_lines"])
def test_stages_carry_all_columns(odd, table, stage):
    assert stage(odd).columns == odd.columns
    assert stage(odd).count() > 0
    assert stage(table([])).count() == 0


def test_quality_filter_carries_all_columns(odd, table, some_labels):
    assert quality_filter(odd, some_labels).columns == odd.columns
    kept = {r.doc_id for r in op9_quality_classifier(odd, some_labels).collect() if r.predicted}
    assert {r.doc_id for r in quality_filter(odd, some_labels).collect()} == kept
    assert quality_filter(table([]), some_labels).count() == 0


def test_encode_and_decode_keep_nulls(odd):
    got = {str(r.doc_id): r.text for r in decode(encode(odd)).collect()}
    assert got["1"] == got["2"] == got["3"] == ""
    assert decode(encode(odd)).count() == len(ROWS)
