"""The queries of the corpus operators: each applies one of them, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracle
from .bpe import op3_bpe
from .common import benchmark, documents, embeddings, labels
from .decontamination import op13_decontamination
from .imatch import op7_fingerprints
from .licenses import op10_licenses
from .line_dedup import op5_line_dedup
from .merkle import op12_merkle
from .mixing import op4_mixing
from .ngram_join import op2_ngram_join
from .pii import op6_pii
from .quality_classifier import op9_quality_classifier
from .quality_rules import op8_quality_rules
from .toxicity import op1_toxicity
from .whitening import op11_whitening

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": lambda s, d: op1_toxicity(documents(s, d), labels(s, d)),
        "op2_ngram_join": lambda s, d: op2_ngram_join(documents(s, d)),
        "op3_bpe": lambda s, d: op3_bpe(documents(s, d)),
        "op4_mixing": lambda s, d: op4_mixing(documents(s, d)),
        "op5_line_dedup": lambda s, d: op5_line_dedup(documents(s, d)),
        "op6_pii": lambda s, d: op6_pii(documents(s, d)),
        "op7_fingerprints": lambda s, d: op7_fingerprints(documents(s, d)),
        "op8_quality_rules": lambda s, d: op8_quality_rules(documents(s, d)),
        "op9_quality_classifier": lambda s, d: op9_quality_classifier(documents(s, d), labels(s, d)),
        "op10_licenses": lambda s, d: op10_licenses(documents(s, d)),
        "op11_whitening": lambda s, d: op11_whitening(embeddings(s, d)),
        "op12_merkle": lambda s, d: op12_merkle(documents(s, d)),
        "op13_decontamination": lambda s, d: op13_decontamination(documents(s, d), benchmark(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    """SQL exists only where DuckDB can state the whole result; the others are tested against brute force."""
    return oracle.SQL
