import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def table(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows."""

    def make(rows, parts=3):
        full = [(r[0], r[1], "xx", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return make


@pytest.fixture(scope="session")
def label_table(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def prose(r: random.Random, n: int, words: int = 400) -> list[str]:
    return [f"w{int(words * r.random() ** 2)}" for _ in range(n)]
