"""What several corpus operators share: tables, word splitting, lambdas with a bound value, what Python workers need."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.interim import stored as written  # noqa: F401

#: White space that separates words, as a character class of Java, Python and DuckDB regular expressions.
WS = r"[\x20\x09-\x0D]"
#: The same six characters, for trim().
WS_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows and bytes of a batch that a Python worker gets.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4096", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z become a-z; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text, in order; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{WS}+"), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often the lambdas inside body use it."""
    return F.transform(F.array(value), body)[0]


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package, where it is not installed on them: once for each application. Bounds the batches that they get, unless the session does, so that long texts do not add up in a worker."""
    sc = spark.sparkContext
    for name, most in BATCHES.items():
        if name not in spark.conf.getAll:
            spark.conf.set(name, most)
    if getattr(sc, "_amperia_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    at = Path(tempfile.mkdtemp()) / "amperia.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(at))
    sc._amperia_shipped = True
