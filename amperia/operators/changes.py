"""Changes to tables as new DataFrames: keys, upserts, updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sequential_keys(rows: DataFrame, name: str, bucket: Column, order: list[str], after: int = 0) -> DataFrame:
    """rows with keys after + 1, after + 2, ... in order of bucket, then order.

    Rows are numbered inside each bucket; buckets start where those before end. Only bucket counts, not rows, pass one task. Choose buckets of bounded size that agree with the order, such as days.
    """
    b = rows.withColumn("_bucket", bucket)
    counts = b.groupBy("_bucket").agg(F.count("*").alias("_n"))
    starts = counts.select("_bucket", F.coalesce(F.sum("_n").over(W.orderBy(F.col("_bucket").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    numbered = b.withColumn("_nth", F.row_number().over(W.partitionBy("_bucket").orderBy(*order)))
    joined = numbered.alias("r").join(starts.alias("s"), F.col("r._bucket").eqNullSafe(F.col("s._bucket")))
    return joined.select((F.col("_start") + F.col("_nth") + after).cast("long").alias(name), *(F.col(f"r.{c}") for c in rows.columns))


def insert_ignore(target: DataFrame | None, rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Those of rows to be added to target: the first in order of each key, unless target has the key."""
    first = rows.withColumn("_nth", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("_nth = 1").drop("_nth")
    return first if target is None else first.join(target.select(*key), key, "left_anti")


def upsert(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """target with rows in place of those with the same key, or added."""
    return target.join(rows.select(*key), key, "left_anti").unionByName(rows)


def update(target: DataFrame, keys: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """target with values set where its key is among keys; a key that repeats counts once."""
    hit = keys.select(F.col(keys.columns[0]).alias("_hit")).distinct()
    joined = target.join(hit, target[key] == hit["_hit"], "left")
    changed = {c: F.when(F.col("_hit").isNotNull(), v).otherwise(F.col(c)) for c, v in values.items()}
    return joined.select(*(changed[c].cast(target.schema[c].dataType).alias(c) if c in changed else F.col(c) for c in target.columns))
