"""Lookups in slowly changing dimensions: rows are valid from fecha_inicio up to, not including, fecha_fin; null is open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def holds(start: Column, end: Column, at: Column) -> Column:
    return (start <= at) & (end.isNull() | (end > at))


def versions_by(dim: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and its versions, latest first (ties: the larger surrogate key, the first of columns)."""
    packed = F.struct("fecha_inicio", *columns, "fecha_fin")
    return dim.groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_list(packed), asc=False).alias("_versions"))


def asof_latest(rows: DataFrame, dim: DataFrame, on: tuple[str, str], at: str, columns: list[str]) -> DataFrame:
    """rows with columns of the latest version that holds at a timestamp, null without one. on: key in rows, key in dim.

    A key's versions travel as one array, so the join keeps one row for each row and needs no second shuffle to pick one.
    """
    v = versions_by(dim, on[1], columns)
    joined = rows.join(v, rows[on[0]] == v["_key"], "left")
    found = F.get(F.filter("_versions", lambda x: holds(x.fecha_inicio, x.fecha_fin, F.col(at))), F.lit(0))
    return joined.withColumn("_v", found).select(*rows.columns, *(F.col(f"_v.{c}").alias(c) for c in columns))


#: Days of a bucket of time that versions without a key are cut to.
BUCKET_DAYS = 32


def _bucket(day: Column) -> Column:
    return F.floor(F.unix_date(day) / BUCKET_DAYS)


def last_day(calendar: DataFrame) -> Column:
    """The calendar's last day, as a scalar subquery."""
    return calendar.select(F.max("fecha")).scalar()


def cut(dim: DataFrame, columns: list[str], until: Column) -> DataFrame:
    """_bucket, _from, _to and columns of the versions of a dimension, one row for each bucket of time that a version touches; open ones go on to the day until. Versions that start later are left out: no row that is looked up is later."""
    end = F.least(F.coalesce(F.to_date("fecha_fin"), until), until)
    rows = dim.filter(F.to_date("fecha_inicio") <= until).select(F.col("fecha_inicio").alias("_from"), F.col("fecha_fin").alias("_to"), *columns, end.alias("_end"))
    return rows.withColumn("_bucket", F.explode(F.sequence(_bucket(F.to_date("_from")), F.greatest(_bucket(F.col("_end")), _bucket(F.to_date("_from")))))).drop("_end")


def all_that_hold(rows: DataFrame, dim: DataFrame, at: str, columns: list[str], until: Column) -> DataFrame:
    """rows with columns of every version, of a dimension without a key, that holds at a timestamp, null without one: an equi-join on buckets of time with the interval as residual. Spark broadcasts the cut versions only where they are small."""
    v = cut(dim, columns, until)
    there = (v["_bucket"] == _bucket(F.to_date(rows[at]))) & holds(v["_from"], v["_to"], rows[at])
    return rows.join(v, there, "left").drop("_bucket", "_from", "_to")


def segments(dim: DataFrame, columns: list[str], until: Column) -> DataFrame:
    """_bucket, _since, _next and columns: stretches of time, inside buckets, with the latest version that holds in each (ties: the larger of columns). No two of them overlap."""
    v = cut(dim, columns, until)
    edges = v.select("_bucket", F.explode(F.array("_from", "_to")).alias("_since")).distinct()
    ahead = F.lead("_since").over(W.partitionBy("_bucket").orderBy(F.col("_since").asc_nulls_last()))
    stretches = edges.withColumn("_next", ahead).filter("_since is not null")
    s, x = stretches.alias("s"), v.alias("x")
    same = (F.col("s._bucket") == F.col("x._bucket")) & holds(F.col("x._from"), F.col("x._to"), F.col("s._since"))
    latest = F.max_by(F.struct(*(F.col(f"x.{n}") for n in columns)), F.struct("x._from", *(F.col(f"x.{n}") for n in columns)))
    return s.join(x, same).groupBy("s._bucket", "s._since", "s._next").agg(latest.alias("_v")).select("_bucket", "_since", "_next", *(F.col(f"_v.{n}") for n in columns))


def asof_global(rows: DataFrame, dim: DataFrame, at: str, columns: list[str], until: Column) -> DataFrame:
    """asof_latest for a dimension without a key; until is the last day that is looked up. Each row meets the one stretch of its bucket that it falls into: rows are neither sorted nor gathered."""
    v = segments(dim, columns, until).alias("_s")
    there = (F.col("_s._bucket") == _bucket(F.to_date(F.col(f"_r.{at}")))) & holds(F.col("_s._since"), F.col("_s._next"), F.col(f"_r.{at}"))
    return rows.alias("_r").join(v, there, "left").select(*(F.col(f"_r.{x}") for x in rows.columns), *(F.col(f"_s.{x}") for x in columns))


def interval_join(rows: DataFrame, dim: DataFrame, on: tuple[str, str], at: str, how: str = "inner", active_only: bool = True) -> DataFrame:
    """All versions that hold at a timestamp: an equi-join on the key with the interval as residual. how may be inner, left, left_semi, left_anti."""
    d = dim.filter("activo_bool") if active_only else dim
    cond = (rows[on[0]] == d[on[1]]) & holds(d["fecha_inicio"], d["fecha_fin"], rows[at])
    return rows.join(d, cond, how)
