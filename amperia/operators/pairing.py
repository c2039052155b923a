"""Pairing of a meter's outages with its restorations."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import minutes

OUTAGE, RESTORATION = "POWER_OUTAGE", "POWER_RESTORATION"
#: Outages shorter than this, in rounded minutes, are transient.
TRANSIENT_MINUTES = 5

# Reasons that the error table holds.
NO_OUTAGE_BEFORE = "RESTAURACION_HUERFANA: no existe OUTAGE previa para este medidor"
CONSECUTIVE = "RESTAURACION_HUERFANA: restauración consecutiva sin OUTAGE intermedia"
DOUBLE = "OUTAGE_DUPLICADA: dos eventos POWER_OUTAGE consecutivos sin RESTORATION intermedia"


def pending(staging: DataFrame, at: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """The rows not yet processed, between start and end, both inclusive; a bound that is None adds no predicate."""
    rows = staging.filter(~F.col("procesado"))
    if start is not None:
        rows = rows.filter(F.col(at) >= F.lit(start))
    return rows if end is None else rows.filter(F.col(at) <= F.lit(end))


LINE = ("id_medidor", "timestamp_evento", "id_evento")
AHEAD = ("tipo_evento", "id_evento", "timestamp_evento")


def _why(before: Column) -> Column:
    """The reason why a restoration is an orphan, given the type of the event before it; null for all else."""
    return F.when(F.col("tipo_evento") == RESTORATION, F.when(before.isNull(), NO_OUTAGE_BEFORE).when(before == RESTORATION, CONSECUTIVE))


def classified(events: DataFrame) -> DataFrame:
    """events with huerfana (the reason, for a restoration without an outage before it).

    Both windows of a pairing have the meter as key and the same order, so events are shuffled and sorted once. All event types take part; orphans leave before outages look for what comes next.
    """
    line = W.partitionBy("id_medidor").orderBy("timestamp_evento", "id_evento")
    return events.withColumn("huerfana", _why(F.lag("tipo_evento").over(line)))


def orphans(events: DataFrame) -> DataFrame:
    return classified(events).filter(F.col("huerfana").isNotNull())


def pairs(events: DataFrame) -> DataFrame:
    """One row for each outage: clasificacion (PAR_VALIDO, DOBLE_OUTAGE, OUTAGE_ABIERTO, ERROR_DESCONOCIDO), its restoration and duration if it has one."""
    line = W.partitionBy("id_medidor").orderBy("timestamp_evento", "id_evento")
    kept = classified(events).filter(F.col("huerfana").isNull())
    return paired(kept.select(*LINE, "tipo_evento", *(F.lead(c).over(line).alias(f"sig_{c}") for c in AHEAD)))


def paired(ahead: DataFrame) -> DataFrame:
    """The pairs of events that know the next one of their meter (sig_tipo_evento, sig_id_evento, sig_timestamp_evento)."""
    kind = F.when(F.col("sig_tipo_evento") == RESTORATION, "PAR_VALIDO").when(F.col("sig_tipo_evento") == OUTAGE, "DOBLE_OUTAGE").when(F.col("sig_tipo_evento").isNull(), "OUTAGE_ABIERTO").otherwise("ERROR_DESCONOCIDO")
    out = ahead.filter(F.col("tipo_evento") == OUTAGE).withColumn("clasificacion", kind)
    valid = F.col("clasificacion") == "PAR_VALIDO"
    return out.select(
        F.col("id_evento").alias("id_outage"),
        "id_medidor",
        F.col("timestamp_evento").alias("ts_outage"),
        F.when(valid, F.col("sig_id_evento")).alias("id_restoration"),
        F.when(valid, F.col("sig_timestamp_evento")).alias("ts_restoration"),
        "clasificacion",
        F.when(valid, minutes(F.col("timestamp_evento"), F.col("sig_timestamp_evento"))).alias("duracion_minutos"),
    )


# -- the same where one meter may have most of the events --------------------------------------------


Store = Callable[[DataFrame, str], DataFrame]


def ranged(events: DataFrame, store: Store, parts: int | None = None) -> DataFrame:
    """events with parte, the range of meter, time and id that they fall into: a meter with very many events has many ranges. Stored, so that a range stays what it is. parts: how many; without it as many as Spark finds fit for the size."""
    return store(events.repartitionByRange(*([parts] if parts else []), *LINE).withColumn("parte", F.spark_partition_id()), "rangos")


def _edge_values(rows: DataFrame, values: list[str], forward: bool) -> DataFrame:
    """id_medidor, parte, _beyond: for the ranges that share a meter with others, what (values) the nearest event of that meter in an earlier (or later, if forward) range has.

    A range shares its first meter with those before it and its last with those after it, so there are two rows for each range at most; only these are sorted by meter.
    """
    shared = rows.groupBy("id_medidor").agg(F.min("parte").alias("_a"), F.max("parte").alias("_b")).filter("_a < _b").select("id_medidor")
    pick = F.min_by if forward else F.max_by
    order = F.struct("timestamp_evento", "id_evento")
    edges = rows.join(shared, "id_medidor", "left_semi").groupBy("id_medidor", "parte").agg(pick(F.struct(*values), order).alias("_edge"))
    by = W.partitionBy("id_medidor").orderBy(F.col("parte").desc() if forward else F.col("parte"))
    return edges.select("id_medidor", "parte", F.lag("_edge").over(by).alias("_beyond"))


def _along(rows: DataFrame, values: list[str], prefix: str, forward: bool) -> DataFrame:
    """rows with the values of the event before (or after) in the meter's line: inside the range by a window, at its edge from the ranges beyond."""
    line = W.partitionBy("parte", "id_medidor").orderBy("timestamp_evento", "id_evento")
    step = F.lead if forward else F.lag
    seen = rows.withColumns({"_at": F.row_number().over(line) if not forward else step("id_evento").over(line), "_next": step(F.struct(*values)).over(line)})
    edge = (F.col("_at") == 1) if not forward else F.col("_at").isNull()
    joined = seen.withColumn("_edge", edge).join(_edge_values(rows, values, forward), ["id_medidor", "parte"], "left")
    value = F.when(F.col("_edge"), F.col("_beyond")).otherwise(F.col("_next"))
    return joined.withColumn("_value", value).select(*rows.columns, *(F.col(f"_value.{v}").alias(f"{prefix}{v}") for v in values))


def orphans_by_ranges(events: DataFrame, store: Store, parts: int | None = None) -> DataFrame:
    """As orphans, over stored ranges."""
    seen = _along(ranged(events, store, parts), ["tipo_evento"], "ant_", forward=False)
    return seen.withColumn("huerfana", _why(F.col("ant_tipo_evento"))).filter(F.col("huerfana").isNotNull()).drop("ant_tipo_evento", "parte")


def pairs_by_ranges(events: DataFrame, store: Store, parts: int | None = None) -> DataFrame:
    """As pairs, over stored ranges of meter and time: no task gets all events of a meter. Orphans may fill whole ranges; what comes next is then found beyond them."""
    seen = _along(ranged(events, store, parts), ["tipo_evento"], "ant_", forward=False)
    kept = store(seen.filter(_why(F.col("ant_tipo_evento")).isNull()).select(*LINE, "tipo_evento", "parte"), "sin-huerfanas")
    return paired(_along(kept, list(AHEAD), "sig_", forward=True))
