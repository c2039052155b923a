"""Reconciliation of outage events: from pending events to facts, errors and the rest of a batch's changes. Lazy: nothing here runs a job, unless a store is given."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.changes import sequential_keys
from ..operators.pairing import DOUBLE, OUTAGE, TRANSIENT_MINUTES, orphans, pairs, pending
from ..operators.versions import asof_global, asof_latest, last_day

Tables = dict[str, DataFrame]
#: Makes a table of an intermediate result and its name; the default leaves it a plan that is computed wherever it is read.
Store = Callable[[DataFrame, str], DataFrame]
#: The rows of a table that are filed under the days of other rows: the table, and rows with a column dia.
Near = Callable[[str, DataFrame], DataFrame | None]

# Names of the members that stand for what is unknown.
UNKNOWN_SECTOR, UNKNOWN_DISTRICT = "SECTOR_DESCONOCIDO", "DISTRITO_DESCONOCIDO"
UNKNOWN_NETWORK = ("TRANSFORMADOR_DESCONOCIDO", "CIRCUITO_DESCONOCIDO", "SUBESTACION_DESCONOCIDA")
#: Customers served, and since when, where no inventory version holds.
DEFAULT_INVENTORY = (1, "2020-01-01")
#: Meters whose generated network keys are numbered together.
METERS_IN_BUCKET = 100_000


def valid_pairs(p: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Paired outages that are not transient and not facts yet."""
    long = p.filter((F.col("clasificacion") == "PAR_VALIDO") & (F.col("duracion_minutos") >= TRANSIENT_MINUTES))
    if facts is None:
        return long
    known = facts.select("id_medidor", F.col("timestamp_inicio").alias("ts_outage"))
    return long.join(known, ["id_medidor", "ts_outage"], "left_anti")


def as_plan(df: DataFrame, name: str) -> DataFrame:
    return df


def network_fallback(t: Tables, starts: DataFrame) -> DataFrame:
    """The network versions to be added for meters of starts (id_medidor, ts_outage) that no version covers: one each, valid from a day before the first such outage.

    Outages that an existing version covers keep it; only those left over use the new one.
    """
    looked = asof_latest(starts, t["dim_red_electrica"], ("id_medidor", "id_medidor_origen"), "ts_outage", ["sk_red_electrica"])
    lost = looked.filter(F.col("sk_red_electrica").isNull()).groupBy("id_medidor").agg(F.expr("min(ts_outage) - interval 1 day").alias("fecha_inicio"))
    top = t["dim_red_electrica"].agg(F.coalesce(F.max("sk_red_electrica"), F.lit(0)).alias("_top"))
    numbered = sequential_keys(lost, "_nth", F.expr(f"id_medidor div {METERS_IN_BUCKET}"), ["id_medidor"]).crossJoin(F.broadcast(top)).crossJoin(F.broadcast(unknown_sector(t)))
    return numbered.select(
        (F.col("_nth") + F.col("_top")).alias("sk_red_electrica"),
        "id_medidor",
        F.col("id_medidor").alias("id_medidor_origen"),
        F.concat(F.lit("MED-"), F.col("id_medidor")).alias("codigo_medidor"),
        *(F.lit(v).alias(c) for c, v in zip(("transformador", "circuito", "subestacion"), UNKNOWN_NETWORK, strict=True)),
        F.col("sk_desconocido").alias("sk_geografia_urbana"),
        "fecha_inicio",
        F.lit(None).cast("timestamp").alias("fecha_fin"),
        F.lit(True).alias("activo_bool"),
    )


def unknown_sector(t: Tables) -> DataFrame:
    """One row: the key of the unknown sector (sk_desconocido), the next free one if there is none yet (existe)."""
    geo = t["dim_geografia_urbana"]
    own = F.min(F.when(F.col("sector_urbano") == UNKNOWN_SECTOR, F.col("sk_geografia_urbana")))
    return geo.agg(F.coalesce(own, F.coalesce(F.max("sk_geografia_urbana"), F.lit(0)) + 1).alias("sk_desconocido"), own.isNotNull().alias("existe"))


def resolved(t: Tables, long: DataFrame, added: DataFrame) -> DataFrame:
    """Pairs with all dimension keys: facts without identity. added: the network versions of network_fallback. A start outside the calendar is an error, as it is where the key may not be null."""
    red = asof_latest(long, t["dim_red_electrica"], ("id_medidor", "id_medidor_origen"), "ts_outage", ["sk_red_electrica", "sk_geografia_urbana"])
    spare = added.select("id_medidor", F.col("sk_red_electrica").alias("sk_otra"))
    placed = red.join(spare, "id_medidor", "left").crossJoin(F.broadcast(unknown_sector(t)))
    inventory = asof_global(placed, t["dim_clientes_inventario"], "ts_outage", ["sk_clientes"], last_day(t["dim_fecha"]))
    top = t["dim_clientes_inventario"].agg((F.coalesce(F.max("sk_clientes"), F.lit(0)) + 1).alias("sk_inventario"))
    kind = t["dim_tipo_evento"].filter(F.col("codigo_evento") == OUTAGE).agg(F.coalesce(F.min("sk_tipo_evento"), F.lit(-1)).cast("long").alias("sk_tipo_evento"))
    dated = inventory.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(kind)).withColumns({"fecha": F.to_date("ts_outage"), "hora": F.hour("ts_outage")})
    keyed = dated.join(F.broadcast(t["dim_fecha"].select("fecha", "sk_fecha")), "fecha", "left").join(F.broadcast(t["dim_tiempo"].select("hora", "sk_tiempo")), "hora", "left")
    outside = F.raise_error(F.concat(F.lit("fecha fuera de calendario: "), F.col("fecha").cast("string"))).cast("long")
    return keyed.select(
        F.coalesce("sk_fecha", outside).alias("sk_fecha"),
        "sk_tiempo",
        F.coalesce("sk_red_electrica", "sk_otra").alias("sk_red_electrica"),
        F.coalesce("sk_geografia_urbana", "sk_desconocido").alias("sk_geografia_urbana"),
        F.coalesce("sk_clientes", "sk_inventario").alias("sk_clientes"),
        "sk_tipo_evento",
        "id_medidor",
        F.col("ts_outage").alias("timestamp_inicio"),
        F.col("ts_restoration").alias("timestamp_fin"),
        "duracion_minutos",
        F.lit(1).alias("clientes_afectados"),
    )


def reconcile_outages(t: Tables, start: datetime | None = None, end: datetime | None = None, store: Store = as_plan, near: Near | None = None) -> Tables:
    """What a batch over the pending events changes: hechos, errores, procesados (id_evento, timestamp_evento), red_nueva, geografia_nueva, clientes_nuevo, contadores.

    near: reads the facts and errors that the batch may repeat, by the days of its own; without it those of t.
    """
    near = near or (lambda name, _: t.get(name))
    day = lambda rows, at: rows.select(F.to_date(at).alias("dia"))
    events = pending(t["staging_eventos"], "timestamp_evento", start, end)
    lone, p = store(orphans(events), "huerfanas"), store(pairs(events), "pares")
    long = valid_pairs(p, near("fact_interrupciones", day(valid_pairs(p), "ts_outage")))
    added = store(network_fallback(t, long.select("id_medidor", "ts_outage")), "red_nueva")
    hechos = store(resolved(t, long, added), "hechos")
    error = lambda rows, kind, reason, detail, at: rows.select(F.col(at[0]).alias("id_evento_origen"), "id_medidor", F.col(at[1]).alias("timestamp_evento"), F.lit(at[2]).alias("tipo_evento"), F.lit(kind).alias("tipo_error"), reason.alias("motivo_error"), F.lit(detail).cast("string").alias("detalle_tecnico"))
    known = near("err_telemetria", day(lone, "timestamp_evento"))
    logged = lone if known is None else lone.join(known.select(F.col("id_evento_origen").alias("id_evento")), "id_evento", "left_anti")
    orphan_rows = error(logged, "INTERRUPCION", F.col("huerfana"), None, ("id_evento", "timestamp_evento", "POWER_RESTORATION"))
    double_rows = error(p.filter("clasificacion = 'DOBLE_OUTAGE'"), "OUTAGE_DUPLICADA", F.lit(DOUBLE), None, ("id_outage", "ts_outage", OUTAGE))
    unknown = error(long.join(t["dim_tipo_evento"].filter(F.col("codigo_evento") == OUTAGE), F.lit(True), "left_anti"), "EVENTO_DESCONOCIDO", F.lit(f"Tipo de evento '{OUTAGE}' no existe en dim_tipo_evento"), None, ("id_outage", "ts_outage", OUTAGE))
    paired = p.filter("clasificacion = 'PAR_VALIDO'")
    first, second = F.struct(F.col("id_outage").alias("id_evento"), F.col("ts_outage").alias("timestamp_evento")), F.struct(F.col("id_restoration").alias("id_evento"), F.col("ts_restoration").alias("timestamp_evento"))
    done = lone.select("id_evento", "timestamp_evento").unionByName(paired.select(F.inline(F.array(first, second)))).unionByName(p.filter("clasificacion = 'DOBLE_OUTAGE'").select("id_outage", "ts_outage").toDF("id_evento", "timestamp_evento"))
    sector = unknown_sector(t)
    lacking = hechos.join(F.broadcast(sector.filter("not existe")), F.col("sk_geografia_urbana") == F.col("sk_desconocido")).select(F.col("sk_desconocido").alias("sk_geografia_urbana")).distinct()
    customers = hechos.join(t["dim_clientes_inventario"].select("sk_clientes"), "sk_clientes", "left_anti").select("sk_clientes").distinct()
    return {
        "hechos": hechos,
        "errores": orphan_rows.unionByName(double_rows).unionByName(unknown),
        "procesados": done,
        "red_nueva": added,
        "geografia_nueva": lacking.select("sk_geografia_urbana", F.lit(UNKNOWN_SECTOR).alias("sector_urbano"), F.lit(UNKNOWN_DISTRICT).alias("distrito"), F.lit("NORMAL").alias("nivel_criticidad")),
        "clientes_nuevo": customers.select("sk_clientes", F.lit(DEFAULT_INVENTORY[0]).alias("total_clientes_servidos"), F.lit(DEFAULT_INVENTORY[1]).cast("timestamp").alias("fecha_inicio"), F.lit(None).cast("timestamp").alias("fecha_fin"), F.lit(True).alias("activo_bool"), F.lit(1).alias("version")),
        "contadores": counters(p, logged, hechos),
    }


def pair_counts() -> list[Column]:
    """Totals of a batch's pairs, to be aggregated or observed."""
    kind, short = F.col("clasificacion"), F.col("duracion_minutos") < TRANSIENT_MINUTES
    return [
        F.coalesce(F.sum(F.when(kind == "PAR_VALIDO", 2).otherwise(1)), F.lit(0)).cast("long").alias("total_eventos"),
        F.count_if((kind == "PAR_VALIDO") & short).alias("total_transitorios"),
        F.count_if(kind == "DOBLE_OUTAGE").alias("_dobles"),
    ]


def counters(p: DataFrame, logged: DataFrame, hechos: DataFrame) -> DataFrame:
    """One row with the batch's totals; orphan restorations are not among total_eventos."""
    one = p.agg(*pair_counts()).crossJoin(logged.agg(F.count("*").alias("_huerfanas"))).crossJoin(hechos.agg(F.count("*").alias("total_hechos")))
    return one.select("total_eventos", "total_hechos", (F.col("_huerfanas") + F.col("_dobles")).alias("total_huerfanos"), "total_transitorios")
