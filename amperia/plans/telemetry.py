"""Reconciliation of meter readings: what is wrong with them, which become hourly facts, which are done. Lazy."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.changes import insert_ignore
from ..operators.pairing import pending
from ..operators.versions import interval_join
from .outages import Near, Store, Tables, as_plan

HARD_VOLTS, NORMAL_VOLTS = (0, 1000), (180, 260)

# Reasons that the error table holds.
INACTIVE = "MEDIDOR_INACTIVO: medidor no existe en dim_red_electrica o no está activo para esta fecha"
VOLTS_HARD = "VOLTAGE_OUT_OF_RANGE: voltaje fuera del rango aceptable 0-1000V"
VOLTS_NORMAL = "VOLTAGE_OUT_OF_RANGE: voltaje fuera del rango normal 180-260V (posible fluctuación)"
NEGATIVE = "CONSUMO_NEGATIVO: consumo_wh no puede ser negativo"

ON = ("id_medidor", "id_medidor_origen")


def inactive_readings(t: Tables, readings: DataFrame) -> DataFrame:
    """Readings whose meter has no active version at their time."""
    return interval_join(readings, t["dim_red_electrica"], ON, "timestamp_lectura", "left_anti")


def active_readings(t: Tables, readings: DataFrame) -> DataFrame:
    return interval_join(readings, t["dim_red_electrica"], ON, "timestamp_lectura", "left_semi")


def voltage_warnings(active: DataFrame) -> DataFrame:
    """Active readings with a voltage outside the hard or the normal range, with the reason."""
    v = F.col("voltaje")
    reason = F.when(~v.between(*HARD_VOLTS), VOLTS_HARD).when(~v.between(*NORMAL_VOLTS), VOLTS_NORMAL)
    return active.withColumn("motivo_error", reason).filter(F.col("motivo_error").isNotNull())


def negative_consumption(active: DataFrame) -> DataFrame:
    return active.filter(F.col("consumo_wh") < 0)


def telemetry_facts(t: Tables, readings: DataFrame) -> DataFrame:
    """Facts without identity: one reading for each network version, day and hour; of several the first by time, then id. Readings outside the calendar drop out."""
    good = readings.filter(F.col("voltaje").between(*HARD_VOLTS) & (F.col("consumo_wh") >= 0)).withColumns({"fecha": F.to_date("timestamp_lectura"), "hora": F.hour("timestamp_lectura")})
    red = t["dim_red_electrica"].select("id_medidor_origen", "sk_red_electrica", F.col("sk_geografia_urbana"), "fecha_inicio", "fecha_fin", "activo_bool")
    kinds = t["dim_tipo_evento"].select(F.col("codigo_evento").alias("tipo_lectura"), "sk_tipo_evento")
    keyed = interval_join(good, red, ON, "timestamp_lectura").join(F.broadcast(t["dim_fecha"].select("fecha", "sk_fecha")), "fecha").join(F.broadcast(t["dim_tiempo"].select("hora", "sk_tiempo")), "hora").join(F.broadcast(kinds), "tipo_lectura", "left")
    # There is no member for an unknown sector to fall back to, as there is for an unknown type: the batch fails.
    no_place = F.raise_error(F.concat(F.lit("medidor sin geografía: sk_red_electrica "), F.col("sk_red_electrica").cast("string"))).cast("long")
    rows = keyed.select(
        "sk_fecha",
        "sk_tiempo",
        "sk_red_electrica",
        F.coalesce("sk_geografia_urbana", no_place).alias("sk_geografia_urbana"),
        F.coalesce("sk_tipo_evento", F.lit(-1)).cast("long").alias("sk_tipo_evento"),
        F.date_trunc("hour", "timestamp_lectura").alias("timestamp_lectura"),
        F.round(F.col("consumo_wh") / 1000, 4).cast("decimal(12,4)").alias("consumo_kwh"),
        "voltaje",
        F.col("timestamp_lectura").alias("_at"),
        "id_staging",
    )
    return insert_ignore(t.get("fact_telemetria"), rows, ["sk_red_electrica", "sk_fecha", "sk_tiempo"], [F.col("_at"), F.col("id_staging")]).drop("_at", "id_staging")


def error_counts() -> list[Column]:
    """Totals of a batch's errors, to be aggregated or observed."""
    return [F.count("*").alias("total_huerfanos"), F.count_if(F.col("tipo_error") != "VOLTAGE_OUT_OF_RANGE").alias("total_transitorios")]


def reconcile_telemetry(t: Tables, start: datetime | None = None, end: datetime | None = None, store: Store = as_plan, near: Near | None = None) -> Tables:
    """What a batch over the pending readings changes: hechos, errores, procesados (id_staging, timestamp_lectura), contadores.

    Readings of inactive meters and negative ones are done with; readings with a voltage warning become facts but stay pending until a batch logs nothing new about them.
    """
    readings = store(pending(t["staging_telemetria"], "timestamp_lectura", start, end), "lecturas")
    near = near or (lambda name, _: t.get(name))
    days = readings.select(F.to_date("timestamp_lectura").alias("dia"))
    errors_before, facts_before = near("err_telemetria", days), near("fact_telemetria", days)
    off = inactive_readings(t, readings).withColumn("motivo_error", F.lit(INACTIVE))
    on = active_readings(t, readings)
    warned, below = voltage_warnings(on), negative_consumption(on).withColumn("motivo_error", F.lit(NEGATIVE))

    def error(rows: DataFrame, kind: str, detail: dict) -> DataFrame:
        if errors_before is not None:
            known = errors_before.filter(F.col("tipo_error") == kind).select(F.col("id_evento_origen").alias("id_staging"))
            rows = rows.join(known, "id_staging", "left_anti")
        return rows.select(F.col("id_staging").alias("id_evento_origen"), "id_medidor", F.col("timestamp_lectura").alias("timestamp_evento"), F.col("tipo_lectura").alias("tipo_evento"), F.lit(kind).alias("tipo_error"), "motivo_error", F.to_json(F.struct(*(v.alias(k) for k, v in detail.items()))).alias("detalle_tecnico"))

    c = F.col
    of_off = error(off, "MEDIDOR_INACTIVO", {"consumo_wh": c("consumo_wh"), "voltaje": c("voltaje"), "tipo_lectura": c("tipo_lectura"), "bloque": F.lit("validacion")})
    of_volts = error(warned, "VOLTAGE_OUT_OF_RANGE", {"voltaje": c("voltaje"), "rango_aceptable": F.format_string("[%.2f, %.2f]", F.lit(float(HARD_VOLTS[0])), F.lit(float(HARD_VOLTS[1]))), "rango_normal": F.format_string("[%.2f, %.2f]", F.lit(float(NORMAL_VOLTS[0])), F.lit(float(NORMAL_VOLTS[1])))})
    of_below = error(below, "CONSUMO_NEGATIVO", {"consumo_wh": c("consumo_wh"), "voltaje": c("voltaje")})
    errors = store(of_off.unionByName(of_volts).unionByName(of_below), "errores")
    gone = off.select("id_staging", "timestamp_lectura").unionByName(below.select("id_staging", "timestamp_lectura"))
    left = readings.join(gone.select("id_staging"), "id_staging", "left_anti")
    facts = store(telemetry_facts(t | {"fact_telemetria": facts_before}, left), "hechos")
    quiet = left.join(errors.select(c("id_evento_origen").alias("id_staging")), "id_staging", "left_anti").select("id_staging", "timestamp_lectura")
    n = lambda rows, name: rows.agg(F.count("*").alias(name))
    wrong = errors.agg(*error_counts())
    totals = n(readings, "total_eventos").crossJoin(n(facts, "total_hechos")).crossJoin(wrong)
    return {"hechos": facts, "errores": errors, "procesados": gone.unionByName(quiet).distinct(), "contadores": totals}
