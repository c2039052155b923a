"""Outages and readings as streams in event time: what comes out of order within the watermark's delay is placed where it belongs, state behind the watermark is dropped, and all operators run in the JVM.

Sources deliver each row once or more: rows that repeat an id do not change what comes out. Rows later than the delay are dropped by Spark. Results are in append mode: a row leaves when the watermark has passed its window, so it is final.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.pairing import AHEAD, OUTAGE, paired
from ..operators.versions import interval_join
from ..plans.outages import Tables
from ..plans.telemetry import HARD_VOLTS, ON

c = F.col


def stream_pairs(events: DataFrame, delay: str = "2 hours", most: str = "7 days") -> DataFrame:
    """The pairs of operators/pairing.py of a stream of events (id_medidor, timestamp_evento, id_evento, tipo_evento).

    Each outage is joined with the later events of its meter up to most later, of which the first decides; an outage that nothing follows in that time comes out open when the watermark has passed it. The watermark follows the outages of all meters: Spark filters before it looks at times. Events of a meter that are further apart are not paired. State: events younger than most and the delay.
    """
    rows = events.select("id_medidor", "timestamp_evento", "id_evento", "tipo_evento")
    start = rows.filter(c("tipo_evento") == OUTAGE).withWatermark("timestamp_evento", delay)
    after = rows.select(c("id_medidor").alias("_meter"), *(c(x).alias(f"sig_{x}") for x in AHEAD)).withWatermark("sig_timestamp_evento", delay)
    later = (c("sig_timestamp_evento") > c("timestamp_evento")) | ((c("sig_timestamp_evento") == c("timestamp_evento")) & (c("sig_id_evento") > c("id_evento")))
    within = (c("sig_timestamp_evento") >= c("timestamp_evento")) & (c("sig_timestamp_evento") <= c("timestamp_evento") + F.expr(f"interval {most}"))
    joined = start.join(after, (c("id_medidor") == c("_meter")) & within & later, "left_outer")
    # The first event after an outage is never an orphan, so orphans need not leave before.
    # Times go on as numbers: of the windowed rows the window alone is event time.
    time = F.unix_micros("sig_timestamp_evento").alias("_sig_us")
    nearest = F.min_by(F.struct("sig_tipo_evento", "sig_id_evento", time), F.struct(time, "sig_id_evento"))
    first = joined.groupBy(F.window("timestamp_evento", "1 hour"), "id_medidor", "id_evento", F.unix_micros("timestamp_evento").alias("_us"), "tipo_evento").agg(nearest.alias("_sig"))
    return paired(first.select("id_medidor", "id_evento", F.timestamp_micros("_us").alias("timestamp_evento"), "tipo_evento", "_sig.sig_tipo_evento", "_sig.sig_id_evento", F.timestamp_micros("_sig._sig_us").alias("sig_timestamp_evento")))


def stream_readings(readings: DataFrame, t: Tables, delay: str = "2 hours") -> DataFrame:
    """Hourly facts of a stream of readings: for each network version and hour the first good reading by time, then id, as in the batch. State: the open hours of active meters, a row each. t: dimensions, read anew in each micro-batch where their source is."""
    good = readings.filter(c("voltaje").between(*HARD_VOLTS) & (c("consumo_wh") >= 0)).withWatermark("timestamp_lectura", delay)
    red = t["dim_red_electrica"].select("id_medidor_origen", "sk_red_electrica", "sk_geografia_urbana", "fecha_inicio", "fecha_fin", "activo_bool")
    placed = interval_join(good, red, ON, "timestamp_lectura")
    value = F.struct("sk_geografia_urbana", "tipo_lectura", "consumo_wh", "voltaje")
    hours = placed.groupBy(F.window("timestamp_lectura", "1 hour").alias("_hour"), "sk_red_electrica").agg(F.min_by(value, F.struct("timestamp_lectura", "id_staging")).alias("_v"))
    at = hours.withColumns({"timestamp_lectura": c("_hour.start"), "fecha": F.to_date("_hour.start"), "hora": F.hour("_hour.start")}).select("*", "_v.*")
    kinds = t["dim_tipo_evento"].select(c("codigo_evento").alias("tipo_lectura"), "sk_tipo_evento")
    keyed = at.join(t["dim_fecha"].select("fecha", "sk_fecha"), "fecha").join(t["dim_tiempo"].select("hora", "sk_tiempo"), "hora").join(kinds, "tipo_lectura", "left")
    kwh = F.round(c("consumo_wh") / 1000, 4).cast("decimal(12,4)")
    return keyed.select("sk_fecha", "sk_tiempo", "sk_red_electrica", "sk_geografia_urbana", F.coalesce("sk_tipo_evento", F.lit(-1)).cast("long").alias("sk_tipo_evento"), "timestamp_lectura", kwh.alias("consumo_kwh"), "voltaje")


def daily_readings(readings: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Sums by day and meter of a stream of readings, each id counted once: repeats that come within the delay are dropped by what state remembers."""
    once = readings.withWatermark("timestamp_lectura", delay).dropDuplicatesWithinWatermark(["id_staging"])
    g = once.groupBy(F.window("timestamp_lectura", "1 day").alias("_day"), "id_medidor").agg(F.count("*").alias("n"), F.sum("consumo_wh").alias("consumo_wh"), F.min("voltaje").alias("vlo"), F.max("voltaje").alias("vhi"))
    return g.select(F.to_date("_day.start").alias("fecha"), "id_medidor", "n", "consumo_wh", "vlo", "vhi")
