"""Daily sums of facts that batches add to and views read: partial states, several for one day and member, that add up to it.

A state holds counts, sums and extremes, so states of different batches merge by adding and comparing. Facts that get flagged leave by a state of opposite sign; extremes are kept for readings only, which are never flagged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col
OUTAGES, READINGS = "sum_interrupciones", "sum_telemetria"
#: The facts that a table of states is made from.
FACTS = {OUTAGES: "fact_interrupciones", READINGS: "fact_telemetria"}


def dated(rows: DataFrame, at: str) -> DataFrame:
    """rows with _dia, the day that they are filed under: of the folders, where they are read from such."""
    return rows if "_dia" in rows.columns else rows.withColumn("_dia", F.to_date(at))


def of_outages(facts: DataFrame, sign: int = 1) -> DataFrame:
    """States of facts that are not flagged, by day, network version, inventory version and type; hasta is the last start."""
    held = dated(facts.filter(~c("excluido_med")), "timestamp_inicio")
    g = held.groupBy(c("_dia").alias("fecha"), "sk_red_electrica", "sk_clientes", "sk_tipo_evento").agg(
        F.count("*").alias("n"), F.sum("duracion_minutos").alias("d"), F.sum(c("duracion_minutos") * c("clientes_afectados")).alias("m"), F.sum("clientes_afectados").alias("k"), F.max("timestamp_inicio").alias("hasta")
    )
    return g.withColumns({x: sign * c(x) for x in ("n", "d", "m", "k")}) if sign != 1 else g


def of_readings(facts: DataFrame) -> DataFrame:
    v = c("voltaje")
    return dated(facts, "timestamp_lectura").groupBy(c("_dia").alias("fecha"), "sk_red_electrica", "sk_geografia_urbana").agg(
        F.count("*").alias("n"), F.sum("consumo_kwh").alias("s"), F.max("consumo_kwh").alias("hi"), F.min("consumo_kwh").alias("lo"), F.sum(v).alias("vs"), F.sum(v * v).alias("vq"), F.min(v).alias("vlo"), F.max(v).alias("vhi")
    )


OF: dict[str, Callable[[DataFrame], DataFrame]] = {OUTAGES: of_outages, READINGS: of_readings}


def states(t: dict[str, DataFrame], name: str) -> DataFrame:
    """The states kept in t, with _dia, or else those of its facts."""
    return dated(t[name], "fecha") if name in t else OF[name](t[FACTS[name]]).withColumn("_dia", c("fecha"))


def merged(rows: DataFrame) -> DataFrame:
    """One state for each key."""
    outages = "hasta" in rows.columns
    keys = ["fecha", "sk_red_electrica", "sk_clientes", "sk_tipo_evento"] if outages else ["fecha", "sk_red_electrica", "sk_geografia_urbana"]
    how = {"hasta": F.max, "hi": F.max, "vhi": F.max, "lo": F.min, "vlo": F.min}
    return rows.groupBy(*keys).agg(*(how.get(x, F.sum)(x).alias(x) for x in rows.columns if x not in (*keys, "_dia")))
