"""Events from outside, as JSON lines: good rows go to staging, each bad one is logged once.

Lines are read permissively: what is not JSON stays as text. A line is bad if it is not JSON, lacks a field, has one that is not of its type, or an unknown event type. The error row's id is a hash of the line, so a line that is read again is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.schemas import EVENT_TYPES

c = F.col
FIELDS = {"id_evento": "long", "id_medidor": "long", "timestamp_evento": "timestamp", "tipo_evento": "string"}
#: The type of error that bad lines are logged under.
BAD_LINE = "EVENTO_MALFORMADO"


def lines(spark: SparkSession, at: str, stream: bool = False) -> DataFrame:
    """linea: the lines of text files, at rest or as a stream of files."""
    return (spark.readStream if stream else spark.read).format("text").load(at).withColumnRenamed("value", "linea")


def _why() -> Column:
    """What is wrong with a line, null if nothing."""
    why = F.when(c("_mal").isNotNull(), F.lit("JSON ilegible"))
    for name in FIELDS:
        why = why.when(c(f"_de.{name}").isNull(), f"falta {name}").when(c(name).isNull(), f"{name} no es válido")
    return why.when(~c("tipo_evento").isin(*EVENT_TYPES), "tipo_evento desconocido")


def parsed(rows: DataFrame) -> DataFrame:
    """linea, the fields with their types and motivo_error; blank lines are left out."""
    text = ", ".join(f"{name} string" for name in FIELDS)
    read = rows.filter(F.trim("linea") != "").withColumn("_de", F.from_json("linea", f"{text}, _mal string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_mal"}))
    typed = read.select("linea", "_de", c("_de._mal").alias("_mal"), *(c(f"_de.{name}").try_cast(kind).alias(name) for name, kind in FIELDS.items()))
    return typed.withColumn("motivo_error", _why()).select("linea", *FIELDS, "motivo_error")


def good(rows: DataFrame) -> DataFrame:
    """Rows for staging_eventos."""
    return rows.filter(c("motivo_error").isNull()).select(*FIELDS, F.lit(False).alias("procesado"), F.current_timestamp().alias("fecha_carga"))


def bad(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rows for err_telemetria, one for each bad line that known errors don't have."""
    wrong = rows.filter(c("motivo_error").isNotNull()).withColumn("id_evento_origen", F.xxhash64("linea")).dropDuplicates(["id_evento_origen"])
    if known is not None:
        wrong = wrong.join(known.filter(c("tipo_error") == BAD_LINE).select("id_evento_origen"), "id_evento_origen", "left_anti")
    detail = F.to_json(F.struct(c("linea")))
    return wrong.select("id_evento_origen", "id_medidor", "timestamp_evento", "tipo_evento", F.lit(BAD_LINE).alias("tipo_error"), F.concat(F.lit("EVENTO_MALFORMADO: "), "motivo_error").alias("motivo_error"), detail.alias("detalle_tecnico"), F.current_timestamp().alias("fecha_deteccion"), F.lit(False).alias("resuelto"))
