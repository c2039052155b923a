"""Types and constraints of all tables; Spark enforces neither keys nor checks, so violations() looks for them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DDL = {
    "staging_eventos": "id_evento long not null, id_medidor long not null, timestamp_evento timestamp not null, tipo_evento string not null, procesado boolean not null, fecha_carga timestamp",
    "staging_telemetria": "id_staging long not null, id_medidor long not null, timestamp_lectura timestamp not null, consumo_wh decimal(12,2) not null, voltaje decimal(8,2) not null, tipo_lectura string not null, procesado boolean not null, fecha_carga timestamp, id_lote_procesamiento long",
    "dim_fecha": "sk_fecha long not null, fecha date not null, dia int not null, dia_semana string not null, dia_semana_num int not null, semana_anio int not null, mes int not null, nombre_mes string not null, trimestre int not null, anio int not null, es_fin_semana boolean not null, es_feriado boolean not null",
    "dim_tiempo": "sk_tiempo long not null, hora int not null, franja_horaria string not null",
    "dim_geografia_urbana": "sk_geografia_urbana long not null, sector_urbano string not null, distrito string not null, latitud decimal(9,6), longitud decimal(9,6), nivel_criticidad string not null, fecha_actualizacion timestamp",
    "dim_red_electrica": "sk_red_electrica long not null, id_medidor long not null, id_medidor_origen long not null, codigo_medidor string not null, transformador string not null, circuito string not null, subestacion string not null, sk_geografia_urbana long, capacidad_kva decimal(10,2), estado_operativo string not null, fecha_inicio timestamp not null, fecha_fin timestamp, activo_bool boolean not null, fecha_actualizacion timestamp",
    "dim_clientes_inventario": "sk_clientes long not null, total_clientes_servidos int not null, fecha_inicio timestamp not null, fecha_fin timestamp, activo_bool boolean not null, version int not null, fecha_actualizacion timestamp",
    "dim_tipo_evento": "sk_tipo_evento long not null, codigo_evento string not null, categoria string not null, severidad string not null, es_critico boolean not null, descripcion string, regla_vigencia_desde timestamp, regla_vigencia_hasta timestamp",
    "fact_interrupciones": "sk_interrupcion long not null, sk_fecha long not null, sk_tiempo long not null, sk_red_electrica long not null, sk_geografia_urbana long not null, sk_clientes long not null, sk_tipo_evento long not null, id_medidor long not null, timestamp_inicio timestamp not null, timestamp_fin timestamp, duracion_minutos decimal(10,2), clientes_afectados int not null, id_lote_procesamiento int, excluido_med boolean not null, fecha_procesamiento timestamp",
    "fact_telemetria": "sk_telemetria long not null, sk_fecha long not null, sk_tiempo long not null, sk_red_electrica long not null, sk_geografia_urbana long not null, sk_tipo_evento long not null, timestamp_lectura timestamp not null, consumo_kwh decimal(12,4) not null, voltaje decimal(8,2) not null, id_lote_procesamiento long",
    "err_telemetria": "id_error long not null, id_evento_origen long, id_medidor long, timestamp_evento timestamp, tipo_evento string, tipo_error string not null, motivo_error string not null, detalle_tecnico string, id_lote_procesamiento int, fecha_deteccion timestamp not null, resuelto boolean not null, fecha_resolucion timestamp",
    "sum_interrupciones": "fecha date, sk_red_electrica long, sk_clientes long, sk_tipo_evento long, n long, d decimal(28,2), m decimal(28,2), k long, hasta timestamp",
    "sum_telemetria": "fecha date, sk_red_electrica long, sk_geografia_urbana long, n long, s decimal(28,4), hi decimal(12,4), lo decimal(12,4), vs decimal(28,2), vq decimal(28,4), vlo decimal(8,2), vhi decimal(8,2)",
    "ctrl_lotes_procesamiento": "id_lote int not null, fecha_inicio timestamp, fecha_fin timestamp, total_eventos int not null, total_hechos int not null, total_huerfanos int not null, total_transitorios int not null, estado string not null, fecha_ejecucion timestamp not null, duracion_segundos decimal(10,2)",
}
_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType()}


def _column(text: str) -> T.StructField:
    name, kind, *rest = text.split(" ")
    size = kind.removeprefix("decimal(").removesuffix(")").split(",")
    return T.StructField(name, T.DecimalType(*map(int, size)) if kind.startswith("decimal") else _TYPES[kind], not rest)


SCHEMAS: dict[str, T.StructType] = {table: T.StructType([_column(x) for x in columns.split(", ")]) for table, columns in _DDL.items()}

# Codes that the tables may hold.
EVENT_TYPES = ("POWER_OUTAGE", "POWER_RESTORATION", "VOLTAGE_SPIKE", "VOLTAGE_SAG", "HEARTBEAT", "UNKNOWN")
READING_TYPES = ("LECTURA_PERIODICA", "LECTURA_EVENTO", "HEARTBEAT")
CRITICALITY = ("CRITICO", "ALTO", "MEDIO", "NORMAL", "BAJO")
SEVERITY = ("BAJA", "MEDIA", "ALTA", "CRITICA", "DESCONOCIDA")
BATCH_STATES = ("INICIADO", "COMPLETADO", "FALLIDO", "REVERTIDO")
#: The event catalogue: key, code, category, severity, critical.
EVENT_CATALOGUE = (
    (-1, "UNKNOWN", "DESCONOCIDO", "DESCONOCIDA", False),
    (1, "POWER_OUTAGE", "INTERRUPCION", "ALTA", True),
    (2, "POWER_RESTORATION", "INTERRUPCION", "MEDIA", False),
    (3, "VOLTAGE_SPIKE", "FLUCTUACION", "ALTA", True),
    (4, "VOLTAGE_SAG", "FLUCTUACION", "MEDIA", False),
    (5, "HEARTBEAT", "TELEMETRIA", "BAJA", False),
    (6, "LECTURA_PERIODICA", "TELEMETRIA", "BAJA", False),
)

UNIQUE = {
    "staging_eventos": ["id_evento"], "staging_telemetria": ["id_staging"], "dim_fecha": ["fecha"], "dim_tiempo": ["hora"], "dim_geografia_urbana": ["sk_geografia_urbana"],
    "dim_red_electrica": ["sk_red_electrica"], "dim_clientes_inventario": ["sk_clientes"], "dim_tipo_evento": ["codigo_evento"], "fact_interrupciones": ["sk_interrupcion"],
    "fact_telemetria": ["sk_red_electrica", "sk_fecha", "sk_tiempo"], "err_telemetria": ["id_error"], "ctrl_lotes_procesamiento": ["id_lote"],
}


def checks(table: str) -> dict[str, Column]:
    """Conditions that every row must meet, by name."""
    c = F.col
    valid = c("fecha_fin").isNull() | (c("fecha_fin") > c("fecha_inicio")) if table.startswith("dim_") else F.lit(True)
    return {
        "staging_eventos": {"tipo_evento": c("tipo_evento").isin(*EVENT_TYPES)},
        "staging_telemetria": {"tipo_lectura": c("tipo_lectura").isin(*READING_TYPES), "voltaje": c("voltaje").between(0, 1000)},
        "dim_fecha": {"dia": c("dia").between(1, 31), "dia_semana_num": c("dia_semana_num").between(1, 7), "semana_anio": c("semana_anio").between(1, 53), "mes": c("mes").between(1, 12), "trimestre": c("trimestre").between(1, 4)},
        "dim_tiempo": {"hora": c("hora").between(0, 23)},
        "dim_geografia_urbana": {"nivel_criticidad": c("nivel_criticidad").isin(*CRITICALITY)},
        "dim_clientes_inventario": {"vigencia": valid},
        "dim_tipo_evento": {"severidad": c("severidad").isin(*SEVERITY)},
        "fact_interrupciones": {"fin": c("timestamp_fin").isNull() | (c("timestamp_fin") > c("timestamp_inicio")), "clientes": c("clientes_afectados") >= 1},
        "fact_telemetria": {"voltaje": c("voltaje").between(0, 1000), "consumo": c("consumo_kwh") >= 0},
        "ctrl_lotes_procesamiento": {"estado": c("estado").isin(*BATCH_STATES)},
    }.get(table, {})


def violations(table: str, df: DataFrame) -> DataFrame:
    """constraint and n of every constraint of a table that rows break: not null, checks, unique."""
    schema = SCHEMAS[table]
    tests = {f"not null {f.name}": F.col(f.name).isNotNull() for f in schema if not f.nullable and f.name in df.columns} | {f"check {k}": v for k, v in checks(table).items()}
    counted = df.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in tests.items()))
    broken = counted.select(F.explode(F.create_map(*(x for name in tests for x in (F.lit(name), F.col(f"`{name}`"))))).alias("constraint", "n"))
    twice = df.groupBy(*UNIQUE[table]).count().filter("count > 1").agg(F.count("*").alias("n")).select(F.lit("unique").alias("constraint"), "n")
    return broken.unionByName(twice).filter("n > 0")


def orphan_keys(fact: DataFrame, dims: Mapping[str, DataFrame]) -> DataFrame:
    """fk and n of fact rows whose dimension key has no row."""
    found = None
    for key, dim in dims.items():
        lost = fact.join(dim.select(key), key, "left_anti").agg(F.count("*").alias("n")).select(F.lit(key).alias("fk"), "n")
        found = lost if found is None else found.unionByName(lost)
    return found.filter("n > 0")


def overlapping_versions(df: DataFrame, key: str | None = None) -> DataFrame:
    """Pairs of versions of a slowly changing dimension that are valid at once: an interval ends after the next begins."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*([key] if key else [])).orderBy("fecha_inicio")
    return df.withColumn("_next", F.lead("fecha_inicio").over(w)).filter(F.col("_next") < F.coalesce("fecha_fin", F.lit("9999-12-31").cast("timestamp"))).drop("_next")
