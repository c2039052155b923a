"""The generic test tables (events, customers, orders) read as the grid's tables, by the same rules as oracle.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import dim_fecha, dim_tiempo
from .schemas import EVENT_CATALOGUE

CALENDAR = ("1995-01-01", "2026-12-31")
EVENT_OF = {"error": "POWER_OUTAGE", "purchase": "POWER_RESTORATION", "signup": "VOLTAGE_SPIKE", "view": "VOLTAGE_SAG", "click": "HEARTBEAT"}
c = F.col


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staging_eventos(spark: SparkSession, sf_dir: str, power_only: bool = True) -> DataFrame:
    events = table(spark, sf_dir, "events")
    if power_only:
        events = events.filter(c("event_type").isin("error", "purchase"))
    kind = F.coalesce(*(F.when(c("event_type") == k, v) for k, v in EVENT_OF.items()), F.lit("UNKNOWN"))
    return events.select(c("event_id").alias("id_evento"), c("user_id").alias("id_medidor"), c("ts").cast("timestamp").alias("timestamp_evento"), kind.alias("tipo_evento"), F.lit(False).alias("procesado"), F.lit(None).cast("timestamp").alias("fecha_carga"))


def dim_geografia(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(F.broadcast(region), c("n_regionkey") == c("r_regionkey")).select((c("n_nationkey") + 1).cast("long").alias("sk_geografia_urbana"), c("n_name").alias("sector_urbano"), c("r_name").alias("distrito"), F.lit("NORMAL").alias("nivel_criticidad"))


def dim_red(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of every tenth meter, one of the others; every fortieth meter is missing."""
    nation = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), c("n_regionkey") == c("r_regionkey"))
    k = c("c_custkey")
    customers = table(spark, sf_dir, "customer").filter(k % 40 != 3).join(F.broadcast(nation), c("c_nationkey") == c("n_nationkey"))
    split = k % 10 == 0
    first = F.struct((2 * k + 1).alias("sk"), F.lit("1995-01-01").cast("timestamp").alias("ini"), F.when(split, F.lit("1998-01-01").cast("timestamp")).alias("fin"))
    second = F.struct((2 * k + 2).alias("sk"), F.lit("1998-01-01").cast("timestamp").alias("ini"), F.lit(None).cast("timestamp").alias("fin"))
    versions = customers.withColumn("v", F.explode(F.when(split, F.array(first, second)).otherwise(F.array(first))))
    return versions.select(
        c("v.sk").alias("sk_red_electrica"), k.alias("id_medidor"), k.alias("id_medidor_origen"), F.concat(F.lit("MED-"), k).alias("codigo_medidor"), c("c_mktsegment").alias("transformador"), c("n_name").alias("circuito"), c("r_name").alias("subestacion"),
        (c("n_nationkey") + 1).cast("long").alias("sk_geografia_urbana"), c("v.ini").alias("fecha_inicio"), c("v.fin").alias("fecha_fin"), (k % 25 != 7).alias("activo_bool"),
    )


def dim_clientes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").agg(F.count("*").alias("n"))
    day = lambda x: F.lit(x).cast("timestamp")
    versions = F.array(
        F.struct(F.lit(1).cast("long").alias("sk_clientes"), c("n").cast("int").alias("total_clientes_servidos"), day("1995-01-01").alias("fecha_inicio"), day("2024-01-16").alias("fecha_fin"), F.lit(False).alias("activo_bool"), F.lit(1).alias("version")),
        F.struct(F.lit(2).cast("long").alias("sk_clientes"), F.expr("int(n + n div 10)").alias("total_clientes_servidos"), day("2024-01-16").alias("fecha_inicio"), day(None).alias("fecha_fin"), F.lit(True).alias("activo_bool"), F.lit(2).alias("version")),
    )
    return n.select(F.inline(versions))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SAIDI to be met, one version for 60 days from each nation, the last one open; one is missing."""
    k = c("n_nationkey").cast("int")
    start = F.lit("2023-06-01").cast("timestamp") + F.make_interval(days=60 * k)
    rows = table(spark, sf_dir, "nation").filter(k != 9).withColumn("_from", start)
    return rows.select(c("_from").alias("fecha_inicio"), F.when(k < 24, c("_from") + F.make_interval(days=F.lit(60))).alias("fecha_fin"), ((k % 7 + 1) * 4).cast("decimal(8,2)").alias("meta_saidi"))


def dim_tipo(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EVENT_CATALOGUE), "sk_tipo_evento long, codigo_evento string, categoria string, severidad string, es_critico boolean")


def staging_telemetria(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("o_orderkey")
    kind = F.when(c("o_orderpriority").startswith("1-"), "LECTURA_EVENTO").when(c("o_orderpriority").startswith("5-"), "HEARTBEAT").otherwise("LECTURA_PERIODICA")
    wh = c("o_totalprice").cast("decimal(12,2)")
    return table(spark, sf_dir, "orders").select(
        k.alias("id_staging"), c("o_custkey").alias("id_medidor"), (c("o_orderdate").cast("timestamp") + F.make_interval(hours=(k % 24).cast("int"))).alias("timestamp_lectura"),
        F.when(k % 97 == 0, -wh).otherwise(wh).cast("decimal(12,2)").alias("consumo_wh"), (170 + k % 101).cast("decimal(8,2)").alias("voltaje"), kind.alias("tipo_lectura"), F.lit(False).alias("procesado"),
        F.lit(None).cast("timestamp").alias("fecha_carga"), F.lit(None).cast("long").alias("id_lote_procesamiento"),
    )


def tables(spark: SparkSession, sf_dir: str, power_only: bool = True) -> dict[str, DataFrame]:
    """Staging and dimensions, before any batch."""
    return {
        "staging_eventos": staging_eventos(spark, sf_dir, power_only),
        "staging_telemetria": staging_telemetria(spark, sf_dir),
        "dim_fecha": dim_fecha(spark, *CALENDAR),
        "dim_tiempo": dim_tiempo(spark),
        "dim_geografia_urbana": dim_geografia(spark, sf_dir),
        "dim_red_electrica": dim_red(spark, sf_dir),
        "dim_clientes_inventario": dim_clientes(spark, sf_dir),
        "dim_tipo_evento": dim_tipo(spark),
    }
