"""Generated dimensions: days and hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def dim_fecha(spark: SparkSession, first: str = "2024-01-01", last: str = "2026-12-31") -> DataFrame:
    """One row a day, keys from 1."""
    days = spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}', INTERVAL 1 DAY)) AS fecha")
    c = F.col("fecha")
    number = F.weekday(c) + 1
    return days.select(
        (F.date_diff(c, F.lit(first).cast("date")) + 1).cast("long").alias("sk_fecha"),
        c,
        F.day(c).alias("dia"),
        F.date_format(c, "EEEE").alias("dia_semana"),
        number.alias("dia_semana_num"),
        F.weekofyear(c).alias("semana_anio"),
        F.month(c).alias("mes"),
        F.date_format(c, "MMMM").alias("nombre_mes"),
        F.quarter(c).alias("trimestre"),
        F.year(c).alias("anio"),
        (number >= 6).alias("es_fin_semana"),
        F.lit(False).alias("es_feriado"),
    )


def hour_band(hour: Column) -> Column:
    """The band of dim_tiempo."""
    return F.when(hour <= 5, "Madrugada").when(hour <= 11, "Manana").when(hour <= 17, "Tarde").when(hour <= 22, "Pico").otherwise("Noche")


def heatmap_band(hour: Column) -> Column:
    """The heatmap's own band: no early morning, other spelling."""
    return F.when(hour.between(6, 11), "Mañana").when(hour.between(12, 17), "Tarde").when(hour.between(18, 22), "Pico").otherwise("Noche")


def dim_tiempo(spark: SparkSession) -> DataFrame:
    """One row an hour, keys from 1."""
    hours = spark.range(24).select((F.col("id") + 1).alias("sk_tiempo"), F.col("id").cast("int").alias("hora"))
    return hours.withColumn("franja_horaria", hour_band(F.col("hora")))
