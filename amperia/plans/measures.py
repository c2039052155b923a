"""Measures that dashboards take over the monthly indices: totals of the year so far, the same month of the year before, distance to a target, lights.

Months are numbered through the years, so what belongs to a year or lies a year back is found by number, whatever months are missing. Windows are by level of the network; a level has a row a month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..operators.versions import asof_global

c = F.col
LEVEL = ["subestacion", "circuito", "transformador"]
# Limits up to which an index is good, by month or batch.
GOOD_SAIDI, GOOD_SAIFI, GOOD_CAIDI = "60.00", "2.0000", "30.00"
GOOD_CONVERSION, GOOD_ERRORS = 85, 5
#: Times the limit up to which an index is to be watched; it is bad beyond.
WATCH = "1.5"


def light(value: Column, limit: Column) -> Column:
    """VERDE below the limit, AMARILLO up to WATCH times it, ROJO beyond; null without a value or a limit."""
    return F.when(value < limit, "VERDE").when(value <= limit * F.lit(WATCH).cast("decimal(2,1)"), "AMARILLO").when(value.isNotNull() & limit.isNotNull(), "ROJO")


def with_month(monthly: DataFrame) -> DataFrame:
    return monthly.withColumn("_month", c("anio") * 12 + c("mes") - 1)


def year_to_date(monthly: DataFrame) -> DataFrame:
    """anio, mes, the level and saidi, saifi with saidi_ytd, saifi_ytd: their sums from January on."""
    so_far = W.partitionBy(*LEVEL, "anio").orderBy("mes").rangeBetween(W.unboundedPreceding, W.currentRow)
    return monthly.select("anio", "mes", "periodo", *LEVEL, "saidi", "saifi", *(F.sum(x).over(so_far).alias(f"{x}_ytd") for x in ("saidi", "saifi")))


def year_over_year(monthly: DataFrame) -> DataFrame:
    """saidi with saidi_ly, that of the same month a year before (null if that month is missing), and variacion_ia_pct."""
    before = W.partitionBy(*LEVEL).orderBy("_month").rangeBetween(-12, -12)
    rows = with_month(monthly).withColumn("saidi_ly", F.max("saidi").over(before))
    change = ratio(((c("saidi") - c("saidi_ly")) * 10_000).cast("decimal(28,0)"), (c("saidi_ly") * 100).cast("decimal(18,0)"), 0, 2)  # both in hundredths, in percent
    return rows.select("anio", "mes", "periodo", *LEVEL, "saidi", "saidi_ly", change.alias("variacion_ia_pct"))


def against_target(monthly: DataFrame, targets: DataFrame, until: Column) -> DataFrame:
    """saidi of the city and substations with meta_saidi, the target that holds on the month's first day (targets: fecha_inicio, fecha_fin, meta_saidi), the distance to it and a light."""
    rows = monthly.filter("circuito is null").withColumn("_at", F.make_date("anio", "mes", F.lit(1)).cast("timestamp"))
    named = asof_global(rows, targets, "_at", ["meta_saidi"], until)
    return named.select("anio", "mes", "periodo", "subestacion", "saidi", "meta_saidi", (c("saidi") - c("meta_saidi")).cast("decimal(18,2)").alias("saidi_vs_meta"), light(c("saidi"), c("meta_saidi")).alias("semaforo_meta"))


def lights(monthly: DataFrame) -> DataFrame:
    """The three indices with a light each."""
    limit = lambda x, kind: F.lit(x).cast(kind)
    return monthly.select(
        "anio", "mes", "periodo", *LEVEL, "saidi", "saifi", "caidi",
        light(c("saidi"), limit(GOOD_SAIDI, "decimal(8,2)")).alias("semaforo_saidi"), light(c("saifi"), limit(GOOD_SAIFI, "decimal(8,4)")).alias("semaforo_saifi"), light(c("caidi"), limit(GOOD_CAIDI, "decimal(8,2)")).alias("semaforo_caidi"),
    )


def batch_health(monitored: DataFrame) -> DataFrame:
    """Batches of the ledger view with whether their rates are healthy."""
    return monitored.select("id_lote", "tasa_conversion_pct", "tasa_error_pct", (c("tasa_conversion_pct") > GOOD_CONVERSION).alias("conversion_saludable"), (c("tasa_error_pct") < GOOD_ERRORS).alias("errores_saludables"))
