"""Reliability and quality views: lazy DataFrames over the star schema.

Views read daily sums of facts (sums.py), which a warehouse keeps and which are otherwise formed first. Sums meet the calendar by the day that they are filed under, so a filter on fecha reaches the folders that are read. Coarser levels are formed from sums at the finest one; their rows are known by nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.calendar import heatmap_band
from ..functions.numeric import ratio
from ..operators.changes import update
from ..operators.versions import all_that_hold, last_day
from .outages import Store, Tables, as_plan
from .sums import OUTAGES, READINGS, states

c = F.col
DECIMAL = "decimal(28,2)"


def _levels(rows: DataFrame, fixed: list[str], drill: list[str], *aggs: Column) -> DataFrame:
    """Sums at every level from fixed plus all of drill up to fixed alone. Levels are rows made from each row, not grouping sets, which a filter on fixed would not pass."""
    name = lambda x, k, i: (c(x) if i < k else F.lit(None).cast(rows.schema[x].dataType)).alias(x)
    levels = [F.struct(F.lit(k).alias("_level"), *(name(x, k, i) for i, x in enumerate(drill))) for k in range(len(drill), -1, -1)]
    kept = [x for x in rows.columns if x not in drill]
    return rows.select(*kept, F.inline(F.array(*levels))).groupBy(*fixed, "_level", *drill).agg(*aggs).drop("_level")


def saidi_diario(t: Tables, active_only: bool = True) -> DataFrame:
    """Every day of the calendar, by event category: interruptions, customer minutes, SAIDI, SAIFI. Flagged major event days are left out.

    active_only: the denominator's inventory version must also be active, not only valid on the day.
    """
    f = states(t, OUTAGES).groupBy("_dia", "sk_tipo_evento").agg(F.sum("n").alias("n"), F.sum("m").cast(DECIMAL).alias("m")).filter("n > 0")
    inventory = t["dim_clientes_inventario"].filter("activo_bool") if active_only else t["dim_clientes_inventario"]
    calendar = t["dim_fecha"].select("anio", "mes", "nombre_mes", "trimestre", "dia", "fecha")
    day = calendar.join(f, c("fecha") == c("_dia"), "left").join(t["dim_tipo_evento"].select("sk_tipo_evento", "categoria", "severidad", "es_critico"), "sk_tipo_evento", "left")
    joined = all_that_hold(day.withColumn("_at", c("fecha").cast("timestamp")), inventory, "_at", ["total_clientes_servidos"], last_day(t["dim_fecha"]))
    out = joined.groupBy("anio", "mes", "nombre_mes", "trimestre", "dia", "fecha", "categoria", "severidad", "es_critico").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_interrupciones"), F.coalesce(F.sum("m"), F.lit(0)).cast(DECIMAL).alias("suma_minutos_cliente"), F.max("total_clientes_servidos").alias("total_clientes_servidos")
    )
    share = lambda x, scale: F.coalesce(ratio(x, c("total_clientes_servidos"), scale, 4), F.lit(0))
    return out.withColumns({"saidi_diario": share(c("suma_minutos_cliente"), 2), "saifi_diario": share(c("total_interrupciones"), 0)})


def umbral_med(daily: DataFrame, beta: float = 2.5) -> DataFrame:
    """One row: the threshold of major event days, from the logarithms of the rows with interruptions; 0 where they do not vary."""
    logs = daily.filter("saidi_diario > 0").select(F.log(c("saidi_diario").cast("double") + 0.0001).alias("x"))
    s = logs.agg(F.avg("x").alias("a"), F.stddev_pop("x").alias("b"))
    # Equal values may leave a spread that is only rounding of doubles.
    return s.select(F.when(c("b").isNull() | (c("b") < 1e-12), 0).otherwise(F.round(F.exp(c("a") + beta * c("b")), 2)).cast("decimal(18,2)").alias("umbral_med"))


def saidi_con_med(t: Tables, beta: float = 2.5, store: Store = as_plan, **how: bool) -> DataFrame:
    """The daily view with the threshold. A store keeps the daily sums (rows of the calendar), which both need."""
    daily = store(saidi_diario(t, **how), "saidi-diario")
    return daily.crossJoin(F.broadcast(umbral_med(daily, beta))).withColumn("es_med", c("saidi_diario") > c("umbral_med"))


def med_dates(t: Tables, beta: float = 2.5, **how: object) -> DataFrame:
    """fecha of the days with a row above the threshold."""
    return saidi_con_med(t, beta, **how).filter("saidi_diario > 0").groupBy("fecha").agg(F.bool_or("es_med").alias("es_med")).filter("es_med").select("fecha")


def saidi_mensual(t: Tables, beta: float = 2.5, **how: object) -> DataFrame:
    """Monthly indices at four levels of the network, without major event days, and when they were asked for."""
    days = t["dim_fecha"].join(F.broadcast(med_dates(t, beta, **how)), "fecha", "left_anti")  # days of the calendar at most
    f = states(t, OUTAGES).groupBy("_dia", "sk_red_electrica", "sk_clientes").agg(*(F.sum(x).alias(x) for x in "ndmk")).filter("n > 0")
    month = ["anio", "mes", "nombre_mes", "trimestre", "periodo"]
    drill = ["subestacion", "circuito", "transformador"]
    red = t["dim_red_electrica"].select("sk_red_electrica", *drill)
    ci = t["dim_clientes_inventario"].select("sk_clientes", "total_clientes_servidos")
    named = f.join(F.broadcast(days.select("fecha", *month[:4])), c("_dia") == c("fecha")).join(red, "sk_red_electrica").join(ci, "sk_clientes", "left")
    named = named.withColumn("periodo", F.concat(F.lpad(c("anio").cast("string"), 4, "0"), F.lit("-"), F.lpad(c("mes").cast("string"), 2, "0")))
    fine = named.groupBy(*month, *drill).agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.sum("m").alias("m"), F.sum("k").alias("k"), F.max("total_clientes_servidos").alias("tot"))
    out = _levels(
        fine, month, drill,
        F.sum("n").alias("total_interrupciones"), F.coalesce(F.sum("d"), F.lit(0)).cast(DECIMAL).alias("suma_duracion_minutos"), F.coalesce(F.sum("m"), F.lit(0)).cast(DECIMAL).alias("suma_minutos_cliente"),
        F.coalesce(F.sum("k"), F.lit(0)).alias("total_clientes_afectados"), F.coalesce(F.max("tot"), F.lit(0)).alias("total_clientes_servidos"),
    )
    zero = lambda x: F.coalesce(x, F.lit(0))
    return out.withColumns({
        "saidi": zero(ratio(c("suma_minutos_cliente"), c("total_clientes_servidos"), 2, 2)),
        "saifi": zero(ratio(c("total_clientes_afectados"), c("total_clientes_servidos"), 0, 4)),
        "caidi": zero(ratio(c("suma_duracion_minutos"), c("total_interrupciones"), 2, 2)),
        "fecha_consulta": F.current_timestamp(),
    })


def _latest(t: Tables) -> DataFrame:
    last = states(t, OUTAGES).agg(F.max("hasta").alias("_last")) if OUTAGES in t else t["fact_interrupciones"].agg(F.max("timestamp_inicio").alias("_last"))
    return last.select(F.coalesce("_last", F.current_timestamp()).alias("_last"))


def tendencia(t: Tables, beta: float = 2.5, city_level_only: bool = False, **how: object) -> DataFrame:
    """City trend by month, from 24 months before the last interruption, and the change against the month before that is present.

    All levels of the monthly view are summed, as its consumers expect (so totals count each interruption once a level); city_level_only takes the city's own rows.
    """
    monthly = saidi_mensual(t, beta, **how)
    if city_level_only:
        monthly = monthly.filter("subestacion is null")
    first = _latest(t).select(F.expr("date_format(_last - interval 24 months, 'yyyyMM')").cast("int").alias("_first"))
    span = monthly.crossJoin(F.broadcast(first)).filter("anio * 100 + mes >= _first")
    g = span.groupBy("anio", "mes", "nombre_mes", "trimestre", "periodo").agg(
        F.sum("total_interrupciones").alias("total_interrupciones"), F.sum("total_clientes_afectados").alias("total_clientes_afectados"), F.sum("suma_minutos_cliente").alias("_m"), F.max("total_clientes_servidos").alias("_tot")
    )
    line = W.orderBy("anio", "mes")  # at most 25 rows
    x = c("_m").cast("double") / F.nullif(c("_tot"), F.lit(0))
    before = F.lag("_x").over(line)
    return g.withColumn("_x", x).select(
        "anio", "mes", "nombre_mes", "trimestre", "periodo", (c("anio") * 100 + c("mes")).cast("int").alias("periodo_orden"), "total_interrupciones", "total_clientes_afectados",
        ratio(c("_m"), c("_tot"), 2, 2).alias("saidi_ciudad"), ratio(c("total_clientes_afectados"), c("_tot"), 0, 4).alias("saifi_ciudad"),
        F.round((c("_x") - before) / F.nullif(before, F.lit(0.0)) * 100, 2).cast("decimal(18,2)").alias("variacion_saidi_pct"),
    )


def ranking(t: Tables, beta: float = 2.5, **how: object) -> DataFrame:
    """Substations of the last interruption's year by the sum of their monthly SAIDI over all levels below the city, against the mean of all such rows. Ties by name."""
    year = _latest(t).select(F.year("_last").alias("_year"))
    rows = saidi_mensual(t, beta, **how).filter("subestacion is not null").crossJoin(F.broadcast(year)).filter("anio = _year")
    mean = lambda name, scale, places: ratio(F.sum(name).cast("decimal(28,4)"), F.count(name), 4, places)
    g = rows.groupBy("subestacion").agg(
        F.sum("saidi").alias("_sum"), F.count("*").alias("_n"), F.countDistinct("periodo").alias("meses_con_datos"), mean("saidi", 2, 2).alias("saidi_promedio"), mean("saifi", 4, 4).alias("saifi_promedio"), mean("caidi", 2, 2).alias("caidi_promedio"),
        F.sum("total_interrupciones").alias("total_interrupciones_acum"),
    )
    city = W.partitionBy()  # one row a substation
    g = g.withColumn("saidi_promedio_ciudad", ratio(F.sum("_sum").over(city).cast("decimal(28,4)"), F.sum("_n").over(city), 4, 2))
    over = lambda times: c("_sum").cast("decimal(28,2)") > c("saidi_promedio_ciudad") * c("_n") * F.lit(times).cast("decimal(2,1)")
    return g.select(
        F.row_number().over(W.orderBy(c("_sum").desc(), "subestacion")).alias("ranking"), "subestacion", "meses_con_datos", "saidi_promedio", "saifi_promedio", "caidi_promedio", "total_interrupciones_acum", "saidi_promedio_ciudad",
        ratio(c("_sum").cast("decimal(28,2)") - c("saidi_promedio_ciudad") * c("_n"), c("_n"), 2, 2).alias("delta_vs_ciudad"),
        F.when(over("2.0"), "CRITICO").when(over("1.5"), "ALTO").when(over("1.0"), "MEDIO").otherwise("NORMAL").alias("nivel_desempeno"),
    )


def heatmap(t: Tables) -> DataFrame:
    """Interruptions by hour and weekday; empty cells are absent."""
    f = t["fact_interrupciones"].filter(~c("excluido_med")).groupBy("sk_fecha", "sk_tiempo").agg(F.count("*").alias("n"), F.sum("duracion_minutos").cast(DECIMAL).alias("d"))
    named = f.join(F.broadcast(t["dim_tiempo"].select("sk_tiempo", "hora")), "sk_tiempo").join(F.broadcast(t["dim_fecha"].select("sk_fecha", "dia_semana", "dia_semana_num")), "sk_fecha")
    g = named.groupBy("hora", "dia_semana", "dia_semana_num").agg(F.sum("n").alias("total_interrupciones"), F.sum("d").cast(DECIMAL).alias("duracion_total"))
    return g.withColumns({"franja_horaria": heatmap_band(c("hora")), "duracion_promedio": ratio(c("duracion_total"), c("total_interrupciones"), 2, 2)})


def consumo_diario(t: Tables) -> DataFrame:
    """Energy by day at four levels: city, substation, circuit, sector."""
    f = states(t, READINGS).groupBy("_dia", "sk_red_electrica", "sk_geografia_urbana").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("hi").alias("hi"), F.min("lo").alias("lo"))
    day, drill = ["anio", "mes", "dia", "fecha"], ["subestacion", "circuito", "sector_urbano"]
    named = f.join(F.broadcast(t["dim_fecha"].select(*day)), c("_dia") == c("fecha")).join(t["dim_red_electrica"].select("sk_red_electrica", *drill[:2]), "sk_red_electrica").join(t["dim_geografia_urbana"].select("sk_geografia_urbana", "sector_urbano"), "sk_geografia_urbana")
    fine = named.groupBy(*day, *drill).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("hi").alias("hi"), F.min("lo").alias("lo"))
    out = _levels(fine, day, drill, F.sum("n").alias("total_lecturas"), F.sum("s").cast("decimal(28,4)").alias("consumo_total_kwh"), F.max("hi").alias("consumo_maximo_kwh"), F.min("lo").alias("consumo_minimo_kwh"))
    return out.withColumn("consumo_promedio_kwh", c("consumo_total_kwh").cast("double") / c("total_lecturas"))


def voltaje_tendencia(t: Tables) -> DataFrame:
    """Voltage by month at four levels, and where it varies by more than 5 % of its mean. Sums and sums of squares are exact decimals, so levels add up."""
    f = states(t, READINGS).groupBy("_dia", "sk_red_electrica").agg(F.sum("n").alias("n"), F.sum("vs").alias("s"), F.sum("vq").alias("q"), F.min("vlo").alias("lo"), F.max("vhi").alias("hi"))
    month, drill = ["anio", "mes"], ["subestacion", "circuito", "transformador"]
    named = f.join(F.broadcast(t["dim_fecha"].select("fecha", *month)), c("_dia") == c("fecha")).join(t["dim_red_electrica"].select("sk_red_electrica", *drill), "sk_red_electrica")
    fine = named.groupBy(*month, *drill).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    out = _levels(fine, month, drill, F.sum("n").alias("total_lecturas"), F.sum("s").cast(DECIMAL).alias("_s"), F.sum("q").cast("decimal(28,4)").alias("_q"), F.min("lo").alias("voltaje_minimo"), F.max("hi").alias("voltaje_maximo"))
    n = c("total_lecturas")
    spread = (n.cast("decimal(12,0)") * c("_q").cast("decimal(24,4)") - (c("_s").cast("decimal(18,2)") * c("_s").cast("decimal(18,2)"))).cast("double")
    deviation = F.when(n > 1, F.sqrt(spread / n / F.nullif(n - 1, F.lit(0))))
    mean = c("_s").cast("double") / n
    return out.withColumn("_d", deviation).select(
        *month, *drill, "total_lecturas", ratio(c("_s"), n, 2, 2).alias("voltaje_promedio"), F.round("_d", 2).cast("decimal(10,2)").alias("voltaje_desviacion"), "voltaje_minimo", "voltaje_maximo",
        F.coalesce(c("_d") / F.nullif(mean, F.lit(0.0)) > 0.05, F.lit(False)).alias("fluctuacion_excesiva"),
    )


def auditoria_errores(t: Tables) -> DataFrame:
    """Errors by day of detection and reason."""
    return t["err_telemetria"].groupBy(F.to_date("fecha_deteccion").alias("fecha"), "motivo_error").agg(
        F.count("*").alias("total_errores"), F.countDistinct("id_medidor").alias("medidores_afectados"), F.count_if("resuelto").alias("resueltos"), F.count_if(~c("resuelto")).alias("pendientes")
    )


def monitoreo_elt(t: Tables) -> DataFrame:
    """The ledger with rates of facts and of errors by event, in percent."""
    rate = lambda x: F.coalesce(ratio(c(x).cast("decimal(18,0)") * 100, c("total_eventos"), 0, 2), F.lit(0))
    return t["ctrl_lotes_procesamiento"].withColumns({"tasa_conversion_pct": rate("total_hechos"), "tasa_error_pct": rate("total_huerfanos")})


def med_report(t: Tables, beta: float = 2.5, store: Store = as_plan, **how: bool) -> tuple[DataFrame, DataFrame]:
    """fecha and sk_fecha of the major event days, and one row: facts to be flagged, rows above the threshold, the threshold. Days and threshold come from the same daily sums."""
    daily = store(saidi_diario(t, **how), "saidi-diario")
    limit = umbral_med(daily, beta)
    over = daily.crossJoin(F.broadcast(limit)).filter(c("saidi_diario") > c("umbral_med"))
    days = over.select("fecha").distinct().join(t["dim_fecha"].select("fecha", "sk_fecha"), "fecha")
    hit = t["fact_interrupciones"].filter(~c("excluido_med")).join(F.broadcast(days), "sk_fecha", "left_semi").agg(F.count("*").alias("total_actualizados"))
    return days, hit.crossJoin(over.agg(F.count("*").alias("total_med_days"))).crossJoin(limit.withColumnRenamed("umbral_med", "umbral_aplicado"))


def flag_med(t: Tables, beta: float = 2.5, store: Store = as_plan, **how: bool) -> tuple[DataFrame, DataFrame]:
    """The facts with excluido_med set on major event days, and the report.

    Flagged facts leave the daily view, so a second call may find a lower threshold; flags are never cleared.
    """
    days, report = med_report(t, beta, store, **how)
    return update(t["fact_interrupciones"], days.select("sk_fecha"), "sk_fecha", {"excluido_med": F.lit(True)}), report


def dashboard_order(view: str, df: DataFrame) -> DataFrame:
    """The presentation order of a view; nulls where PostgreSQL's clients see them."""
    d, a = lambda x: c(x).desc_nulls_first(), lambda x: c(x).asc_nulls_last()
    order = {
        "saidi_diario": [d("fecha")], "saidi_con_med": [d("fecha")], "consumo_diario": [d("fecha")], "voltaje_tendencia": [d("anio"), d("mes")], "saidi_mensual": [d("anio"), d("mes"), a("subestacion")],
        "tendencia": [d("anio"), d("mes")], "ranking": [a("ranking")], "heatmap": [a("dia_semana_num"), a("hora")], "auditoria_errores": [d("fecha"), d("total_errores")], "monitoreo_elt": [d("id_lote")],
    }
    return df.orderBy(*order[view])
