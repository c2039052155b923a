"""Every reliability operator and view as a query over the test tables, with equivalent SQL in oracle.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.calendar import dim_fecha, dim_tiempo
from .operators import pairing
from .operators.changes import update
from .operators.versions import asof_global, asof_latest, interval_join, last_day
from .plans import measures, outages, telemetry, views
from .sources.interim import stored
from .sources.testbind import tables, targets

Query = Callable[[SparkSession, str], DataFrame]


def plain(df: DataFrame) -> DataFrame:
    """Types that every engine has: whole numbers as long, decimals as double, timestamps without zone."""
    kinds = {"int": "long", "smallint": "long", "tinyint": "long", "float": "double", "timestamp": "timestamp_ntz"}
    return df.select(*(F.col(n).cast("double" if t.startswith("decimal") else kinds.get(t, t)).alias(n) for n, t in df.dtypes))


def events(t: outages.Tables) -> DataFrame:
    return pairing.pending(t["staging_eventos"], "timestamp_evento")


def kept(df: DataFrame, name: str) -> DataFrame:
    """Stores what more than one output of a batch is made from; the rest stays a plan."""
    return stored(df, name) if name in ("pares", "red_nueva", "hechos") else df


def with_outages(t: outages.Tables) -> outages.Tables:
    """The tables after a batch of outages, as written: facts, and the network members that it added."""
    batch = outages.reconcile_outages(t, store=kept)
    return t | {
        "fact_interrupciones": batch["hechos"].withColumn("excluido_med", F.lit(False)),
        "dim_red_electrica": t["dim_red_electrica"].unionByName(batch["red_nueva"], allowMissingColumns=True),
        "_procesados": batch["procesados"].select("id_evento"),
        "err_telemetria": batch["errores"].withColumns({"fecha_deteccion": F.lit("2024-02-01").cast("timestamp"), "resuelto": F.lit(False)}),
    }


def with_readings(t: outages.Tables) -> outages.Tables:
    batch = telemetry.reconcile_telemetry(t)
    return t | {"fact_telemetria": batch["hechos"], "err_telemetria": batch["errores"].withColumns({"fecha_deteccion": F.lit("2024-02-01").cast("timestamp"), "resuelto": F.lit(False)})}


def second_run(t: outages.Tables) -> DataFrame:
    """What the same batch would add when run again over the tables as the first left them: the counts, all 0."""
    after = with_outages(t)
    after["staging_eventos"] = stored(update(t["staging_eventos"], after["_procesados"], "id_evento", {"procesado": F.lit(True)}), "staging_eventos")
    again = outages.reconcile_outages(after)
    return again["hechos"].agg(F.count("*").alias("hechos_nuevos")).crossJoin(again["errores"].agg(F.count("*").alias("errores_nuevos")))


def second_telemetry_run(t: outages.Tables) -> DataFrame:
    """Readings still pending after one and after two batches, and what the second adds."""
    first = telemetry.reconcile_telemetry(t, store=stored)
    after = t | {"fact_telemetria": first["hechos"], "err_telemetria": first["errores"]}
    after["staging_telemetria"] = stored(update(t["staging_telemetria"], first["procesados"].select("id_staging"), "id_staging", {"procesado": F.lit(True)}), "staging_telemetria")
    again = telemetry.reconcile_telemetry(after)
    pending = pairing.pending(after["staging_telemetria"], "timestamp_lectura")
    rest = pending.join(again["procesados"].select("id_staging"), "id_staging", "left_anti")
    n = lambda rows, name: rows.agg(F.count("*").alias(name))
    return n(pending, "pendientes_1").crossJoin(n(rest, "pendientes_2")).crossJoin(n(again["hechos"], "hechos_nuevos")).crossJoin(n(again["errores"], "errores_nuevos"))


def ledger(t: outages.Tables) -> DataFrame:
    """The ledger after one outage and one telemetry batch, without what the clock says."""
    batches = [(1, outages.reconcile_outages(t)["contadores"]), (2, telemetry.reconcile_telemetry(t)["contadores"])]
    rows = [b.select(F.lit(k).alias("id_lote"), "total_eventos", "total_hechos", "total_huerfanos", "total_transitorios", F.lit("COMPLETADO").alias("estado")) for k, b in batches]
    return views.monitoreo_elt({"ctrl_lotes_procesamiento": rows[0].unionByName(rows[1])})


def referential_audit(t: outages.Tables) -> DataFrame:
    """Fact rows without their dimension rows, by key: n is 0 throughout, the unknown sector apart, which the batch adds."""
    after = with_outages(t)
    rows = [after["fact_interrupciones"].join(after[d].select(k), k, "left_anti").agg(F.count("*").alias("n")).select(F.lit(k).alias("clave"), "n") for k, d in (("sk_fecha", "dim_fecha"), ("sk_tiempo", "dim_tiempo"), ("sk_red_electrica", "dim_red_electrica"), ("sk_clientes", "dim_clientes_inventario"), ("sk_tipo_evento", "dim_tipo_evento"))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


#: Months of 30 days over which over_months spreads the test events, which are of one month: a meter's events stay together.
MONTHS = 14


def over_months(t: outages.Tables) -> outages.Tables:
    later = F.make_interval(hours=(24 * 30 * (F.col("id_medidor") % MONTHS)).cast("int"))
    return t | {"staging_eventos": t["staging_eventos"].withColumn("timestamp_evento", F.col("timestamp_evento") + later)}


#: Months of 30 days over which over_years spreads them; meters of SKIPPED stay in the first one, so months are missing.
YEARS, SKIPPED = 30, (5, 6, 17)


def over_years(t: outages.Tables) -> outages.Tables:
    k = F.col("id_medidor") % YEARS
    later = F.make_interval(hours=(24 * 30 * F.when(k.isin(*SKIPPED), 0).otherwise(k)).cast("int"))
    return t | {"staging_eventos": t["staging_eventos"].withColumn("timestamp_evento", F.col("timestamp_evento") + later)}


def monthly_over_years(t: outages.Tables) -> DataFrame:
    """The monthly indices of several years, stored: measures read them more than once."""
    return stored(views.saidi_mensual(with_outages(over_years(t)), **S).drop("fecha_consulta"), "saidi-mensual")


def one_hot_meter(t: outages.Tables) -> outages.Tables:
    """Three of four meters are one, which has most of the events."""
    m = F.col("id_medidor")
    return t | {"staging_eventos": t["staging_eventos"].withColumn("id_medidor", F.when(m % 4 < 3, 1).otherwise(m).cast("long"))}


def error_details(t: outages.Tables) -> DataFrame:
    """The technical details of a telemetry batch's errors, read back from their JSON."""
    field = lambda name: F.get_json_object("detalle_tecnico", f"$.{name}")
    numbers = [field(x).cast("double").alias(x) for x in ("consumo_wh", "voltaje")]
    return telemetry.reconcile_telemetry(t)["errores"].select("id_evento_origen", "tipo_error", *numbers, *(field(x).alias(x) for x in ("tipo_lectura", "bloque", "rango_aceptable", "rango_normal")))


def _over(build: Callable[[outages.Tables], DataFrame], power_only: bool = True) -> Query:
    return lambda spark, sf_dir: plain(build(tables(spark, sf_dir, power_only)))


PAIR_COLUMNS = ["id_outage", "id_medidor", "ts_outage", "id_restoration", "ts_restoration", "clasificacion", "duracion_minutos"]
V, S = {"active_only": False}, {"store": stored}


def queries() -> dict[str, Query]:
    on = ("id_medidor", "id_medidor_origen")
    readings = lambda t: pairing.pending(t["staging_telemetria"], "timestamp_lectura")
    active = lambda t: telemetry.active_readings(t, readings(t))
    long = lambda t: outages.valid_pairs(pairing.pairs(events(t)))
    return {
        "dim_fecha": lambda s, d: plain(dim_fecha(s)),
        "dim_tiempo": lambda s, d: plain(dim_tiempo(s)),
        "orphan_restorations": _over(lambda t: pairing.orphans(events(t)).select("id_evento", "id_medidor", "timestamp_evento", "huerfana")),
        "orphan_restorations_all_types": _over(lambda t: pairing.orphans(events(t)).select("id_evento", "id_medidor", "timestamp_evento", "huerfana"), False),
        "event_pairs": _over(lambda t: pairing.pairs(events(t)).select(*PAIR_COLUMNS)),
        "event_pairs_all_types": _over(lambda t: pairing.pairs(events(t)).select(*PAIR_COLUMNS), False),
        "event_pairs_by_ranges": _over(lambda t: pairing.pairs_by_ranges(events(t), stored).select(*PAIR_COLUMNS), False),
        "event_pairs_hot_meter": _over(lambda t: pairing.pairs_by_ranges(events(one_hot_meter(t)), stored).select(*PAIR_COLUMNS), False),
        "orphan_restorations_hot_meter": _over(lambda t: pairing.orphans_by_ranges(events(one_hot_meter(t)), stored).select("id_evento", "id_medidor", "timestamp_evento", "huerfana"), False),
        "transients": _over(lambda t: pairing.pairs(events(t)).filter(F.col("duracion_minutos") < pairing.TRANSIENT_MINUTES).select("id_outage", "id_restoration", "duracion_minutos")),
        "double_outages": _over(lambda t: pairing.pairs(events(t)).filter("clasificacion = 'DOBLE_OUTAGE'").select("id_outage", "id_medidor", "ts_outage")),
        "open_outages": _over(lambda t: pairing.pairs(events(t)).filter("clasificacion = 'OUTAGE_ABIERTO'").select("id_outage", "id_medidor", "ts_outage")),
        "scd_asof_network": _over(lambda t: asof_latest(readings(t).select("id_staging", "id_medidor", "timestamp_lectura"), t["dim_red_electrica"], on, "timestamp_lectura", ["sk_red_electrica"]).select("id_staging", "sk_red_electrica")),
        "scd_all_matches": _over(lambda t: interval_join(readings(t), t["dim_red_electrica"].drop("id_medidor"), on, "timestamp_lectura").select("id_staging", "sk_red_electrica")),
        "scd_asof_customers": _over(lambda t: asof_global(long(t), t["dim_clientes_inventario"], "ts_outage", ["sk_clientes"], last_day(t["dim_fecha"])).select("id_outage", "sk_clientes")),
        "unresolved_network_fallback": _over(lambda t: outages.network_fallback(t, long(t).select("id_medidor", "ts_outage")).select("sk_red_electrica", "id_medidor", "codigo_medidor", "fecha_inicio", "sk_geografia_urbana")),
        "fact_interrupciones": _over(lambda t: outages.reconcile_outages(t, store=kept)["hechos"]),
        "outage_errors": _over(lambda t: outages.reconcile_outages(t)["errores"].select("id_evento_origen", "id_medidor", "tipo_evento", "tipo_error", "motivo_error")),
        "outage_processed": _over(lambda t: outages.reconcile_outages(t)["procesados"].select("id_evento")),
        "outage_counters": _over(lambda t: outages.reconcile_outages(t)["contadores"]),
        "second_run_facts": _over(second_run),
        "telemetry_inactive": _over(lambda t: telemetry.inactive_readings(t, readings(t)).select("id_staging", "id_medidor", "timestamp_lectura")),
        "telemetry_voltage": _over(lambda t: telemetry.voltage_warnings(active(t)).select("id_staging", "voltaje", "motivo_error")),
        "telemetry_negative": _over(lambda t: telemetry.negative_consumption(active(t)).select("id_staging", "consumo_wh")),
        "fact_telemetria": _over(lambda t: telemetry.reconcile_telemetry(t)["hechos"]),
        "telemetry_counters": _over(lambda t: telemetry.reconcile_telemetry(t)["contadores"]),
        "second_run_readings": _over(second_telemetry_run),
        "saidi_diario": _over(lambda t: views.saidi_diario(with_outages(t))),
        "saidi_diario_all_versions": _over(lambda t: views.saidi_diario(with_outages(t), **V)),
        "umbral_med": _over(lambda t: views.umbral_med(views.saidi_diario(with_outages(t)))),
        "saidi_con_med": _over(lambda t: views.saidi_con_med(with_outages(t), **S)),
        "saidi_mensual": _over(lambda t: views.saidi_mensual(with_outages(t), **S).drop("fecha_consulta")),
        "saidi_mensual_beta05": _over(lambda t: views.saidi_mensual(with_outages(t), 0.5, **S).drop("fecha_consulta")),
        "tendencia": _over(lambda t: views.tendencia(with_outages(t), **S)),
        "tendencia_ciudad": _over(lambda t: views.tendencia(with_outages(t), city_level_only=True, **S)),
        "saidi_mensual_over_months": _over(lambda t: views.saidi_mensual(with_outages(over_months(t)), 0.5, **S).drop("fecha_consulta")),
        "tendencia_over_months": _over(lambda t: views.tendencia(with_outages(over_months(t)), 0.5, **S)),
        "tendencia_ciudad_over_months": _over(lambda t: views.tendencia(with_outages(over_months(t)), 0.5, city_level_only=True, **S)),
        "telemetry_error_details": _over(error_details),
        "ranking": _over(lambda t: views.ranking(with_outages(t), **S)),
        "heatmap": _over(lambda t: views.heatmap(with_outages(t))),
        "consumo_diario": _over(lambda t: views.consumo_diario(with_readings(t))),
        "voltaje_tendencia": _over(lambda t: views.voltaje_tendencia(with_readings(t))),
        "auditoria_errores": _over(lambda t: views.auditoria_errores(with_outages(t))),
        "auditoria_telemetria": _over(lambda t: views.auditoria_errores(with_readings(t))),
        "monitoreo_elt": _over(ledger),
        "flag_med_beta05": _over(lambda t: views.flag_med(with_outages(t), 0.5, **S)[1]),
        "flagged_facts_beta05": _over(lambda t: views.flag_med(with_outages(t), 0.5, **S)[0].filter("excluido_med").select("id_medidor", "timestamp_inicio")),
        "referential_audit": _over(referential_audit),
        "medida_ytd": _over(lambda t: measures.year_to_date(monthly_over_years(t))),
        "medida_interanual": _over(lambda t: measures.year_over_year(monthly_over_years(t))),
        "medida_vs_meta": lambda s, d: plain(measures.against_target(monthly_over_years(tables(s, d)), targets(s, d), last_day(tables(s, d)["dim_fecha"]))),
        "medida_semaforos": _over(lambda t: measures.lights(monthly_over_years(t))),
        "medida_lotes": _over(lambda t: measures.batch_health(ledger(t))),
        "last_batches": _over(lambda t: ledger(t).orderBy(F.col("id_lote").desc()).limit(10)),
        "row_counts": _over(lambda t: _row_counts(t)),
    }


def _row_counts(t: outages.Tables) -> DataFrame:
    out = None
    for name in sorted(t):
        one = t[name].agg(F.count("*").alias("filas")).select(F.lit(name).alias("tabla"), "filas")
        out = one if out is None else out.unionByName(one)
    return out
