"""DuckDB SQL equivalent to queries.py, on the same test tables. Rounding is done on whole numbers, half up, as the engine does."""

from __future__ import annotations

from .operators.pairing import CONSECUTIVE, DOUBLE, NO_OUTAGE_BEFORE
from .plans.telemetry import INACTIVE, NEGATIVE, VOLTS_NORMAL


def ratio(num: str, den: str, places: int, scale: int = 1) -> str:
    """num / scale / den, num a whole number, rounded once; null where den is null or 0."""
    d = f"(({den})::HUGEINT * {scale})"
    n = f"(({num})::HUGEINT * {10**places})"
    return f"(CASE WHEN {d} <> 0 THEN (sign({n}) * ((2 * abs({n}) + {d}) // (2 * {d})))::DOUBLE / {10**places}.0 END)"


DIMS = """
fecha AS (SELECT (date_diff('day', DATE '1995-01-01', d::DATE) + 1)::BIGINT AS sk_fecha, d::DATE AS fecha, year(d)::BIGINT AS anio, month(d)::BIGINT AS mes, day(d)::BIGINT AS dia, quarter(d)::BIGINT AS trimestre,
  monthname(d) AS nombre_mes, dayname(d) AS dia_semana, isodow(d)::BIGINT AS dia_semana_num FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2026-12-31', INTERVAL 1 DAY) s(d)),
geo AS (SELECT (n_nationkey + 1)::BIGINT AS sk_geografia_urbana, n_name AS sector_urbano FROM nation),
base AS (SELECT c_custkey AS k, c_mktsegment AS transformador, n_name AS circuito, r_name AS subestacion, (n_nationkey + 1)::BIGINT AS g FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 40 <> 3),
red AS (SELECT 2 * k + 1 AS sk, k, transformador, circuito, subestacion, g, TIMESTAMP '1995-01-01' AS ini, CASE WHEN k % 10 = 0 THEN TIMESTAMP '1998-01-01' END AS fin, k % 25 <> 7 AS activo FROM base
  UNION ALL SELECT 2 * k + 2, k, transformador, circuito, subestacion, g, TIMESTAMP '1998-01-01', NULL, k % 25 <> 7 FROM base WHERE k % 10 = 0),
inv AS (SELECT 1::BIGINT AS sk, count(*) AS tot, TIMESTAMP '1995-01-01' AS ini, TIMESTAMP '2024-01-16' AS fin, false AS activo FROM customer UNION ALL SELECT 2, count(*) + count(*) // 10, TIMESTAMP '2024-01-16', NULL, true FROM customer)"""


def events(power_only: bool = True, months: int = 1, skipped: tuple[int, ...] = (-1,), hot: bool = False) -> str:
    return f"""
ev AS (SELECT event_id AS id, {"CASE WHEN user_id % 4 < 3 THEN 1 ELSE user_id END" if hot else "user_id"} AS m, ts + to_days((30 * CASE WHEN user_id % {months} IN ({", ".join(map(str, skipped))}) THEN 0 ELSE user_id % {months} END)::INTEGER) AS ts, CASE event_type WHEN 'error' THEN 'POWER_OUTAGE' WHEN 'purchase' THEN 'POWER_RESTORATION' WHEN 'signup' THEN 'VOLTAGE_SPIKE' WHEN 'view' THEN 'VOLTAGE_SAG' WHEN 'click' THEN 'HEARTBEAT' ELSE 'UNKNOWN' END AS tipo
  FROM events {"WHERE event_type IN ('error', 'purchase')" if power_only else ""}),
seen AS (SELECT *, lag(tipo) OVER (PARTITION BY m ORDER BY ts, id) AS ant FROM ev),
orf AS (SELECT *, CASE WHEN ant IS NULL THEN '{NO_OUTAGE_BEFORE}' ELSE '{CONSECUTIVE}' END AS motivo FROM seen WHERE tipo = 'POWER_RESTORATION' AND (ant IS NULL OR ant = 'POWER_RESTORATION')),
nxt AS (SELECT *, lead(tipo) OVER q AS nt, lead(id) OVER q AS ni, lead(ts) OVER q AS nts FROM ev WHERE id NOT IN (SELECT id FROM orf) WINDOW q AS (PARTITION BY m ORDER BY ts, id)),
p AS (SELECT id AS id_outage, m, ts AS ts_outage, CASE WHEN nt = 'POWER_RESTORATION' THEN ni END AS id_restoration, CASE WHEN nt = 'POWER_RESTORATION' THEN nts END AS ts_restoration,
  CASE WHEN nt = 'POWER_RESTORATION' THEN 'PAR_VALIDO' WHEN nt = 'POWER_OUTAGE' THEN 'DOBLE_OUTAGE' WHEN nt IS NULL THEN 'OUTAGE_ABIERTO' ELSE 'ERROR_DESCONOCIDO' END AS clase,
  CASE WHEN nt = 'POWER_RESTORATION' THEN (2 * (epoch_us(nts) - epoch_us(ts)) + 600000) // 1200000 END AS cm FROM nxt WHERE tipo = 'POWER_OUTAGE')"""


FACTS = """
l AS (SELECT * FROM p WHERE clase = 'PAR_VALIDO' AND cm >= 500),
lr AS (SELECT l.*, r.sk, r.g, row_number() OVER (PARTITION BY l.id_outage ORDER BY r.ini DESC, r.sk DESC) AS n FROM l LEFT JOIN red r ON r.k = l.m AND r.ini <= ts_outage AND (r.fin IS NULL OR r.fin > ts_outage)),
spare AS (SELECT m, min(ts_outage) - INTERVAL 1 DAY AS desde, row_number() OVER (ORDER BY m) + (SELECT max(sk) FROM red) AS sk FROM lr WHERE n = 1 AND sk IS NULL GROUP BY m),
li AS (SELECT id_outage, i.sk AS sk_clientes, row_number() OVER (PARTITION BY id_outage ORDER BY i.ini DESC, i.sk DESC) AS n FROM l LEFT JOIN inv i ON i.ini <= ts_outage AND (i.fin IS NULL OR i.fin > ts_outage)),
f AS (SELECT fe.sk_fecha, fe.fecha, (hour(ts_outage) + 1)::BIGINT AS sk_tiempo, coalesce(lr.sk, s.sk)::BIGINT AS sk_red_electrica, coalesce(lr.g, (SELECT max(sk_geografia_urbana) + 1 FROM geo))::BIGINT AS sk_geografia_urbana,
  coalesce(li.sk_clientes, 3)::BIGINT AS sk_clientes, 1::BIGINT AS sk_tipo_evento, lr.m AS id_medidor, ts_outage AS timestamp_inicio, ts_restoration AS timestamp_fin, cm, 1::BIGINT AS clientes_afectados
  FROM lr JOIN li USING (id_outage) LEFT JOIN spare s ON s.m = lr.m LEFT JOIN fecha fe ON fe.fecha = ts_outage::DATE WHERE lr.n = 1 AND li.n = 1),
red2 AS (SELECT sk, transformador, circuito, subestacion FROM red UNION ALL SELECT sk, 'TRANSFORMADOR_DESCONOCIDO', 'CIRCUITO_DESCONOCIDO', 'SUBESTACION_DESCONOCIDA' FROM spare)"""


def daily(active_only: bool = True, beta: float = 2.5) -> str:
    """v1: the daily view; u: the threshold; med: days above it."""
    return f"""
v1 AS (SELECT anio, mes, nombre_mes, trimestre, dia, fe.fecha, CASE WHEN count(f.cm) > 0 THEN 'INTERRUPCION' END AS categoria, CASE WHEN count(f.cm) > 0 THEN 'ALTA' END AS severidad, CASE WHEN count(f.cm) > 0 THEN true END AS es_critico,
  count(f.cm)::BIGINT AS total_interrupciones, coalesce(sum(f.cm), 0)::BIGINT AS mc, max(i.tot)::BIGINT AS total_clientes_servidos,
  coalesce({ratio("coalesce(sum(f.cm), 0)", "max(i.tot)", 4, 100)}, 0.0) AS saidi_diario, coalesce({ratio("count(f.cm)", "max(i.tot)", 4)}, 0.0) AS saifi_diario
  FROM fecha fe LEFT JOIN f ON f.sk_fecha = fe.sk_fecha LEFT JOIN inv i ON i.ini <= fe.fecha AND (i.fin IS NULL OR i.fin > fe.fecha) {"AND i.activo" if active_only else ""} GROUP BY ALL),
u AS (SELECT CASE WHEN b IS NULL OR b < 1e-12 THEN 0.0 ELSE round(exp(a + {beta} * b), 2) END AS umbral_med FROM (SELECT avg(ln(saidi_diario + 0.0001)) AS a, stddev_pop(ln(saidi_diario + 0.0001)) AS b FROM v1 WHERE saidi_diario > 0)),
med AS (SELECT DISTINCT fecha FROM v1, u WHERE saidi_diario > umbral_med AND saidi_diario > 0)"""


DAILY = "anio, mes, nombre_mes, trimestre, dia, fecha, categoria, severidad, es_critico, total_interrupciones, mc / 100.0 AS suma_minutos_cliente, total_clientes_servidos, saidi_diario, saifi_diario"
LEVEL = "anio, mes, nombre_mes, trimestre, periodo"
MONTHLY = f"""
v5 AS (SELECT subestacion, circuito, transformador, {LEVEL}, count(*)::BIGINT AS total_interrupciones, sum(cm)::BIGINT AS mc, sum(clientes_afectados)::BIGINT AS total_clientes_afectados, coalesce(max(tot), 0)::BIGINT AS total_clientes_servidos
  FROM (SELECT r.*, fe.*, lpad(fe.anio::VARCHAR, 4, '0') || '-' || lpad(fe.mes::VARCHAR, 2, '0') AS periodo, f.cm, f.clientes_afectados, i.tot FROM f JOIN fecha fe ON fe.sk_fecha = f.sk_fecha JOIN red2 r ON r.sk = f.sk_red_electrica LEFT JOIN inv i ON i.sk = f.sk_clientes WHERE fe.fecha NOT IN (SELECT fecha FROM med))
  GROUP BY GROUPING SETS ((subestacion, circuito, transformador, {LEVEL}), (subestacion, circuito, {LEVEL}), (subestacion, {LEVEL}), ({LEVEL}))),
v5r AS (SELECT *, coalesce({ratio("mc", "total_clientes_servidos", 2, 100)}, 0.0) AS saidi, coalesce({ratio("total_clientes_afectados", "total_clientes_servidos", 4)}, 0.0) AS saifi, coalesce({ratio("mc", "total_interrupciones", 2, 100)}, 0.0) AS caidi FROM v5)"""

READINGS = """
rd AS (SELECT o_orderkey AS id, o_custkey AS m, o_orderdate + to_hours(o_orderkey % 24) AS ts, (CASE WHEN o_orderkey % 97 = 0 THEN -1 ELSE 1 END * o_totalprice::DECIMAL(12,2))::DECIMAL(12,2) AS wh, (170 + o_orderkey % 101)::BIGINT AS v,
  CASE WHEN o_orderpriority LIKE '1-%' THEN 'LECTURA_EVENTO' WHEN o_orderpriority LIKE '5-%' THEN 'HEARTBEAT' ELSE 'LECTURA_PERIODICA' END AS tipo FROM orders),
act AS (SELECT rd.*, r.sk, r.g, r.subestacion, r.circuito, r.transformador FROM rd JOIN red r ON r.k = rd.m AND r.ini <= rd.ts AND (r.fin IS NULL OR r.fin > rd.ts) AND r.activo),
ina AS (SELECT * FROM rd WHERE id NOT IN (SELECT id FROM act)),
vol AS (SELECT * FROM rd WHERE id IN (SELECT id FROM act) AND (v < 180 OR v > 260)),
neg AS (SELECT * FROM rd WHERE id IN (SELECT id FROM act) AND wh < 0),
ft AS (SELECT * FROM (SELECT act.*, fe.sk_fecha, fe.anio, fe.mes, fe.dia, fe.fecha, (hour(ts) + 1)::BIGINT AS sk_tiempo, CASE tipo WHEN 'HEARTBEAT' THEN 5 WHEN 'LECTURA_PERIODICA' THEN 6 ELSE -1 END::BIGINT AS sk_tipo_evento,
  (2 * abs((wh * 100)::BIGINT) + 10) // 20 AS kwh4, row_number() OVER (PARTITION BY sk, fe.sk_fecha, hour(ts) ORDER BY ts, id) AS n FROM act JOIN fecha fe ON fe.fecha = ts::DATE WHERE wh >= 0 AND v BETWEEN 0 AND 1000) WHERE n = 1)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + " "


EV, EV_ALL = events(), events(False)
F_ = (DIMS, EV, FACTS)
F_MONTHS = (DIMS, events(months=14), FACTS)
F_YEARS = (DIMS, events(months=30, skipped=(5, 6, 17)), FACTS)
TARGETS = "meta AS (SELECT TIMESTAMP '2023-06-01' + to_days((60 * n_nationkey)::INTEGER) AS ini, CASE WHEN n_nationkey < 24 THEN TIMESTAMP '2023-06-01' + to_days((60 * n_nationkey + 60)::INTEGER) END AS fin, (n_nationkey % 7 + 1) * 4.0::DOUBLE AS meta_saidi FROM nation WHERE n_nationkey <> 9)"
V1, V1_ALL, V1_LOW = daily(), daily(False), daily(True, 0.5)
PAIR = "SELECT id_outage, m AS id_medidor, ts_outage, id_restoration, ts_restoration, clase AS clasificacion, cm / 100.0 AS duracion_minutos FROM p"
ORPHAN = "SELECT id AS id_evento, m AS id_medidor, ts AS timestamp_evento, motivo AS huerfana FROM orf"
MONTH_OUT = f"SELECT subestacion, circuito, transformador, {LEVEL}, total_interrupciones, mc / 100.0 AS suma_duracion_minutos, mc / 100.0 AS suma_minutos_cliente, total_clientes_afectados, total_clientes_servidos, saidi, saifi, caidi FROM v5r"


def _light(value: str, limit: str) -> str:
    return f"CASE WHEN {value} < {limit} THEN 'VERDE' WHEN {value} <= {limit} * 1.5 THEN 'AMARILLO' WHEN {value} IS NOT NULL AND {limit} IS NOT NULL THEN 'ROJO' END"


def _trend(where: str = "") -> str:
    return f"""SELECT anio, mes, nombre_mes, trimestre, periodo, anio * 100 + mes AS periodo_orden, n AS total_interrupciones, k AS total_clientes_afectados, {ratio("mc", "tot", 2, 100)} AS saidi_ciudad, {ratio("k", "tot", 4)} AS saifi_ciudad,
  round((x - lag(x) OVER o) / nullif(lag(x) OVER o, 0) * 100, 2) AS variacion_saidi_pct FROM (SELECT {LEVEL}, sum(total_interrupciones)::BIGINT AS n, sum(total_clientes_afectados)::BIGINT AS k, sum(mc)::BIGINT AS mc, max(total_clientes_servidos)::BIGINT AS tot, (sum(mc)::BIGINT / 100.0) / nullif(max(total_clientes_servidos), 0) AS x
  FROM v5r WHERE anio * 100 + mes >= (SELECT year(d) * 100 + month(d) FROM (SELECT max(timestamp_inicio) - INTERVAL 24 MONTH AS d FROM f)) {where} GROUP BY {LEVEL}) WINDOW o AS (ORDER BY anio, mes)"""


COUNTERS = "(SELECT (SELECT coalesce(sum(CASE WHEN clase = 'PAR_VALIDO' THEN 2 ELSE 1 END), 0)::BIGINT FROM p) AS total_eventos, (SELECT count(*) FROM f) AS total_hechos, (SELECT count(*) FROM orf) + (SELECT count(*) FROM p WHERE clase = 'DOBLE_OUTAGE') AS total_huerfanos, (SELECT count(*) FROM p WHERE clase = 'PAR_VALIDO' AND cm < 500) AS total_transitorios)"
T_COUNTERS = "(SELECT (SELECT count(*) FROM rd) AS total_eventos, (SELECT count(*) FROM ft) AS total_hechos, (SELECT count(*) FROM ina) + (SELECT count(*) FROM vol) + (SELECT count(*) FROM neg) AS total_huerfanos, (SELECT count(*) FROM ina) + (SELECT count(*) FROM neg) AS total_transitorios)"
LEDGER = f"SELECT id_lote::BIGINT AS id_lote, total_eventos, total_hechos, total_huerfanos, total_transitorios, 'COMPLETADO' AS estado, coalesce({ratio('total_hechos * 100', 'total_eventos', 2)}, 0.0) AS tasa_conversion_pct, coalesce({ratio('total_huerfanos * 100', 'total_eventos', 2)}, 0.0) AS tasa_error_pct FROM (SELECT 1 AS id_lote, * FROM {COUNTERS} UNION ALL SELECT 2, * FROM {T_COUNTERS})"
RANKED = f"""SELECT row_number() OVER (ORDER BY s DESC, subestacion) AS ranking, subestacion, meses_con_datos, {ratio("s", "n", 2, 100)} AS saidi_promedio, {ratio("s4", "n", 4, 10000)} AS saifi_promedio, {ratio("s2", "n", 2, 100)} AS caidi_promedio, total_interrupciones_acum, city / 100.0 AS saidi_promedio_ciudad,
  {ratio("s - city * n", "n", 2, 100)} AS delta_vs_ciudad, CASE WHEN s > city * n * 2 THEN 'CRITICO' WHEN 2 * s > city * n * 3 THEN 'ALTO' WHEN s > city * n THEN 'MEDIO' ELSE 'NORMAL' END AS nivel_desempeno
  FROM (SELECT subestacion, count(DISTINCT periodo) AS meses_con_datos, sum(round(saidi * 100)::BIGINT)::BIGINT AS s, sum(round(saifi * 10000)::BIGINT)::BIGINT AS s4, sum(round(caidi * 100)::BIGINT)::BIGINT AS s2, count(*) AS n, sum(total_interrupciones)::BIGINT AS total_interrupciones_acum FROM y GROUP BY subestacion),
  (SELECT round({ratio("sum(round(saidi * 100)::BIGINT)", "count(*)", 2, 100)} * 100)::BIGINT AS city FROM y)"""
DETAILS = """
SELECT id AS id_evento_origen, 'MEDIDOR_INACTIVO' AS tipo_error, wh::DOUBLE AS consumo_wh, v::DOUBLE AS voltaje, tipo AS tipo_lectura, 'validacion' AS bloque, NULL::VARCHAR AS rango_aceptable, NULL::VARCHAR AS rango_normal FROM ina
UNION ALL SELECT id, 'VOLTAGE_OUT_OF_RANGE', NULL, v, NULL, NULL, '[0.00, 1000.00]', '[180.00, 260.00]' FROM vol
UNION ALL SELECT id, 'CONSUMO_NEGATIVO', wh, v, NULL, NULL, NULL, NULL FROM neg"""
YEAR = "y AS (SELECT * FROM v5r WHERE subestacion IS NOT NULL AND anio = (SELECT year(max(timestamp_inicio)) FROM f))"


def oracle_sql() -> dict[str, str]:
    ev, all_types, facts, v1 = _with(EV), _with(EV_ALL), _with(*F_), _with(*F_, V1)
    monthly, low, rd = _with(*F_, V1, MONTHLY), _with(*F_, V1_LOW, MONTHLY), _with(DIMS, READINGS)
    ledger = _with(DIMS, EV, FACTS, READINGS) + LEDGER
    band = "CASE WHEN h <= 5 THEN 'Madrugada' WHEN h <= 11 THEN 'Manana' WHEN h <= 17 THEN 'Tarde' WHEN h <= 22 THEN 'Pico' ELSE 'Noche' END"
    errors = f"SELECT id AS id_evento_origen, m AS id_medidor, 'POWER_RESTORATION' AS tipo_evento, 'INTERRUPCION' AS tipo_error, motivo AS motivo_error FROM orf UNION ALL SELECT id_outage, m, 'POWER_OUTAGE', 'OUTAGE_DUPLICADA', '{DOUBLE}' FROM p WHERE clase = 'DOBLE_OUTAGE'"
    audit = "SELECT DATE '2024-02-01' AS fecha, motivo_error, count(*) AS total_errores, count(DISTINCT id_medidor) AS medidores_afectados, 0::BIGINT AS resueltos, count(*) AS pendientes FROM ({}) GROUP BY motivo_error"
    t_errors = f"SELECT m AS id_medidor, '{INACTIVE}' AS motivo_error FROM ina UNION ALL SELECT m, '{VOLTS_NORMAL}' FROM vol UNION ALL SELECT m, '{NEGATIVE}' FROM neg"
    day, month = "anio, mes, dia, fecha", "anio, mes"
    hot, years, net = _with(events(False, hot=True)), _with(*F_YEARS, V1, MONTHLY), "subestacion, circuito, transformador"
    return {
        "dim_fecha": "SELECT (date_diff('day', DATE '2024-01-01', d::DATE) + 1)::BIGINT AS sk_fecha, d::DATE AS fecha, day(d)::BIGINT AS dia, dayname(d) AS dia_semana, isodow(d)::BIGINT AS dia_semana_num, week(d)::BIGINT AS semana_anio, month(d)::BIGINT AS mes, monthname(d) AS nombre_mes, quarter(d)::BIGINT AS trimestre, year(d)::BIGINT AS anio, isodow(d) >= 6 AS es_fin_semana, false AS es_feriado FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2026-12-31', INTERVAL 1 DAY) s(d)",
        "dim_tiempo": f"SELECT h + 1 AS sk_tiempo, h AS hora, {band} AS franja_horaria FROM range(24) t(h)",
        "orphan_restorations": ev + ORPHAN,
        "orphan_restorations_all_types": all_types + ORPHAN,
        "event_pairs": ev + PAIR,
        "event_pairs_all_types": all_types + PAIR,
        "transients": ev + "SELECT id_outage, id_restoration, cm / 100.0 AS duracion_minutos FROM p WHERE cm < 500",
        "double_outages": ev + "SELECT id_outage, m AS id_medidor, ts_outage FROM p WHERE clase = 'DOBLE_OUTAGE'",
        "open_outages": ev + "SELECT id_outage, m AS id_medidor, ts_outage FROM p WHERE clase = 'OUTAGE_ABIERTO'",
        "scd_asof_network": rd + "SELECT id AS id_staging, sk AS sk_red_electrica FROM (SELECT rd.id, r.sk, row_number() OVER (PARTITION BY rd.id ORDER BY r.ini DESC, r.sk DESC) AS n FROM rd LEFT JOIN red r ON r.k = rd.m AND r.ini <= rd.ts AND (r.fin IS NULL OR r.fin > rd.ts)) WHERE n = 1",
        "scd_all_matches": rd + "SELECT id AS id_staging, sk AS sk_red_electrica FROM act",
        "scd_asof_customers": facts + "SELECT id_outage, sk_clientes FROM li WHERE n = 1",
        "unresolved_network_fallback": facts + "SELECT sk AS sk_red_electrica, m AS id_medidor, 'MED-' || m AS codigo_medidor, desde AS fecha_inicio, (SELECT max(sk_geografia_urbana) + 1 FROM geo) AS sk_geografia_urbana FROM spare",
        "fact_interrupciones": facts + "SELECT sk_fecha, sk_tiempo, sk_red_electrica, sk_geografia_urbana, sk_clientes, sk_tipo_evento, id_medidor, timestamp_inicio, timestamp_fin, cm / 100.0 AS duracion_minutos, clientes_afectados FROM f",
        "outage_errors": ev + errors,
        "outage_processed": ev + "SELECT id AS id_evento FROM orf UNION ALL SELECT id_outage FROM p WHERE clase IN ('PAR_VALIDO', 'DOBLE_OUTAGE') UNION ALL SELECT id_restoration FROM p WHERE clase = 'PAR_VALIDO'",
        "outage_counters": facts + f"SELECT * FROM {COUNTERS}",
        "second_run_facts": "SELECT 0::BIGINT AS hechos_nuevos, 0::BIGINT AS errores_nuevos",
        "telemetry_inactive": rd + "SELECT id AS id_staging, m AS id_medidor, ts AS timestamp_lectura FROM ina",
        "telemetry_voltage": rd + f"SELECT id AS id_staging, v::DOUBLE AS voltaje, '{VOLTS_NORMAL}' AS motivo_error FROM vol",
        "telemetry_negative": rd + "SELECT id AS id_staging, wh::DOUBLE AS consumo_wh FROM neg",
        "fact_telemetria": rd + "SELECT sk_fecha, sk_tiempo, sk AS sk_red_electrica, g AS sk_geografia_urbana, sk_tipo_evento, date_trunc('hour', ts) AS timestamp_lectura, kwh4 / 10000.0 AS consumo_kwh, v::DOUBLE AS voltaje FROM ft",
        "telemetry_counters": rd + f"SELECT * FROM {T_COUNTERS}",
        "second_run_readings": rd + "SELECT (SELECT count(*) FROM vol WHERE wh >= 0) AS pendientes_1, 0::BIGINT AS pendientes_2, 0::BIGINT AS hechos_nuevos, 0::BIGINT AS errores_nuevos",
        "saidi_diario": v1 + f"SELECT {DAILY} FROM v1",
        "saidi_diario_all_versions": _with(*F_, V1_ALL) + f"SELECT {DAILY} FROM v1",
        "umbral_med": v1 + "SELECT umbral_med FROM u",
        "saidi_con_med": v1 + f"SELECT {DAILY}, umbral_med, saidi_diario > umbral_med AS es_med FROM v1, u",
        "saidi_mensual": monthly + MONTH_OUT,
        "saidi_mensual_beta05": low + MONTH_OUT,
        "tendencia": monthly + _trend(),
        "tendencia_ciudad": monthly + _trend("AND subestacion IS NULL"),
        "saidi_mensual_over_months": _with(*F_MONTHS, V1_LOW, MONTHLY) + MONTH_OUT,
        "tendencia_over_months": _with(*F_MONTHS, V1_LOW, MONTHLY) + _trend(),
        "tendencia_ciudad_over_months": _with(*F_MONTHS, V1_LOW, MONTHLY) + _trend("AND subestacion IS NULL"),
        "telemetry_error_details": rd + DETAILS,
        "ranking": _with(*F_, V1, MONTHLY, YEAR) + RANKED,
        "heatmap": facts + f"SELECT sk_tiempo - 1 AS hora, dia_semana, dia_semana_num, count(*) AS total_interrupciones, sum(cm)::BIGINT / 100.0 AS duracion_total, CASE WHEN sk_tiempo - 1 BETWEEN 6 AND 11 THEN 'Mañana' WHEN sk_tiempo - 1 BETWEEN 12 AND 17 THEN 'Tarde' WHEN sk_tiempo - 1 BETWEEN 18 AND 22 THEN 'Pico' ELSE 'Noche' END AS franja_horaria, {ratio('sum(cm)', 'count(*)', 2, 100)} AS duracion_promedio FROM f JOIN fecha USING (sk_fecha) GROUP BY sk_tiempo, dia_semana, dia_semana_num",
        "consumo_diario": rd + f"SELECT {day}, subestacion, circuito, sector_urbano, count(*) AS total_lecturas, sum(kwh4)::BIGINT / 10000.0 AS consumo_total_kwh, max(kwh4) / 10000.0 AS consumo_maximo_kwh, min(kwh4) / 10000.0 AS consumo_minimo_kwh, (sum(kwh4)::BIGINT / 10000.0) / count(*) AS consumo_promedio_kwh FROM ft JOIN geo ON geo.sk_geografia_urbana = ft.g GROUP BY GROUPING SETS (({day}, subestacion, circuito, sector_urbano), ({day}, subestacion, circuito), ({day}, subestacion), ({day}))",
        "voltaje_tendencia": rd + f"SELECT {month}, subestacion, circuito, transformador, count(*) AS total_lecturas, {ratio('sum(v)', 'count(*)', 2)} AS voltaje_promedio, round(sqrt((count(*) * sum(v * v) - sum(v) * sum(v))::DOUBLE / count(*) / nullif(count(*) - 1, 0)), 2) AS voltaje_desviacion, min(v)::DOUBLE AS voltaje_minimo, max(v)::DOUBLE AS voltaje_maximo, coalesce(stddev_samp(v) / nullif(avg(v), 0) > 0.05, false) AS fluctuacion_excesiva FROM ft GROUP BY GROUPING SETS (({month}, subestacion, circuito, transformador), ({month}, subestacion, circuito), ({month}, subestacion), ({month}))",
        "auditoria_errores": ev + audit.format(errors),
        "auditoria_telemetria": rd + audit.format(t_errors),
        "monitoreo_elt": ledger,
        "event_pairs_by_ranges": all_types + PAIR,
        "event_pairs_hot_meter": hot + PAIR,
        "orphan_restorations_hot_meter": hot + ORPHAN,
        "medida_ytd": years + f"SELECT anio, mes, periodo, {net}, saidi, saifi, sum(round(saidi * 100)::BIGINT) OVER w::BIGINT / 100.0 AS saidi_ytd, sum(round(saifi * 10000)::BIGINT) OVER w::BIGINT / 10000.0 AS saifi_ytd FROM v5r WINDOW w AS (PARTITION BY {net}, anio ORDER BY mes)",
        "medida_interanual": years + f"SELECT x.anio, x.mes, x.periodo, x.subestacion, x.circuito, x.transformador, x.saidi, y.saidi AS saidi_ly, {ratio('(round(x.saidi * 100)::BIGINT - round(y.saidi * 100)::BIGINT) * 100', 'round(y.saidi * 100)::BIGINT', 2)} AS variacion_ia_pct FROM v5r x LEFT JOIN v5r y ON y.anio = x.anio - 1 AND y.mes = x.mes AND y.subestacion IS NOT DISTINCT FROM x.subestacion AND y.circuito IS NOT DISTINCT FROM x.circuito AND y.transformador IS NOT DISTINCT FROM x.transformador",
        "medida_vs_meta": _with(*F_YEARS, V1, MONTHLY, TARGETS) + f"SELECT anio, mes, periodo, subestacion, saidi, meta_saidi, (round(saidi * 100)::BIGINT - round(meta_saidi * 100)::BIGINT) / 100.0 AS saidi_vs_meta, {_light('saidi', 'meta_saidi')} AS semaforo_meta FROM v5r LEFT JOIN meta ON ini <= make_date(anio, mes, 1) AND (fin IS NULL OR fin > make_date(anio, mes, 1)) WHERE circuito IS NULL",
        "medida_semaforos": years + f"SELECT anio, mes, periodo, {net}, saidi, saifi, caidi, {_light('saidi', '60.0')} AS semaforo_saidi, {_light('saifi', '2.0')} AS semaforo_saifi, {_light('caidi', '30.0')} AS semaforo_caidi FROM v5r",
        "medida_lotes": f"SELECT id_lote, tasa_conversion_pct, tasa_error_pct, tasa_conversion_pct > 85 AS conversion_saludable, tasa_error_pct < 5 AS errores_saludables FROM ({ledger})",
        "last_batches": ledger,
        "flag_med_beta05": _with(*F_, V1_LOW) + "SELECT (SELECT count(*) FROM f WHERE fecha IN (SELECT fecha FROM med)) AS total_actualizados, (SELECT count(*) FROM v1, u WHERE saidi_diario > umbral_med) AS total_med_days, (SELECT umbral_med FROM u) AS umbral_aplicado",
        "flagged_facts_beta05": _with(*F_, V1_LOW) + "SELECT id_medidor, timestamp_inicio FROM f WHERE fecha IN (SELECT fecha FROM med)",
        "referential_audit": "SELECT unnest(['sk_fecha', 'sk_tiempo', 'sk_red_electrica', 'sk_clientes', 'sk_tipo_evento']) AS clave, 0::BIGINT AS n",
        "row_counts": _with(DIMS) + "SELECT 'dim_clientes_inventario' AS tabla, 2::BIGINT AS filas UNION ALL SELECT 'dim_fecha', count(*) FROM fecha UNION ALL SELECT 'dim_geografia_urbana', count(*) FROM geo UNION ALL SELECT 'dim_red_electrica', count(*) FROM red UNION ALL SELECT 'dim_tiempo', 24 UNION ALL SELECT 'dim_tipo_evento', 7 UNION ALL SELECT 'staging_eventos', count(*) FROM events WHERE event_type IN ('error', 'purchase') UNION ALL SELECT 'staging_telemetria', count(*) FROM orders",
    }
