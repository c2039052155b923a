"""Hand-written cases of pairing and reconciliation, one meter each."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException

from amperia.functions.calendar import dim_fecha, dim_tiempo
from amperia.operators import pairing
from amperia.plans import outages
from amperia.sources.schemas import EVENT_CATALOGUE

T0 = datetime(2025, 3, 1, 10)
O, R, H = "POWER_OUTAGE", "POWER_RESTORATION", "HEARTBEAT"
EVENTS = "id_evento long, id_medidor long, timestamp_evento timestamp, tipo_evento string, procesado boolean"
NETWORK = "sk_red_electrica long, id_medidor long, id_medidor_origen long, codigo_medidor string, transformador string, circuito string, subestacion string, sk_geografia_urbana long, fecha_inicio timestamp, fecha_fin timestamp, activo_bool boolean"
INVENTORY = "sk_clientes long, total_clientes_servidos int, fecha_inicio timestamp, fecha_fin timestamp, activo_bool boolean, version int"


def minute(m):
    return T0 + timedelta(minutes=m)


def events(spark, cases, done=()):
    """cases: by meter, (type, minutes after T0)."""
    rows = [(meter * 100 + k, meter, minute(m), kind, False) for meter, case in cases.items() for k, (kind, m) in enumerate(case)]
    return spark.createDataFrame(rows, EVENTS)


def tables(spark, cases, network=(), inventory=()):
    meters = list(cases)
    net = network or [(m, m, m, f"MED-{m}", "T", "C", "S", 1, datetime(2024, 1, 1), None, True) for m in meters]
    inv = inventory or [(1, 100, datetime(2024, 1, 1), None, True, 1)]
    return {
        "staging_eventos": events(spark, cases), "dim_fecha": dim_fecha(spark), "dim_tiempo": dim_tiempo(spark), "dim_red_electrica": spark.createDataFrame(net, NETWORK), "dim_clientes_inventario": spark.createDataFrame(inv, INVENTORY),
        "dim_geografia_urbana": spark.createDataFrame([(1, "A", "D")], "sk_geografia_urbana long, sector_urbano string, distrito string"),
        "dim_tipo_evento": spark.createDataFrame(list(EVENT_CATALOGUE), "sk_tipo_evento long, codigo_evento string, categoria string, severidad string, es_critico boolean"),
    }


def test_classes_and_durations(spark):
    cases = {
        1: [(O, 0), (R, 30)],
        2: [(O, 0), (R, 4 + 59.6 / 60)],
        3: [(O, 0), (R, 4 + 59.7 / 60)],
        4: [(R, 0)],
        5: [(O, 0), (R, 10), (R, 20)],
        6: [(O, 0), (O, 10), (R, 30)],
        7: [(O, 0)],
        8: [(O, 0), (H, 5), (R, 10)],
    }
    e = events(spark, cases)
    p = {r.id_outage: (r.clasificacion, r.duracion_minutos) for r in pairing.pairs(e).collect()}
    assert p == {
        100: ("PAR_VALIDO", Decimal("30.00")), 200: ("PAR_VALIDO", Decimal("4.99")), 300: ("PAR_VALIDO", Decimal("5.00")), 500: ("PAR_VALIDO", Decimal("10.00")), 600: ("DOBLE_OUTAGE", None), 601: ("PAR_VALIDO", Decimal("20.00")),
        700: ("OUTAGE_ABIERTO", None), 800: ("ERROR_DESCONOCIDO", None),
    }
    lone = {r.id_evento: r.huerfana for r in pairing.orphans(e).collect()}
    assert lone == {400: pairing.NO_OUTAGE_BEFORE, 502: pairing.CONSECUTIVE}
    batch = outages.reconcile_outages(tables(spark, cases))
    assert sorted(r.id_medidor for r in batch["hechos"].collect()) == [1, 3, 5, 6]
    c = batch["contadores"].first()
    assert (c.total_eventos, c.total_hechos, c.total_huerfanos, c.total_transitorios) == (5 * 2 + 3, 4, 3, 1)
    assert {r.id_evento for r in batch["procesados"].collect()} == {100, 101, 200, 201, 300, 301, 400, 500, 501, 502, 600, 601, 602}


def test_bounds_are_inclusive_and_late_restorations_are_orphans(spark):
    t = tables(spark, {1: [(O, 0), (R, 30)], 2: [(O, -10), (R, 20)]})
    batch = outages.reconcile_outages(t, minute(0), minute(30))
    assert [r.id_medidor for r in batch["hechos"].collect()] == [1]
    assert [r.id_evento_origen for r in batch["errores"].collect()] == [201]
    assert pairing.pending(t["staging_eventos"], "timestamp_evento", minute(0), minute(29)).count() == 2


def test_latest_version_that_holds_and_half_open_validity(spark):
    net = [(1, 1, 1, "a", "T", "C", "S", 1, datetime(2024, 1, 1), T0, False), (2, 1, 1, "b", "T", "C", "S", 1, T0, None, True)]
    hechos = outages.reconcile_outages(tables(spark, {1: [(O, 0), (R, 30)]}, net))["hechos"].collect()
    assert [r.sk_red_electrica for r in hechos] == [2]
    early = outages.reconcile_outages(tables(spark, {1: [(O, -60), (R, -30)]}, net))["hechos"].collect()
    assert [r.sk_red_electrica for r in early] == [1]  # that a version is not active any more does not matter here


def test_fallback_does_not_shadow_a_version_that_holds(spark):
    net = [(7, 1, 1, "a", "T", "C", "S", 1, datetime(2024, 1, 1), minute(60), True)]
    batch = outages.reconcile_outages(tables(spark, {1: [(O, 0), (R, 30), (O, 120), (R, 150)], 2: [(O, 0), (R, 9)]}, net))
    got = {(r.id_medidor, r.timestamp_inicio): (r.sk_red_electrica, r.sk_geografia_urbana) for r in batch["hechos"].collect()}
    assert got == {(1, minute(0)): (7, 1), (1, minute(120)): (8, 2), (2, minute(0)): (9, 2)}
    new = {r.id_medidor: (r.codigo_medidor, r.fecha_inicio) for r in batch["red_nueva"].collect()}
    assert new == {1: ("MED-1", minute(120) - timedelta(days=1)), 2: ("MED-2", minute(0) - timedelta(days=1))}
    assert [(r.sk_geografia_urbana, r.sector_urbano) for r in batch["geografia_nueva"].collect()] == [(2, outages.UNKNOWN_SECTOR)]


def test_inventory_fallback(spark):
    batch = outages.reconcile_outages(tables(spark, {1: [(O, 0), (R, 30)]}, inventory=[(4, 10, datetime(2026, 1, 1), None, True, 1)]))
    assert [r.sk_clientes for r in batch["hechos"].collect()] == [5]
    assert [(r.sk_clientes, r.total_clientes_servidos) for r in batch["clientes_nuevo"].collect()] == [(5, 1)]


def test_out_of_calendar_fails(spark):
    t = tables(spark, {1: [(O, 0), (R, 30)]})
    t["dim_fecha"] = dim_fecha(spark, "2024-01-01", "2024-12-31")
    with pytest.raises(PySparkException, match="calendario"):
        outages.reconcile_outages(t)["hechos"].collect()


def test_empty_and_repeated_events(spark):
    assert outages.reconcile_outages(tables(spark, {1: []}, network=[(1, 1, 1, "a", "T", "C", "S", 1, datetime(2024, 1, 1), None, True)]))["contadores"].first().total_eventos == 0
    e = events(spark, {1: [(O, 0), (R, 30)]})
    assert pairing.pairs(e.filter("false")).count() == 0
