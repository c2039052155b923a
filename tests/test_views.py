"""Major event days, flags, numbers."""

from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from amperia.functions.calendar import dim_fecha, dim_tiempo
from amperia.functions.numeric import minutes, ratio
from amperia.operators.changes import insert_ignore, sequential_keys, update, upsert
from amperia.plans import views
from amperia.sources.schemas import EVENT_CATALOGUE, SCHEMAS, overlapping_versions, violations


def schema(spark, minutes_by_day):
    """A grid of one meter and 10 customers with an outage of so many minutes on each day from 2025-01-01."""
    rows = [(k + 1, 366 + k + 1, 11, 1, 1, 1, 1, 1, datetime(2025, 1, 1, 10) + timedelta(days=k), None, Decimal(m), 1, 1, False, None) for k, m in enumerate(minutes_by_day) if m]
    return {
        "dim_fecha": dim_fecha(spark, "2024-01-01", "2025-12-31"), "dim_tiempo": dim_tiempo(spark), "fact_interrupciones": spark.createDataFrame(rows, SCHEMAS["fact_interrupciones"]),
        "dim_clientes_inventario": spark.createDataFrame([(1, 10, datetime(2024, 1, 1), None, True, 1)], "sk_clientes long, total_clientes_servidos int, fecha_inicio timestamp, fecha_fin timestamp, activo_bool boolean, version int"),
        "dim_red_electrica": spark.createDataFrame([(1, "T", "C", "S")], "sk_red_electrica long, transformador string, circuito string, subestacion string"),
        "dim_tipo_evento": spark.createDataFrame(list(EVENT_CATALOGUE), "sk_tipo_evento long, codigo_evento string, categoria string, severidad string, es_critico boolean"),
    }


def test_no_spread_makes_every_outage_day_a_major_event_day(spark):
    t = schema(spark, [30])
    assert views.umbral_med(views.saidi_diario(t)).first().umbral_med == 0
    assert [r.fecha.day for r in views.med_dates(t).collect()] == [1]
    assert views.saidi_mensual(t).count() == 0


def test_one_catastrophic_day(spark):
    t = schema(spark, [10 + k % 3 for k in range(29)] + [2000])
    assert [r.fecha.day for r in views.med_dates(t).collect()] == [30]
    month = {r.subestacion: r for r in views.saidi_mensual(t).filter("circuito is null").collect()}
    assert month[None].total_interrupciones == 29 and month["S"].saidi == Decimal(sum(10 + k % 3 for k in range(29))) / 10
    flagged, report = views.flag_med(t)
    r = report.first()
    assert (r.total_actualizados, r.total_med_days) == (1, 1)
    assert [x.timestamp_inicio.day for x in flagged.filter("excluido_med").collect()] == [30]
    assert views.saidi_diario(t | {"fact_interrupciones": flagged}).filter("saidi_diario > 100").count() == 0


def test_ordered_for_presentation(spark):
    t = schema(spark, [10, 20, 30, 0, 50])
    days = [r.fecha for r in views.dashboard_order("saidi_diario", views.saidi_diario(t)).collect()]
    assert days == sorted(days, reverse=True)


@pytest.mark.parametrize("num,den,places", [("0.05", 2, 1), ("-0.05", 2, 1), ("123456789012.34", 7, 4), ("1", 3, 4), ("2.5", 1, 0)])
def test_ratio_rounds_once(spark, num, den, places):
    df = spark.createDataFrame([(Decimal(num), den)], "n decimal(20,2), d int")
    exact = (Decimal(num) / den).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)
    assert df.select(ratio(F.col("n"), F.col("d"), 2, places)).first()[0] == exact
    assert df.select(ratio(F.col("n"), F.lit(0), 2, places)).first()[0] is None


def test_minutes(spark):
    df = spark.createDataFrame([(datetime(2025, 1, 1), datetime(2025, 1, 1, 0, 4, 59, 700000))], "a timestamp, b timestamp")
    assert df.select(minutes(F.col("a"), F.col("b"))).first()[0] == Decimal("5.00")


def test_changes(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    rows = spark.createDataFrame([(2, "x"), (3, "z"), (3, "y")], "k long, v string")
    assert sorted(insert_ignore(t, rows, ["k"], [F.col("v")]).collect()) == [(3, "y")]
    assert sorted(upsert(t, rows.filter("k = 2"), ["k"]).collect()) == [(1, "a"), (2, "x")]
    assert sorted(update(t, spark.createDataFrame([(1,), (1,)], "id long"), "k", {"v": F.lit("u")}).collect()) == [(1, "u"), (2, "b")]
    days = spark.createDataFrame([(d, x) for d in (3, 1, 2) for x in (2, 1)], "d int, x int")
    keyed = sorted(sequential_keys(days, "sk", F.col("d"), ["x"], 10).collect())
    assert keyed == [(11, 1, 1), (12, 1, 2), (13, 2, 1), (14, 2, 2), (15, 3, 1), (16, 3, 2)]


def test_violations(spark):
    days = dim_fecha(spark)
    assert days.count() == 1096 and violations("dim_fecha", days).count() == 0
    bad = spark.createDataFrame([(1, 1, datetime(2025, 1, 1), "NOISE", False, None)] * 2, SCHEMAS["staging_eventos"])
    assert {r["constraint"]: r.n for r in violations("staging_eventos", bad).collect()} == {"check tipo_evento": 2, "unique": 1}
    v = spark.createDataFrame([(1, datetime(2024, 1, 1), None), (2, datetime(2025, 1, 1), None)], "sk long, fecha_inicio timestamp, fecha_fin timestamp")
    assert overlapping_versions(v).count() == 1
