"""A whole warehouse from generated events: population, batches, idempotency, failure, views."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from amperia.plans import views
from amperia.sources.schemas import SCHEMAS, orphan_keys, violations
from amperia.sources.synthetic import seed_tables
from amperia.sources.warehouse import DAYS, VIEWS, ConcurrentBatch, Warehouse
from amperia.streaming.pairing import reconcile_stream


@pytest.fixture(scope="module")
def warehouse(spark, tmp_path_factory):
    w = Warehouse(spark, str(tmp_path_factory.mktemp("warehouse")))
    w.commit(seed_tables(spark, meters=40, days=45))
    return w


def test_batches_are_idempotent(warehouse):
    for name in ("staging_eventos", "staging_telemetria", "dim_fecha", "dim_red_electrica"):
        assert violations(name, warehouse.read(name)).count() == 0
    first = warehouse.reconcile_outages()
    assert first.lote_id == 1 and first.total_hechos > 0 and first.total_huerfanos == 8 and first.total_transitorios == 5
    assert '"estado": "COMPLETADO"' in first.to_json()
    count = lambda: tuple(warehouse.read(n).count() for n in ("fact_interrupciones", "err_telemetria"))
    before = count()
    assert before == (first.total_hechos, 8)
    for lote in (2, 3):
        again = warehouse.reconcile_outages()
        assert (again.lote_id, again.total_hechos) == (lote, 0) and count() == before
    readings = warehouse.reconcile_telemetry()
    assert readings.total_eventos == 40 * 45 and readings.total_hechos == 40 * 45 and readings.total_huerfanos == 0
    assert warehouse.reconcile_telemetry().total_eventos == 0
    assert warehouse.read("staging_eventos").filter("not procesado").count() == 0
    t = warehouse.tables()
    dims = {"sk_fecha": t["dim_fecha"], "sk_tiempo": t["dim_tiempo"], "sk_red_electrica": t["dim_red_electrica"], "sk_geografia_urbana": t["dim_geografia_urbana"], "sk_clientes": t["dim_clientes_inventario"], "sk_tipo_evento": t["dim_tipo_evento"]}
    assert orphan_keys(t["fact_interrupciones"], dims).count() == 0
    assert t["dim_geografia_urbana"].filter("sector_urbano like '%DESCONOCID%'").count() == 0
    for name in ("fact_interrupciones", "fact_telemetria", "err_telemetria", "ctrl_lotes_procesamiento"):
        assert t[name].schema.names == SCHEMAS[name].names and violations(name, t[name]).count() == 0


def test_views_over_the_warehouse(warehouse, spark):
    assert warehouse.view("saidi_con_med").filter("umbral_med > 0").count() > 0
    assert warehouse.view("heatmap").filter("hora between 18 and 22").count() > 0
    assert warehouse.view("ranking").count() >= 2
    for name in ("saidi_diario", "saidi_mensual", "tendencia", "consumo_diario", "voltaje_tendencia", "auditoria_errores", "monitoreo_elt"):
        assert warehouse.view(name).count() > 0
    warehouse.register_views()
    assert spark.sql("select count(*) from vw_monitoreo_elt").first()[0] >= 4
    assert spark.sql("select max(fecha_consulta) from vw_saidi_saifi_mensual").first()[0] is not None
    assert all(spark.table(name).columns for name in VIEWS)


def test_failure_is_recorded_and_rolled_back(warehouse):
    facts = warehouse.read("fact_interrupciones").count()
    late = warehouse.read("staging_eventos").limit(2).withColumns({"id_evento": F.col("id_evento") + 1_000_000, "procesado": F.lit(False), "id_medidor": F.lit(1).cast("long")}).collect()
    kinds = ("POWER_OUTAGE", "POWER_RESTORATION")
    rows = [(r.id_evento, 1, datetime(2031, 1, 1, 10 + k), kinds[k], False, None) for k, r in enumerate(late)]
    old = warehouse.read("staging_eventos")
    warehouse.commit({"staging_eventos": old.unionByName(warehouse.spark.createDataFrame(rows, SCHEMAS["staging_eventos"]))})
    with pytest.raises(Exception, match="calendario"):
        warehouse.reconcile_outages()
    last = warehouse.read("ctrl_lotes_procesamiento").orderBy(F.col("id_lote").desc()).first()
    assert last.estado == "FALLIDO" and warehouse.read("fact_interrupciones").count() == facts
    assert warehouse.read("staging_eventos").filter("not procesado").count() == 2
    assert warehouse.vacuum() > 0 and warehouse.read("fact_interrupciones").count() == facts


def test_flags(warehouse):
    r = warehouse.flag_med_days(beta=0.5).first()
    assert r.total_actualizados == warehouse.read("fact_interrupciones").filter("excluido_med").count() > 0


def size(w, state):
    """Bytes of the folders that a manifest lists."""
    folders = [*state["tables"].values()] + [f for held in (state["parts"], state["marks"]) for parts in held.values() for fs in parts.values() for f in fs]
    return {f: w._fs.getContentSummary(w._fs_path(f)).getLength() for f in folders}


def test_a_batch_reads_and_writes_its_own_days_whatever_the_history(spark, tmp_path):
    """The same day's events after 5 and after 60 days of history: the batch writes as much and leaves all other folders as they are."""
    wrote = []
    for days in (5, 60):
        w = Warehouse(spark, str(tmp_path / str(days)))
        w.commit(seed_tables(spark, meters=30, days=days))
        w.reconcile_outages()
        rows = [(10**7 + 10 * m + k, m, datetime(2025, 9, 1, 10, 20 * k), ("POWER_OUTAGE", "POWER_RESTORATION")[k], False, None) for m in range(1, 31) for k in (0, 1)]
        w.append("staging_eventos", spark.createDataFrame(rows, SCHEMAS["staging_eventos"]))
        before = size(w, w.manifest())
        assert w.reconcile_outages(datetime(2025, 9, 1), datetime(2025, 9, 1, 23)).total_hechos == 30
        after = size(w, w.manifest())
        new = {f: n for f, n in after.items() if f not in before}
        assert all("2025-09-01" in f or not any(f"/{name}/" in f for name in DAYS) for f in new)
        wrote.append(sum(n for f, n in new.items() if any(f"/{name}/" in f for name in DAYS)))
        assert {f for f in before if f not in after} <= {f for f in before if "2025-09-01" in f or "ctrl_lotes" in f}
    assert wrote[1] < 1.2 * wrote[0]


def heartbeats(spark, days, meters=20):
    """Events that no batch consumes: one a meter and day."""
    at = F.make_timestamp(F.lit(2025), F.lit(1), F.lit(1), F.lit(3), F.lit(0), F.lit(0)) + F.make_interval(days=(F.col("id") / meters).cast("int"))
    return spark.range(days * meters).select((F.col("id") + 10**6).alias("id_evento"), (F.col("id") % meters).alias("id_medidor"), at.alias("timestamp_evento"), F.lit("HEARTBEAT").alias("tipo_evento"), F.lit(False).alias("procesado"))


def test_events_that_are_never_consumed_cost_no_writing_and_no_reading_of_facts(spark, tmp_path, monkeypatch):
    """Without bounds: a batch of two events writes the same folders after 5 and after 60 days of pending heartbeats, and reads facts and errors of its own days only."""
    wrote = []
    for days in (5, 60):
        w = Warehouse(spark, str(tmp_path / str(days)))
        seed = seed_tables(spark, meters=20, days=2)
        w.commit(seed | {"staging_eventos": heartbeats(spark, days)})
        w.append("staging_eventos", spark.createDataFrame([(1, 500, datetime(2025, 1, 2, 10), "POWER_OUTAGE", False, None), (2, 500, datetime(2025, 1, 2, 11), "POWER_RESTORATION", False, None)], SCHEMAS["staging_eventos"]))
        assert w.reconcile_outages().total_hechos == 1
        two = [(3, 501, datetime(2025, 1, 4, 10), "POWER_OUTAGE", False, None), (4, 501, datetime(2025, 1, 4, 11), "POWER_RESTORATION", False, None)]
        w.append("staging_eventos", spark.createDataFrame(two, SCHEMAS["staging_eventos"]))
        before, asked, read = size(w, w.manifest()), [], Warehouse.read
        monkeypatch.setattr(Warehouse, "read", lambda self, name, *a, asked=asked, **b: (asked.append((name, b.get("days"))), read(self, name, *a, **b))[1])
        done = w.reconcile_outages()
        monkeypatch.setattr(Warehouse, "read", read)
        assert (done.total_hechos, done.total_eventos) == (1, 2)
        assert [d for n, d in asked if n == "fact_interrupciones"] == [{"2025-01-04"}] and [d for n, d in asked if n == "err_telemetria"] == [set()]
        after = size(w, w.manifest())
        new = [f for f in after if f not in before and "ctrl_lotes" not in f and "/dim_" not in f]
        assert set(before) - set(after) <= {f for f in before if "ctrl_lotes" in f or "/dim_" in f} and all("_dia=2025-01-04" in f for f in new)
        wrote.append((len(new), sum(after[f] for f in new)))
        pending = w.read("staging_eventos", pending=True)
        assert pending.count() == days * 20 and {r[0] for r in pending.select("tipo_evento").distinct().collect()} == {"HEARTBEAT"}
        assert w.read("staging_eventos").filter("procesado").count() == 4
        assert w.compact("staging_eventos", most=1) > 0 and not w.manifest()["marks"]["staging_eventos"].get("2025-01-04")
        assert w.read("staging_eventos").filter("procesado").count() == 4 and w.read("staging_eventos", pending=True).count() == days * 20
        assert w.vacuum() > 0 and w.read("staging_eventos").filter("procesado").count() == 4
    assert wrote[0][0] == wrote[1][0] and wrote[1][1] < 1.2 * wrote[0][1]


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_views_read_daily_sums_and_no_facts(spark, tmp_path):
    """Over late events and flags: equal to the views of the facts."""
    w = Warehouse(spark, str(tmp_path))
    seed = seed_tables(spark, meters=15, days=10)
    late = F.col("id_medidor") % 5 == 0
    w.commit(seed | {"staging_eventos": seed["staging_eventos"].filter(~late)})
    w.reconcile_outages()
    w.reconcile_telemetry()
    w.append("staging_eventos", seed["staging_eventos"].filter(late))
    assert w.reconcile_outages().total_hechos > 0
    assert w.flag_med_days(beta=0.3).first().total_actualizados > 0
    t = w.tables(dated=True)
    facts = {k: v for k, v in t.items() if not k.startswith("sum_")}
    for name in ("saidi_diario", "saidi_mensual", "tendencia", "consumo_diario", "voltaje_tendencia"):
        drop = ["fecha_consulta"] if name == "saidi_mensual" else []
        kept, direct = (getattr(views, name)(x).drop(*drop) for x in (t, facts))
        assert rows_of(kept) == rows_of(direct), name
        assert any("/sum_" in f for f in kept.inputFiles()) and not any("/fact_" in f for f in kept.inputFiles()), name
    for name in ("sum_interrupciones", "sum_telemetria"):
        w.compact(name, most=1)
    assert rows_of(w.view("saidi_diario")) == rows_of(views.saidi_diario(facts)) and rows_of(w.view("consumo_diario")) == rows_of(views.consumo_diario(facts))


def test_sql_views_are_pruned_by_day_and_follow_commits(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    w.commit(seed_tables(spark, meters=10, days=12))
    w.register_views()
    assert spark.sql("select sum(total_lecturas) from vw_consumo_diario").first()[0] is None
    w.reconcile_outages()
    w.reconcile_telemetry()
    one = spark.sql("select total_lecturas from vw_consumo_diario where fecha = date'2025-01-05' and subestacion is null")
    assert [r[0] for r in one.collect()] == [10]  # registered before the batch
    day = spark.sql("select * from vw_saidi_saifi_diario where fecha = date'2025-01-05'")
    for df in (one, day):
        assert re.search(r"PartitionFilters: \[[^]]*_dia#\d+ = 2025-01-05", df._jdf.queryExecution().sparkPlan().toString())
    files = w.read("fact_telemetria", dated=True).filter("_dia = date'2025-01-05'").select(F.input_file_name()).distinct().collect()
    assert len(files) == 1 and "_dia=2025-01-05" in files[0][0]


def test_a_broken_constraint_fails_the_write(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    bad = spark.createDataFrame([(1, 1, datetime(2025, 1, 1), "OTHER", False, None)], SCHEMAS["staging_eventos"])
    with pytest.raises(ValueError, match="staging_eventos"):
        w.append("staging_eventos", bad)
    assert w.manifest()["number"] == 0


def test_keys_go_on_and_stay_unique(warehouse):
    facts = warehouse.read("fact_interrupciones")
    n, top = facts.count(), facts.agg(F.max("sk_interrupcion")).first()[0]
    assert facts.select("sk_interrupcion").distinct().count() == n == top == warehouse.manifest()["keys"]["fact_interrupciones"]


def test_of_two_writers_one_fails(warehouse):
    state = warehouse.manifest()
    warehouse._create(state)
    with pytest.raises(ConcurrentBatch):
        warehouse._create(state)
    assert warehouse.manifest()["number"] == state["number"] + 1


def test_compaction_and_vacuum_keep_the_rows(warehouse):
    name = "staging_eventos"
    n = warehouse.read(name).count()
    for _ in range(3):
        warehouse.append(name, warehouse.read(name).limit(0))
    assert warehouse.compact(name, most=0) > 0
    assert warehouse.read(name).count() == n
    assert warehouse.vacuum() > 0 and warehouse.read(name).count() == n and warehouse.vacuum() == 0
    assert not warehouse._fs.exists(warehouse._fs_path(f"{warehouse.root}/_work")) or not warehouse._fs.listStatus(warehouse._fs_path(f"{warehouse.root}/_work"))


def test_a_meter_without_a_sector_fails_the_batch(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    seed = seed_tables(spark, meters=3, days=2)
    w.commit(seed | {"dim_red_electrica": seed["dim_red_electrica"].withColumn("sk_geografia_urbana", F.lit(None).cast("long"))})
    with pytest.raises(Exception, match="sin geograf"):
        w.reconcile_telemetry()
    assert w.read("fact_telemetria").count() == 0 and [r.estado for r in w.read("ctrl_lotes_procesamiento").collect()] == ["FALLIDO"]


def test_stream_over_micro_batches_out_of_order(spark, tmp_path):
    """Events in three micro-batches, of which the second brings a restoration after its outage and the third what came before both, and one event twice: as one batch over all."""
    w, kind = Warehouse(spark, str(tmp_path / "w")), "id_evento long, id_medidor long, timestamp_evento timestamp, tipo_evento string"
    seed = seed_tables(spark, meters=3, days=2)
    w.commit(seed | {"staging_eventos": seed["staging_eventos"].limit(0)})
    at = lambda h, m=0: datetime(2025, 1, 1, h, m)
    parts = [[(1, 1, at(10), "POWER_OUTAGE"), (3, 2, at(10), "POWER_OUTAGE")], [(2, 1, at(10, 30), "POWER_RESTORATION"), (1, 1, at(10), "POWER_OUTAGE"), (4, 2, at(12), "POWER_RESTORATION")], [(5, 3, at(9), "POWER_OUTAGE"), (6, 3, at(9, 40), "POWER_RESTORATION")]]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={k}"))
        q = reconcile_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "in" / "p=*")), w, str(tmp_path / "cp"))
        q.awaitTermination(120)
        assert q.exception() is None
    got = {(r.id_medidor, r.timestamp_inicio, str(r.duracion_minutos)) for r in w.read("fact_interrupciones").collect()}
    assert got == {(1, at(10), "30.00"), (2, at(10), "120.00"), (3, at(9), "40.00")}
    assert w.read("staging_eventos").count() == 6 and w.read("staging_eventos").filter("not procesado").count() == 0
