"""Streams in event time against the batch over the same rows; a feed with malformed lines."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from amperia.operators.pairing import pairs, pairs_by_ranges, ranged
from amperia.plans.telemetry import telemetry_facts
from amperia.sources.feed import BAD_LINE, bad, good, lines, parsed
from amperia.sources.interim import stored
from amperia.sources.synthetic import seed_tables
from amperia.streaming.windows import daily_readings, stream_pairs, stream_readings

EVENTS = "id_evento long, id_medidor long, timestamp_evento timestamp, tipo_evento string"


def run(spark, tmp_path, parts, schema, build):
    """What a stream gives that gets the parts one after the other, and the rows in state at the end."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={k}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "p=*"))
    q = build(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.read.parquet(str(tmp_path / "out")), sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"])


def some_events(seed, n, meters=4):
    r, kinds = random.Random(seed), ["POWER_OUTAGE", "POWER_RESTORATION", "HEARTBEAT"]
    return [(k, r.randrange(meters), datetime(2025, 1, 1) + timedelta(minutes=10 * k + r.randrange(9)), r.choices(kinds, (5, 5, 1))[0]) for k in range(n)]


def test_stream_of_outages_out_of_order(spark, tmp_path):
    rows = some_events(1, 120)
    r = random.Random(2)
    mixed = sorted(rows, key=lambda x: x[2] + timedelta(minutes=r.randrange(100)))  # less than the delay
    end = [(10**6, 99, datetime(2025, 2, 1), "POWER_OUTAGE")]
    parts = [mixed[k : k + 40] for k in range(0, 120, 40)] + [end, [(10**6 + 1, 99, datetime(2025, 2, 2), "POWER_OUTAGE")]]
    got, held = run(spark, tmp_path, parts, EVENTS, lambda s: stream_pairs(s, "2 hours", "3 days"))
    want = pairs(spark.createDataFrame(rows, EVENTS))
    columns = want.columns
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.collect()))
    assert {x.clasificacion for x in got.collect()} >= {"PAR_VALIDO", "DOBLE_OUTAGE", "OUTAGE_ABIERTO"}
    assert held <= 6  # the two last ones; nothing of the 120 events is left in state


def test_stream_of_readings_gives_the_hourly_facts(spark, tmp_path):
    t = seed_tables(spark, meters=6, days=3)
    kind = "id_staging long, id_medidor long, timestamp_lectura timestamp, consumo_wh decimal(12,2), voltaje decimal(8,2), tipo_lectura string"
    base = [tuple(x) for x in t["staging_telemetria"].select("id_staging", "id_medidor", "timestamp_lectura", "consumo_wh", "voltaje", "tipo_lectura").collect()]
    more = [(10**6 + k, m, at + timedelta(minutes=1 + k % 7), wh + 1, v, x) for k, (_, m, at, wh, v, x) in enumerate(base)]  # a second one in the hour
    rows = sorted(more + base, key=lambda x: (x[2].date(), -x[0]))  # the later one comes first
    n = len(rows) // 3
    parts = [rows[:n], rows[n : 2 * n], [*rows[2 * n :], rows[-1]], [(10**7, -1, datetime(2026, 1, 1), base[0][3], base[0][4], base[0][5])], [(10**7 + 1, -1, datetime(2026, 1, 2), base[0][3], base[0][4], base[0][5])]]
    got, held = run(spark, tmp_path / "a", parts, kind, lambda s: stream_readings(s, t, "30 hours"))
    want = telemetry_facts(t, spark.createDataFrame(rows, kind))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) and got.count() == len(base)
    assert held == 0
    sums, _ = run(spark, tmp_path / "b", parts, kind, lambda s: daily_readings(s, "30 hours"))
    direct = spark.createDataFrame(rows, kind).groupBy(F.to_date("timestamp_lectura").alias("fecha"), "id_medidor").agg(F.count("*").alias("n"), F.sum("consumo_wh").alias("w"))
    assert {(x.fecha, x.id_medidor): (x.n, x.consumo_wh) for x in sums.collect()} == {(x.fecha, x.id_medidor): (x.n, x.w) for x in direct.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_ranges_of_one_hot_meter(spark, seed):
    """Most events are of one meter: spread over ranges, pairs as without; runs of orphans fill whole ranges."""
    rows = [(k, 1 if k % 9 else k % 5, at, kind) for k, _, at, kind in some_events(seed, 400)]
    if seed == 2:
        rows = [(k, m, at, "POWER_RESTORATION" if 40 < k < 350 else kind) for k, m, at, kind in rows]
    df = spark.createDataFrame(rows, EVENTS).repartition(3)
    assert ranged(df, stored, 6).filter("id_medidor = 1").select("parte").distinct().count() >= 3
    got = pairs_by_ranges(df, stored, 6)
    assert sorted(map(str, got.collect())) == sorted(map(str, pairs(df).select(*got.columns).collect()))


def test_feed_with_malformed_lines(spark, tmp_path):
    ok = {"id_evento": 1, "id_medidor": 7, "timestamp_evento": "2025-01-01T10:00:00Z", "tipo_evento": "POWER_OUTAGE"}
    wrong = ["{not json", '{"id_evento": 2}', json.dumps(ok | {"id_medidor": "x"}), json.dumps(ok | {"timestamp_evento": "yesterday"}), json.dumps(ok | {"tipo_evento": "NONSENSE"}), json.dumps(ok | {"tipo_evento": None})]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join([json.dumps(ok), *wrong, "", wrong[0], json.dumps(ok | {"id_evento": "3", "more": [1]})]))
    rows = parsed(lines(spark, str(tmp_path / "in")))
    assert {(r.id_evento, r.id_medidor, r.tipo_evento) for r in good(rows).collect()} == {(1, 7, "POWER_OUTAGE"), (3, 7, "POWER_OUTAGE")}
    errors = bad(rows).collect()
    assert sorted(json.loads(r.detalle_tecnico)["linea"] for r in errors) == sorted(wrong) and {r.tipo_error for r in errors} == {BAD_LINE}
    assert sorted(r.motivo_error.split(": ")[1] for r in errors) == ["JSON ilegible", "falta id_medidor", "falta tipo_evento", "id_medidor no es válido", "timestamp_evento no es válido", "tipo_evento desconocido"]
    assert bad(rows, bad(rows)).count() == 0
