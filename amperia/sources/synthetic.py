"""A small grid with outages and readings, for demonstrations and tests: rows made by Spark from a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.calendar import dim_fecha, dim_tiempo
from .schemas import EVENT_CATALOGUE

#: Relative frequency of an outage's start by hour, with a peak in the evening.
HOUR_WEIGHTS = (1, 1, 1, 1, 1, 2, 3, 4, 4, 4, 4, 4, 4, 4, 4, 4, 5, 7, 10, 11, 11, 10, 7, 3)
#: Share, log mean and log deviation of short, middle and long outages in minutes.
DURATIONS = ((0.70, 3.2, 0.5), (0.25, 4.3, 0.5), (0.05, 5.5, 0.4))
SHORTEST, LONGEST, GAP_MINUTES = 5.1, 720.0, 5
RELIABILITY = (1.0, 1.5, 2.0)  # by meter profile
c = F.col


def unit(seed: int, *on: str) -> Column:
    """A number in [0, 1) that depends on the seed and the columns alone, so every run and every partitioning agree."""
    return F.pmod(F.xxhash64(F.lit(seed), *on), F.lit(1 << 40)) / float(1 << 40)


def weighted(u: Column, weights: tuple[float, ...]) -> Column:
    """Index of the weight in which a uniform number falls."""
    total, sums = float(sum(weights)), []
    for w in weights:
        sums.append((sums[-1] if sums else 0.0) + w)
    found = F.lit(len(weights) - 1)
    for k in range(len(weights) - 2, -1, -1):
        found = F.when(u < sums[k] / total, k).otherwise(found)
    return found


def network(spark: SparkSession, meters: int = 300, substations: int = 3, circuits: int = 2, transformers: int = 3, first: str = "2025-01-01") -> DataFrame:
    m = spark.range(1, meters + 1).withColumnRenamed("id", "id_medidor")
    t = (c("id_medidor") - 1) % (substations * circuits * transformers)
    pad = lambda name, x: F.format_string(f"{name}-%02d", x + 1)
    return m.select(
        c("id_medidor").alias("sk_red_electrica"), "id_medidor", c("id_medidor").alias("id_medidor_origen"), F.format_string("MED-%05d", "id_medidor").alias("codigo_medidor"),
        pad("TRF", t).alias("transformador"), pad("CIR", F.expr(f"((id_medidor - 1) % {substations * circuits * transformers}) div {transformers}")).alias("circuito"), pad("SUB", F.expr(f"((id_medidor - 1) % {substations * circuits * transformers}) div {transformers * circuits}")).alias("subestacion"),
        (c("id_medidor") % 8 + 1).alias("sk_geografia_urbana"), F.lit(75).cast("decimal(10,2)").alias("capacidad_kva"), F.lit("ACTIVO").alias("estado_operativo"), F.lit(first).cast("timestamp").alias("fecha_inicio"), F.lit(None).cast("timestamp").alias("fecha_fin"), F.lit(True).alias("activo_bool"),
    )


def outage_events(net: DataFrame, days: int = 60, first: str = "2025-01-01", seed: int = 42, rate: float = 0.25, bad_days: tuple[int, ...] = (20, 41), orphans: int = 5, transients: int = 5, doubles: int = 3) -> DataFrame:
    """Outages and restorations of each meter: lognormal durations, evening peak, a few very bad days, and some faults of every kind. Every outage is closed."""
    grid = net.select("id_medidor").withColumn("dia", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    profile = F.element_at(F.array(*map(F.lit, RELIABILITY)), (c("id_medidor") % 3 + 1).cast("int"))
    chance = F.least(F.lit(1.0), rate * profile * F.when(c("dia").isin(*bad_days), 8.0).otherwise(1.0))
    hit = grid.filter(unit(seed, "id_medidor", "dia") < chance)
    kind = weighted(unit(seed + 1, "id_medidor", "dia"), tuple(d[0] for d in DURATIONS))
    mean, spread = (F.element_at(F.array(*(F.lit(d[k]) for d in DURATIONS)), kind + 1) for k in (1, 2))
    normal = F.sqrt(-2 * F.log(F.greatest(unit(seed + 2, "id_medidor", "dia"), F.lit(1e-9)))) * F.cos(2 * F.pi() * unit(seed + 3, "id_medidor", "dia"))
    minutes = F.greatest(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.exp(mean + spread * normal)))
    start = F.lit(first).cast("timestamp").cast("double") + c("dia") * 86400 + weighted(unit(seed + 4, "id_medidor", "dia"), HOUR_WEIGHTS) * 3600 + F.floor(unit(seed + 5, "id_medidor", "dia") * 3600)
    raw = hit.select("id_medidor", start.alias("a"), (start + F.floor(minutes * 60)).alias("b"))
    # An outage that begins before the one ahead of it has ended, or within the gap, is dropped.
    line = W.partitionBy("id_medidor").orderBy("a")
    kept = raw.withColumn("busy", F.max("b").over(line.rowsBetween(W.unboundedPreceding, -1))).filter(c("busy").isNull() | (c("a") >= c("busy") + GAP_MINUTES * 60))
    event = lambda at, kind: F.struct(at.alias("at"), F.lit(kind).alias("tipo_evento"))
    regular = kept.select("id_medidor", F.explode(F.array(event(c("a"), "POWER_OUTAGE"), event(c("b"), "POWER_RESTORATION"))).alias("e"))
    day_zero = F.lit(first).cast("timestamp").cast("double")

    def injected(n: int, hour: int, events: list[tuple[float, str]], at_seed: int) -> DataFrame:
        """Faults of n meters, before the first day so that nothing is between them."""
        chosen = net.select("id_medidor").orderBy(unit(at_seed, "id_medidor"), "id_medidor").limit(n)
        return chosen.select("id_medidor", F.explode(F.array(*(event(day_zero - 86400 + hour * 3600 + s, k) for s, k in events))).alias("e"))

    faults = [injected(orphans, 1, [(0, "POWER_RESTORATION")], seed + 6), injected(transients, 5, [(0, "POWER_OUTAGE"), (120, "POWER_RESTORATION")], seed + 7), injected(doubles, 9, [(0, "POWER_OUTAGE"), (600, "POWER_OUTAGE"), (3000, "POWER_RESTORATION")], seed + 8)]
    for f in faults:
        regular = regular.unionByName(f)
    named = regular.select("id_medidor", c("e.at").cast("timestamp").alias("timestamp_evento"), c("e.tipo_evento").alias("tipo_evento"))
    order = W.orderBy("timestamp_evento", "id_medidor", "tipo_evento")  # a fixture's few rows
    return named.select(F.row_number().over(order).cast("long").alias("id_evento"), "id_medidor", "timestamp_evento", "tipo_evento", F.lit(False).alias("procesado"), F.current_timestamp().alias("fecha_carga"))


def readings(net: DataFrame, days: int = 60, first: str = "2025-01-01", seed: int = 42) -> DataFrame:
    """One valid reading a meter and day: 215 to 225 volts, energy by hour within 15 %."""
    grid = net.select("id_medidor").withColumn("dia", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    hour = weighted(unit(seed + 10, "id_medidor", "dia"), (1,) * 24)
    at = (F.lit(first).cast("timestamp").cast("double") + c("dia") * 86400 + hour * 3600 + 600).cast("timestamp")
    load = F.element_at(F.array(*(F.lit(float(w)) for w in HOUR_WEIGHTS)), hour + 1) / (sum(HOUR_WEIGHTS) / 24)
    wh = (2000 * load * (0.85 + 0.3 * unit(seed + 11, "id_medidor", "dia"))).cast("decimal(12,2)")
    volts = (215 + 10 * unit(seed + 12, "id_medidor", "dia")).cast("decimal(8,2)")
    return grid.select((c("id_medidor") * 100_000 + c("dia")).alias("id_staging"), "id_medidor", at.alias("timestamp_lectura"), wh.alias("consumo_wh"), volts.alias("voltaje"), F.lit("LECTURA_PERIODICA").alias("tipo_lectura"), F.lit(False).alias("procesado"), F.current_timestamp().alias("fecha_carga"))


def seed_tables(spark: SparkSession, meters: int = 300, days: int = 60, first: str = "2025-01-01", seed: int = 42) -> dict[str, DataFrame]:
    """All tables of a warehouse before its first batch."""
    net = network(spark, meters, first="2024-12-01")
    day = lambda x: F.lit(x).cast("timestamp")
    half = F.expr(f"timestamp'{first}' + make_dt_interval({days // 2})")
    inventory = spark.range(1).select(F.inline(F.array(
        F.struct(F.lit(1).cast("long").alias("sk_clientes"), F.lit(meters).alias("total_clientes_servidos"), day("2024-12-01").alias("fecha_inicio"), half.alias("fecha_fin"), F.lit(True).alias("activo_bool"), F.lit(1).alias("version")),
        F.struct(F.lit(2).cast("long").alias("sk_clientes"), F.lit(meters + meters // 10).alias("total_clientes_servidos"), half.alias("fecha_inicio"), day(None).alias("fecha_fin"), F.lit(True).alias("activo_bool"), F.lit(2).alias("version")),
    )))
    sectors = spark.range(1, 9).select(c("id").alias("sk_geografia_urbana"), F.format_string("SECTOR-%d", "id").alias("sector_urbano"), F.format_string("DISTRITO-%d", c("id") % 3 + 1).alias("distrito"), F.lit("NORMAL").alias("nivel_criticidad"))
    return {
        "staging_eventos": outage_events(net, days, first, seed), "staging_telemetria": readings(net, days, first, seed), "dim_fecha": dim_fecha(spark), "dim_tiempo": dim_tiempo(spark), "dim_geografia_urbana": sectors, "dim_red_electrica": net,
        "dim_clientes_inventario": inventory, "dim_tipo_evento": spark.createDataFrame(list(EVENT_CATALOGUE), "sk_tipo_evento long, codigo_evento string, categoria string, severidad string, es_critico boolean"),
    }
