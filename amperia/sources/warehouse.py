"""Tables as Parquet folders that are never changed, under a manifest that says which of them are current: a batch adds folders and commits by creating the next manifest, so readers see all of it or nothing.

Staging, facts, errors and daily sums are filed by day (DAYS), staging also by whether a row came in processed. That a batch is done with a row is a mark: ids in folders of the same day, subtracted on reading, so a batch writes marks of what it consumed and never the rows again, and rows that no batch consumes cost no writing. The manifest counts what is pending by day; days without are not read. Facts and errors are read for the days of a batch's own pairs and readings. Daily sums of new facts are added beside those that are there. Small tables (dimensions, the ledger) are written whole. Counters, largest keys and broken constraints are observed on the writes themselves; a broken constraint fails the batch.

Manifests are numbered. Creating a number that exists fails: of two writers that began with the same state one gets ConcurrentBatch, and nothing of its batch is seen. The folders go through Spark's Hadoop file system, so any store that it reaches and that renames atomically will do.
"""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import date, datetime, timedelta, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.changes import sequential_keys, upsert
from ..plans import sums, views
from ..plans.outages import METERS_IN_BUCKET, Tables, pair_counts, reconcile_outages
from ..plans.telemetry import error_counts, reconcile_telemetry
from .schemas import SCHEMAS, checks

log = logging.getLogger(__name__)

#: The column whose day a partitioned table's rows are filed under; a row without it is filed under NO_DAY.
DAYS = {"staging_eventos": "timestamp_evento", "staging_telemetria": "timestamp_lectura", "fact_interrupciones": "timestamp_inicio", "fact_telemetria": "timestamp_lectura", "err_telemetria": "timestamp_evento"} | dict.fromkeys(sums.FACTS, "fecha")
#: Ids of staging rows, by which they are marked as processed.
MARKED = {"staging_eventos": "id_evento", "staging_telemetria": "id_staging"}
KEYS = {"fact_interrupciones": "sk_interrupcion", "fact_telemetria": "sk_telemetria", "err_telemetria": "id_error"}
NO_DAY = "0001-01-01"
#: Names of the views for tools that speak SQL, and the functions of views.py.
VIEWS = {
    "vw_saidi_saifi_diario": "saidi_diario", "vw_consumo_diario": "consumo_diario", "vw_voltaje_tendencia": "voltaje_tendencia", "vw_saidi_saifi_con_med": "saidi_con_med", "vw_saidi_saifi_mensual": "saidi_mensual",
    "vw_tendencia_12_meses": "tendencia", "vw_ranking_subestaciones": "ranking", "vw_heatmap_interrupciones": "heatmap", "vw_auditoria_errores": "auditoria_errores", "vw_monitoreo_elt": "monitoreo_elt",
}


class ConcurrentBatch(RuntimeError):
    """Another writer committed since this one began."""


@dataclass
class BatchResult:
    lote_id: int
    estado: str
    total_eventos: int
    total_hechos: int
    total_huerfanos: int
    total_transitorios: int
    duracion_segundos: float
    fecha_ejecucion: str

    def to_json(self) -> str:
        return json.dumps(asdict(self))


def _observed(rows: DataFrame, *metrics: Column) -> tuple[Callable[[], dict], DataFrame]:
    """rows under observation, and what gives the metrics, and n, the number of rows, once they are written."""
    seen = Observation()
    return lambda: {"n": 0} | seen.get, rows.observe(seen, F.count("*").alias("n"), *metrics)


def _join(parts: dict[str, list[str]], found: dict[str, list[str]]) -> None:
    """Adds folders to those of a table."""
    for k, folders in found.items():
        parts[k] = [*parts.get(k, []), *folders]


class Warehouse:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._registered = False

    # -- manifest ---------------------------------------------------------------------------------

    def _number(self) -> int:
        at = self._fs_path(f"{self.root}/_manifests")
        return max((int(f.getPath().getName().removesuffix(".json")) for f in (self._fs.listStatus(at) if self._fs.exists(at) else []) if f.getPath().getName()[0].isdigit()), default=0)

    def manifest(self) -> dict:
        """The current state: its number, the folder of each small table, the folders of each partitioned one by day and state (0: to be processed when filed, 1: all others), those of marks by day, how many rows are pending by day, the largest keys."""
        n = self._number()
        state = json.loads(self.spark.read.text(f"{self.root}/_manifests/{n}.json", wholetext=True).first()[0]) if n else {}
        return {k: {} for k in ("tables", "parts", "marks", "pending", "keys")} | state | {"number": n}

    def _create(self, state: dict) -> None:
        """Makes state the next manifest, unless there is one already."""
        folder, n = f"{self.root}/_manifests", state["number"] + 1
        new, at = self._fs_path(f"{folder}/.{uuid.uuid4().hex}"), self._fs_path(f"{folder}/{n}.json")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(state | {"number": n}, indent=1, sort_keys=True).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(new, at, self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            self._fs.delete(new, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise ConcurrentBatch(f"{at.toString()} exists") from e
            raise
        if self._registered:
            self.register_views()

    # -- tables -----------------------------------------------------------------------------------

    def read(self, name: str, start: datetime | date | None = None, end: datetime | date | None = None, pending: bool = False, state: dict | None = None, days: set[str] | None = None, dated: bool = False) -> DataFrame:
        """A table, or of a partitioned one the folders of the days from start to end, or of these days, with the rows to be processed only if pending. Rows without a day are always among them. dated: with _dia, the folder's day, which filters can prune by.

        The bounds choose folders, one day more at either end: the session's time zone may not be that of the bounds.
        """
        state = self.manifest() if state is None else state
        if name not in DAYS:
            return self._scan(name, [state["tables"][name]] if name in state["tables"] else [])
        keys = [k for k in self._days(state, name, start, end, pending) if days is None or k[:10] in days or k.startswith(NO_DAY)]
        parts = state["parts"].get(name, {})
        under = lambda some: self._scan(name, [f for k in some for f in parts[k]])
        if name in MARKED:
            marked = [k for k in keys if k.endswith("|0") and k[:10] in state["marks"].get(name, {})]
            rows = under([k for k in keys if k not in marked])
            if marked:
                rows = rows.unionByName(self._less_marks(name, under(marked), state, {k[:10] for k in marked}, pending))
        else:
            rows = under(keys)
        return rows if dated else rows.drop("_dia")

    def _scan(self, name: str, folders: list[str], root: str = "", schema: T.StructType | None = None) -> DataFrame:
        """The rows of folders of a table; of a partitioned one with _dia."""
        schema = schema or SCHEMAS[name]
        if name in DAYS:
            schema = T.StructType([*schema.fields, T.StructField("_dia", T.DateType())])
        if not folders:
            return self.spark.createDataFrame([], schema)
        if name not in DAYS:
            return self.spark.read.schema(schema).parquet(*folders)
        kept = T.StructType([*schema.fields, T.StructField("_v", T.StringType()), *([] if root else [T.StructField("_hecho", T.IntegerType())])])
        return self.spark.read.schema(kept).option("basePath", root or f"{self.root}/{name}").parquet(*folders).select(*schema.names)

    def _marks(self, name: str, state: dict, days: set[str]) -> DataFrame:
        """_id, _lote and _dia of the rows of these days that batches are done with."""
        folders = [f for d, fs in sorted(state["marks"].get(name, {}).items()) if d in days for f in fs]
        return self._scan(name, folders, f"{self.root}/_marcas/{name}", T._parse_datatype_string("_id long, _lote long"))

    def _less_marks(self, name: str, rows: DataFrame, state: dict, days: set[str], pending: bool) -> DataFrame:
        marks = self._marks(name, state, days).withColumnRenamed("_dia", "_del")
        same = (F.col(MARKED[name]) == F.col("_id")) & (F.col("_dia") == F.col("_del"))
        if pending:
            return rows.join(marks, same, "left_anti")
        hit = {"procesado": F.col("procesado") | F.col("_id").isNotNull()} | ({"id_lote_procesamiento": F.coalesce("_lote", "id_lote_procesamiento")} if "id_lote_procesamiento" in rows.columns else {})
        return rows.join(marks, same, "left").withColumns(hit).select(*rows.columns)

    def tables(self, dated: bool = False) -> Tables:
        """All tables as they now are; dated: partitioned ones with _dia. Daily sums are among them where the facts have any."""
        state = self.manifest()
        return {name: self.read(name, state=state, dated=dated) for name in SCHEMAS if name not in sums.FACTS or name in state["parts"]}

    def conform(self, name: str, df: DataFrame) -> DataFrame:
        """df with exactly the table's columns and types; columns that it lacks are null."""
        have = set(df.columns)
        return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]))

    def _write(self, name: str, df: DataFrame) -> tuple[dict[str, list[str]] | str, dict[str, int]]:
        """Writes rows of a table; returns the new folder, or of a partitioned table those by day and state, and what was observed: n, rows, and top, the largest key. Rows that break a constraint are an error."""
        schema = SCHEMAS[name]
        rows = self.conform(name, df)
        wrong = {f"_{k}": ok for k, ok in checks(name).items()}
        key = [F.max(KEYS[name]).alias("top")] if name in KEYS else []
        seen, rows = _observed(rows, *key, *(F.count_if(~F.coalesce(ok, F.lit(False))).alias(k) for k, ok in wrong.items()))
        if name in DAYS:
            done = F.when(F.col("procesado"), 1).otherwise(0) if name in MARKED else F.lit(1)
            found: dict[str, list[str]] | str = self._filed(f"{self.root}/{name}", rows.withColumns({"_dia": F.coalesce(F.to_date(DAYS[name]), F.lit(NO_DAY).cast("date")), "_hecho": done}), ["_dia", "_hecho"])
        else:
            found = f"{self.root}/{name}/{uuid.uuid4().hex}"
            rows.select(*schema.names).write.parquet(found)
        got = seen()
        broken = {k[1:]: got[k] for k in wrong if got.get(k)}
        if broken:
            raise ValueError(f"{name}: filas que no cumplen {broken}")
        return found, {"n": got.get("n") or 0, "top": got.get("top") or 0}

    def _filed(self, root: str, rows: DataFrame, by: list[str]) -> dict[str, list[str]]:
        """Writes rows into folders by day, or day and state; returns them."""
        at = f"{root}/_v={uuid.uuid4().hex}"
        rows.hint("rebalance", *by).write.partitionBy(*by).parquet(at)
        found: dict[str, list[str]] = {}
        inside = lambda p: [f.getPath() for f in self._fs.listStatus(p) if f.isDirectory()]
        for day in inside(self._fs_path(at)):
            d = day.getName()
            for part in inside(day) if len(by) > 1 else [None]:
                s = part.getName() if part else ""
                found["|".join(x.split("=")[1] for x in (d, s) if x)] = [f"{at}/{d}" + (f"/{s}" if s else "")]
        return found

    def _count_pending(self, state: dict, name: str, found: dict[str, list[str]]) -> None:
        """Adds the rows of new folders that are to be processed to what is pending on their days."""
        open_, new = state["pending"].setdefault(name, {}), [f for k, fs in found.items() if k.endswith("|0") for f in fs]
        for r in self._scan(name, new).groupBy("_dia").count().collect() if new else []:  # a row for each day
            open_[str(r[0])] = open_.get(str(r[0]), 0) + r[1]

    def commit(self, changed: Tables) -> None:
        """Writes the changed tables whole, then makes all of them current at once."""
        state = self.manifest()
        for name, df in changed.items():
            state["parts" if name in DAYS else "tables"][name], seen = self._write(name, df)
            if name in KEYS:
                state["keys"][name] = seen["top"]
            if name in MARKED:
                state["marks"].pop(name, None)
                state["pending"].pop(name, None)
                self._count_pending(state, name, state["parts"][name])
            for sum_, of in sums.FACTS.items():
                if of == name:
                    state["parts"][sum_], _ = self._write(sum_, sums.OF[sum_](self.read(name, state=state, dated=True)))
        self._create(state)

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows to a partitioned table, beside what it has."""
        state = self.manifest()
        found, seen = self._write(name, rows)
        self._added(state, name, found)
        if name in KEYS:
            state["keys"][name] = max(state["keys"].get(name, 0), seen["top"])
        self._create(state)

    def _added(self, state: dict, name: str, found: dict[str, list[str]]) -> None:
        """Notes new folders of a partitioned table, what is pending in them and the sums of what they hold."""
        _join(state["parts"].setdefault(name, {}), found)
        if name in MARKED:
            self._count_pending(state, name, found)
        for sum_, of in sums.FACTS.items():
            if of == name and found:
                new, _ = self._write(sum_, sums.OF[sum_](self._scan(name, [f for fs in found.values() for f in fs])))
                _join(state["parts"].setdefault(sum_, {}), new)

    @staticmethod
    def _days(state: dict, name: str, start: datetime | date | None, end: datetime | date | None, pending: bool = False) -> list[str]:
        """Days (with state) of a partitioned table from the day before start to the day after end; those with pending rows only, if so."""
        shift = lambda x, k: None if x is None else str(datetime.fromisoformat(str(x)[:10]) + timedelta(days=k))[:10]
        first, last, open_ = shift(start, -1), shift(end, 1), state["pending"].get(name, {})
        inside = lambda k: k.startswith(NO_DAY) or ((first is None or k[:10] >= first) and (last is None or k[:10] <= last))
        return [k for k in sorted(state["parts"].get(name, {})) if inside(k) and (not pending or (k.endswith("|0") and open_.get(k[:10], 0) > 0))]

    def compact(self, name: str, most: int = 8) -> int:
        """Writes the days of a partitioned table that have more than so many folders, marks included, again: processed rows apart from pending ones, sums added up. Returns how many."""
        state = self.manifest()
        parts, marks = state["parts"].get(name, {}), state["marks"].get(name, {})
        folders: dict[str, int] = {}
        for k, fs in [*parts.items(), *marks.items()]:
            folders[k[:10]] = folders.get(k[:10], 0) + len(fs)
        many = {d for d, n in folders.items() if n > most}
        if many:
            rows = self.read(name, state=state | {"parts": {name: {k: fs for k, fs in parts.items() if k[:10] in many}}}, dated=True)
            found, _ = self._write(name, sums.merged(rows) if name in sums.FACTS else rows)
            state["parts"][name] = {k: fs for k, fs in parts.items() if k[:10] not in many} | found
            state["marks"][name] = {d: fs for d, fs in marks.items() if d not in many}
            self._create(state)
        return len(many)

    def vacuum(self) -> int:
        """Deletes folders of versions that are not current, what failed batches left, and older manifests; returns how many. Not to be called while a batch runs."""
        state, gone = self.manifest(), 0
        keep = {*state["tables"].values()} | {f for held in (state["parts"], state["marks"]) for parts in held.values() for fs in parts.values() for f in fs}
        inner = {"/".join(f.split("/")[:-k]) for f in keep for k in (1, 2)}
        drop = lambda at: bool(self._fs.delete(at.getPath(), True))

        def sweep(at: str, depth: int) -> int:
            folder, n = self._fs_path(at), 0
            for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                path = f"{at}/{s.getPath().getName()}"
                if path in keep or not s.isDirectory():
                    continue
                n += sweep(path, depth - 1) if depth and path in inner else drop(s)
            return n

        for name in SCHEMAS:
            gone += sweep(f"{self.root}/{name}", 2 if name in DAYS else 0)
        for name in MARKED:
            gone += sweep(f"{self.root}/_marcas/{name}", 1)
        work = self._fs_path(f"{self.root}/_work")
        gone += sum(map(drop, self._fs.listStatus(work) if self._fs.exists(work) else []))
        for f in self._fs.listStatus(self._fs_path(f"{self.root}/_manifests")):
            if f.getPath().getName() != f"{state['number']}.json":
                gone += drop(f)
        return gone

    # -- batches ----------------------------------------------------------------------------------

    def _next_batch(self) -> int:
        return int(self.read("ctrl_lotes_procesamiento").agg(F.coalesce(F.max("id_lote"), F.lit(0))).first()[0]) + 1

    def _ledger(self, lote: int, state: str, start: datetime | None, end: datetime | None, counts: dict, began: float) -> DataFrame:
        row = {"id_lote": lote, "fecha_inicio": start, "fecha_fin": end, "estado": state, "fecha_ejecucion": datetime.fromtimestamp(began, timezone.utc), **{k: int(counts.get(k, 0)) for k in ("total_eventos", "total_hechos", "total_huerfanos", "total_transitorios")}}
        one = self.spark.createDataFrame([tuple(row.values())], "id_lote int, fecha_inicio timestamp, fecha_fin timestamp, estado string, fecha_ejecucion timestamp, total_eventos int, total_hechos int, total_huerfanos int, total_transitorios int")
        return self.conform("ctrl_lotes_procesamiento", one.withColumn("duracion_segundos", F.lit(round(time.time() - began, 2))))

    def _appended(self, state: dict, name: str, rows: DataFrame, bucket: Column, order: list[str], extra: dict) -> int:
        """New rows with the keys after the largest one: written, and noted in state. Returns how many."""
        top = state["keys"].get(name, 0)
        found, seen = self._write(name, sequential_keys(rows, KEYS[name], bucket, order, top).withColumns(extra))
        self._added(state, name, found)
        state["keys"][name] = max(top, seen["top"])
        return seen["n"]

    def _mark(self, state: dict, name: str, ids: DataFrame, lote: int) -> None:
        """Marks rows (id, time) as processed by a batch."""
        day = F.coalesce(F.to_date(DAYS[name]), F.lit(NO_DAY).cast("date"))
        rows = ids.select(F.col(MARKED[name]).alias("_id"), F.lit(lote).cast("long").alias("_lote"), day.alias("_dia")).distinct()
        found, open_ = self._filed(f"{self.root}/_marcas/{name}", rows, ["_dia"]), state["pending"].setdefault(name, {})
        for r in self._marks(name, {"marks": {name: found}}, {*found}).groupBy("_dia").count().collect() if found else []:  # a row for each day
            open_[str(r[0])] = open_.get(str(r[0]), 0) - r[1]
        _join(state["marks"].setdefault(name, {}), found)

    def _run(self, plan: str, start: datetime | None, end: datetime | None) -> BatchResult:
        began, lote, work = time.time(), self._next_batch(), f"{self.root}/_work/{uuid.uuid4().hex}"
        outages = plan == "outages"
        staging, fact = ("staging_eventos", "fact_interrupciones") if outages else ("staging_telemetria", "fact_telemetria")
        counts: dict[str, int] = {}
        try:
            state = self.manifest()
            t = {name: self.read(name, state=state) for name in SCHEMAS if name not in DAYS}
            t[staging] = self.read(staging, start, end, pending=True, state=state)
            totals = {"pares": pair_counts(), "errores": [] if outages else error_counts(), "lecturas": [F.count("*").alias("total_eventos")], "hechos": [F.count("*").alias("total_hechos")]}

            def store(df: DataFrame, name: str) -> DataFrame:
                seen, rows = _observed(df, *totals.get(name, []))
                rows.write.parquet(f"{work}/{name}")
                counts.update({k: v or 0 for k, v in seen().items() if k != "n"} | {f"_{name}": seen()["n"]})
                return self.spark.read.schema(df.schema).parquet(f"{work}/{name}")

            def near(name: str, days: DataFrame) -> DataFrame:
                # What a row may repeat is filed under the same day as it is; days are as many as the batch has.
                return self.read(name, state=state, days={str(r[0]) for r in days.distinct().collect()})

            # Pairs, facts and errors are computed once: tables and marks read what is written here, counters are observed on the way.
            batch = (reconcile_outages if outages else reconcile_telemetry)(t, start, end, store, near)
            now, stamp = F.current_timestamp(), F.lit(lote)
            spread = lambda at, c: F.struct(F.to_date(at).alias("d"), F.expr(f"{c} div {METERS_IN_BUCKET}").alias("m"))
            wrong = self._appended(state, "err_telemetria", batch["errores"], spread("timestamp_evento", "id_medidor"), ["timestamp_evento", "id_evento_origen", "tipo_error"], {"fecha_deteccion": now, "resuelto": F.lit(False), "id_lote_procesamiento": stamp})
            if outages:
                # Orphans and double outages are the errors, but for outages of a type that the catalogue lacks.
                lacking = t["dim_tipo_evento"].filter("codigo_evento = 'POWER_OUTAGE'").isEmpty()
                counts["total_huerfanos"] = wrong - (self._unknown(batch) if lacking else 0)
                self._appended(state, fact, batch["hechos"], spread("timestamp_inicio", "id_medidor"), ["timestamp_inicio", "id_medidor"], {"id_lote_procesamiento": stamp, "excluido_med": F.lit(False), "fecha_procesamiento": now})
                network = batch["red_nueva"].withColumns({"estado_operativo": F.lit("ACTIVO"), "fecha_actualizacion": now})
                for name, rows, some in (("dim_red_electrica", network, counts["_red_nueva"] > 0), ("dim_geografia_urbana", batch["geografia_nueva"].withColumn("fecha_actualizacion", now), None), ("dim_clientes_inventario", batch["clientes_nuevo"].withColumn("fecha_actualizacion", now), None)):
                    if (counts["total_hechos"] > 0 and not rows.isEmpty()) if some is None else some:
                        state["tables"][name], _ = self._write(name, t[name].unionByName(self.conform(name, rows)))
            else:
                self._appended(state, fact, batch["hechos"], spread("timestamp_lectura", "sk_red_electrica"), ["timestamp_lectura", "sk_red_electrica"], {"id_lote_procesamiento": stamp})
            self._mark(state, staging, batch["procesados"], lote)
            state["tables"]["ctrl_lotes_procesamiento"], _ = self._write("ctrl_lotes_procesamiento", t["ctrl_lotes_procesamiento"].unionByName(self._ledger(lote, "COMPLETADO", start, end, counts, began)))
            self._create(state)
        except Exception:
            self.log_failed(lote, start, end, began)
            raise
        finally:
            self._fs.delete(self._fs_path(work), True)
        log.info("lote %s completado: %s", lote, counts)
        return BatchResult(lote, "COMPLETADO", *(int(counts.get(k, 0)) for k in ("total_eventos", "total_hechos", "total_huerfanos", "total_transitorios")), round(time.time() - began, 2), datetime.fromtimestamp(began, timezone.utc).isoformat())

    @staticmethod
    def _unknown(batch: Tables) -> int:
        return batch["errores"].filter("tipo_error = 'EVENTO_DESCONOCIDO'").count()

    def log_failed(self, lote: int, start: datetime | None, end: datetime | None, began: float) -> None:
        """Records a failed batch in a commit of its own; if even that fails, only a warning is left."""
        try:
            row = self._ledger(lote, "FALLIDO", start, end, {}, began)
            self.commit({"ctrl_lotes_procesamiento": upsert(self.read("ctrl_lotes_procesamiento"), row, ["id_lote"])})
        except Exception as e:  # noqa: BLE001
            log.warning("lote %s: no se pudo registrar el fallo: %s", lote, e)

    def reconcile_outages(self, start: datetime | None = None, end: datetime | None = None) -> BatchResult:
        """One batch over the pending events between start and end, both inclusive."""
        return self._run("outages", start, end)

    def reconcile_telemetry(self, start: datetime | None = None, end: datetime | None = None) -> BatchResult:
        return self._run("telemetry", start, end)

    def flag_med_days(self, beta: float = 2.5) -> DataFrame:
        """Flags facts of major event days, of which the days are written again and no others; one row with what was done."""
        state, name = self.manifest(), "fact_interrupciones"
        work = f"{self.root}/_work/{uuid.uuid4().hex}"

        def store(df: DataFrame, what: str) -> DataFrame:
            df.write.parquet(f"{work}/{what}")
            return self.spark.read.schema(df.schema).parquet(f"{work}/{what}")

        try:
            t = self.tables(dated=True)
            days, report = views.med_report(t, beta, store)
            dates = {str(r.fecha) for r in days.select("fecha").distinct().collect()}  # days of the calendar at most
            done = self.spark.createDataFrame(report.collect(), report.schema)  # one row
            hit = {k: fs for k, fs in state["parts"].get(name, {}).items() if k[:10] in dates}
            if hit:
                rows = self._scan(name, [f for fs in hit.values() for f in fs])
                less, _ = self._write(sums.OUTAGES, sums.of_outages(rows, -1))
                _join(state["parts"].setdefault(sums.OUTAGES, {}), less)
                found, _ = self._write(name, rows.withColumn("excluido_med", F.lit(True)))
                state["parts"][name] |= found
                self._create(state)
        finally:
            self._fs.delete(self._fs_path(work), True)
        return done

    def view(self, name: str, **how: object) -> DataFrame:
        """A view of views.py, or by its SQL name, over the current tables."""
        return getattr(views, VIEWS.get(name, name))(self.tables(dated=True), **how)

    def register_views(self) -> None:
        """All views as temporary SQL views, for tools that speak SQL, under the names that these know. Each commit through this warehouse replaces them; what other writers commit is seen after another call."""
        for name in VIEWS:
            self.view(name).createOrReplaceTempView(name)
        self._registered = True
