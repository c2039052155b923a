"""Reconciliation as a stream: micro-batches through the same plan as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.warehouse import Warehouse


def reconcile_stream(events: DataFrame, warehouse: Warehouse, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Appends each micro-batch of events to staging and reconciles what is pending.

    A micro-batch that is delivered twice adds nothing: ids that staging has under the same days are left out, and reconciliation is idempotent. Open outages wait in staging, however long, so events that come late, in other micro-batches, are paired in order of time with what is still pending then. Only the micro-batch's days are read and written.
    """

    def batch(df: DataFrame, _: int) -> None:
        days = df.agg(F.min("timestamp_evento"), F.max("timestamp_evento")).first()
        if days[0] is None:
            return
        known = warehouse.read("staging_eventos", *days).select("id_evento")
        new = warehouse.conform("staging_eventos", df.dropDuplicates(["id_evento"])).fillna({"procesado": False}).join(known, "id_evento", "left_anti")
        warehouse.append("staging_eventos", new)
        warehouse.reconcile_outages()

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
