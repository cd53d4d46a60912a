"""The keyed anomaly table: deliveries that readers merge by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickscope.operators.upsert import KEY, checked_types, current_rows
from tickscope.sources.batch_table import BatchTable

STORED = (
    "ticker STRING, window_start TIMESTAMP, anomaly_type STRING, details STRING, "
    "detected_at TIMESTAMP, written_at TIMESTAMP"
)
ORDER = ["written_at", "writer", "batch"]


class AnomalyTable:
    """Writing costs what the batch holds, never what the table holds."""

    def __init__(self, spark: SparkSession, path: str):
        self.batches = BatchTable(spark, path, STORED)

    def upsert(self, rows: DataFrame, writer: str, batch: int, written_at=None) -> bool:
        """Deliver ``rows`` (ticker, window_start, anomaly_type, details).

        Optional columns: ``arrival`` orders rows of one key within the batch,
        ``detected_at`` defaults to the time of the batch. ``written_at`` orders
        deliveries of different writers and defaults to now. Returns False when
        this writer's batch is in the table already.
        """
        now = F.current_timestamp() if written_at is None else written_at
        if "detected_at" not in rows.columns:
            rows = rows.withColumn("detected_at", now)
        if "arrival" not in rows.columns:
            rows = rows.withColumn("arrival", F.lit(0))
        one_each = current_rows(checked_types(rows), order=["arrival", "details"])
        return self.batches.deliver(one_each.withColumn("written_at", now), writer, batch)

    def read(self) -> DataFrame:
        """One row per anomaly; empty when nothing was delivered yet."""
        return current_rows(self.batches.deliveries(), ORDER)

    def compact(self) -> int:
        """Fold the deliveries so far into one row per anomaly; returns the number of the base."""
        newest = F.max_by(F.struct("details", *ORDER), F.struct(*ORDER)).alias("newest")
        return self.batches.fold(lambda rows: rows.groupBy(*KEY).agg(
            newest, F.min("detected_at").alias("detected_at")).select(*KEY, "detected_at", "newest.*"))
