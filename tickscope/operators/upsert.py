"""Idempotent upsert of anomalies, as a merge of delivered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickscope import schemas as S

KEY = ["ticker", "window_start", "anomaly_type"]


def current_rows(delivered: DataFrame, order: list[str]) -> DataFrame:
    """One row per anomaly out of any number of deliveries of it.

    The first ``detected_at`` is kept; ``details`` come from the newest delivery
    by ``order``. Delivering rows again changes nothing. Both aggregates combine
    before the shuffle, and filters on the key reach the scan.
    """
    return delivered.groupBy(*KEY).agg(
        F.max_by("details", F.struct(*order)).alias("details"),
        F.min("detected_at").alias("detected_at"),
    )


def checked_types(rows: DataFrame) -> DataFrame:
    """Rows as they are; an anomaly type outside the two known ones fails the job."""
    bad = F.concat(F.lit("anomaly_type not allowed: "), F.coalesce("anomaly_type", F.lit("null")))
    known = F.col("anomaly_type").isin(*S.ANOMALY_TYPES)
    return rows.withColumn(
        "anomaly_type", F.when(known, F.col("anomaly_type")).otherwise(F.raise_error(bad))
    )


def merge(existing: DataFrame, incoming: DataFrame, arrival: str = "arrival") -> DataFrame:
    """The table after upserting ``incoming`` (with an ``arrival`` order) into ``existing``."""
    old = existing.withColumns({"_new": F.lit(0), arrival: F.lit(None).cast("bigint")})
    new = checked_types(incoming).withColumn("_new", F.lit(1))
    return current_rows(old.unionByName(new), order=["_new", arrival])
