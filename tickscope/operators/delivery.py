"""Delivery checks: attempts per message, loss and duplicates, backlog drain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def delivery_audit(log: DataFrame) -> DataFrame:
    """One row per trade id of a delivery log (trade_id, ticker, processed_at)."""
    return log.groupBy("trade_id").agg(
        F.min_by("ticker", F.struct("processed_at", "ticker")).alias("ticker"),
        F.count(F.lit(1)).alias("attempts"),
        F.min("processed_at").alias("first_processed_at"),
        F.max("processed_at").alias("last_processed_at"),
    )


def integrity_summary(audit: DataFrame, expected: DataFrame) -> DataFrame:
    """Counts and the three verdicts. ``expected`` has one row, ``n_expected``."""
    stats = audit.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct("trade_id").alias("distinct_trade_ids"),
        F.coalesce(F.max("attempts"), F.lit(0)).alias("max_attempts"),
    )
    return side_by_side(stats, expected.select("n_expected")).select(
        "row_count", "distinct_trade_ids", "max_attempts",
        (F.col("distinct_trade_ids") == F.col("n_expected")).alias("no_loss"),
        (F.col("row_count") == F.col("distinct_trade_ids")).alias("no_duplicate_rows"),
        (F.col("max_attempts") > 1).alias("redelivery_confirmed"),
    )


def side_by_side(*one_row_frames: DataFrame) -> DataFrame:
    """The columns of several one-row frames in one row, without a join."""
    stacked = one_row_frames[0]
    for frame in one_row_frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    names = [name for frame in one_row_frames for name in frame.columns]
    return stacked.agg(*[F.first(name, ignorenulls=True).alias(name) for name in names])


def drain_summary(samples: DataFrame, settle_seconds: float = 2.0) -> DataFrame:
    """Per run: peak lag, rate, and when the backlog was first gone.

    ``samples``: run, elapsed, lag, burst_size, produce_seconds. Watching ends at
    the first empty backlog later than ``settle_seconds``; a run that never gets
    there has drained only if its last sample is empty.
    """
    gone = F.min(F.when((F.col("lag") == 0) & (F.col("elapsed") > settle_seconds), F.col("elapsed")))
    ends = samples.groupBy(F.col("run").alias("_run")).agg(gone.alias("_gone"))
    watched = (F.col("elapsed") <= F.col("_gone")) | F.col("_gone").isNull()
    return (
        samples.join(ends, F.col("run").eqNullSafe(F.col("_run")))
        .groupBy("run")
        .agg(
            F.max("burst_size").alias("burst_size"),
            F.try_divide(F.max("burst_size"), F.max("produce_seconds")).alias("produce_rate"),
            F.max(F.when(watched, F.col("lag"))).alias("peak_lag"),
            F.max("_gone").alias("_gone"),
            F.max("elapsed").alias("_end"),
            F.max_by("lag", "elapsed").alias("_end_lag"),
        )
        .withColumn(
            "recovery_seconds",
            F.coalesce(F.col("_gone"), F.when(F.col("_end_lag") == 0, F.col("_end"))),
        )
        .drop("_gone", "_end", "_end_lag")
    )
