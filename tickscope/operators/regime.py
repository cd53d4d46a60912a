"""Volatility regime changes: online changepoint detection per symbol."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickscope import schemas as S
from tickscope.functions.bocpd import RegimeDetector, RegimeParams, RunTable


def log_volatility(volatility: Column) -> Column:
    return F.log(volatility + F.lit(S.VOLATILITY_FLOOR))


def score_series(
    series: DataFrame, key: str, order: str, value: str, params: RegimeParams = RegimeParams()
) -> DataFrame:
    """Add changepoint_probability and is_changepoint to every row of each series.

    The posterior after row i depends on the whole history, so one key is one
    sequential fold. It streams: rows reach the worker sorted, one Arrow batch at
    a time, and the state is a bounded set of run lengths. Null values are passed
    through without touching the state. Callers keep rows few: for windows there
    is at most one row per window length of elapsed time, whatever the trade rate.
    """
    schema = series.schema.add("changepoint_probability", "double").add("is_changepoint", "boolean")
    key_at, value_at = series.columns.index(key), series.columns.index(value)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = RegimeDetector(params, RunTable(params))
        current = object()
        for batch in batches:
            keys = batch.column(key_at).to_pylist()
            values = batch.column(value_at).to_pylist()
            odds = np.full(len(keys), np.nan)
            flags = np.zeros(len(keys), dtype=bool)
            for i, (name, x) in enumerate(zip(keys, values)):
                if name != current:
                    current = name
                    detector.reset()
                if x is not None:
                    flags[i] = detector.update(x)
                    odds[i] = detector.probability
            none = np.isnan(odds)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(odds, mask=none), pa.array(flags, mask=none)],
                names=[*batch.schema.names, "changepoint_probability", "is_changepoint"],
            )

    # A fixed number of partitions: merging small ones by size, as Spark otherwise
    # does, would put work that is heavy for its size into few tasks.
    tasks = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return series.repartition(tasks, key).sortWithinPartitions(key, order).mapInArrow(fold, schema)


def score_regime(windows: DataFrame, params: RegimeParams = RegimeParams()) -> DataFrame:
    """Add changepoint_probability and is_regime_change to window summaries.

    Windows without a volatility are skipped: no update, probability null.
    """
    x = F.when(F.col("realized_volatility").isNotNull(), log_volatility(F.col("realized_volatility")))
    return (
        score_series(windows.withColumn("_x", x), "symbol", "window_start", "_x", params)
        .withColumn("is_regime_change", F.coalesce("is_changepoint", F.lit(False)))
        .drop("_x", "is_changepoint")
    )


def regime_changes(scored: DataFrame) -> DataFrame:
    """Flagged windows as regime-change events."""
    return scored.where("is_regime_change").select(
        "symbol", "window_start", "window_end", "realized_volatility", "changepoint_probability"
    )
