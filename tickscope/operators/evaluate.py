"""How well detector settings find known spikes, for a whole grid in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickscope import schemas as S
from tickscope.operators.volume import WINDOWS_PER_CHUNK, baseline, with_neighbours

# The grid the defaults were picked from.
THRESHOLDS = (3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0)
LOOKBACKS = (10, 20, 30, 50)
TOLERANCE = 3
QUIET_UNIT = 500


def sweep(
    windows: DataFrame,
    thresholds: tuple[float, ...] = THRESHOLDS,
    lookbacks: tuple[int, ...] = LOOKBACKS,
    tolerance: int = TOLERANCE,
    warmup: int = S.VOLUME_WARMUP,
    chunk: int = WINDOWS_PER_CHUNK,
) -> DataFrame:
    """Recall and false positives per (lookback, threshold).

    ``windows``: symbol, window_index, volume, is_spike. A spike is found when a
    window within ``tolerance`` of it is flagged. A flagged window near no spike
    is a false positive; the rate is per 500 windows near no spike. All lookbacks
    share one shuffle and sort, all thresholds one aggregation.
    """
    spread, keys = with_neighbours(windows, max(lookbacks) + tolerance, tolerance, chunk)
    order = Window.partitionBy(*keys).orderBy("window_index")
    around = order.rowsBetween(-tolerance, tolerance)
    past, z = {}, {}
    for n in lookbacks:
        past[f"n{n}"], past[f"m{n}"], past[f"s{n}"] = baseline(keys, n)
        warm = (F.col("window_index") >= warmup) & (F.col(f"n{n}") >= S.VOLUME_MIN_HISTORY)
        z[f"z{n}"] = F.when(
            warm & (F.col(f"s{n}") > 0), (F.col("volume") - F.col(f"m{n}")) / F.col(f"s{n}")
        )
    scored = spread.withColumns(past).withColumns(z).withColumns({
        "near": F.max(F.col("is_spike").cast("int")).over(around) > 0,
        **{f"best{n}": F.max(f"z{n}").over(around) for n in lookbacks},
    }).where(~F.col("_copy"))

    spike, quiet = F.col("is_spike"), ~F.col("near")
    totals = [F.count_if(spike).alias("spikes"), F.count_if(quiet).alias("quiet_windows")]
    grid = []
    for n in lookbacks:
        for i, t in enumerate(thresholds):
            totals.append(F.count_if(spike & (F.col(f"best{n}") > t)).alias(f"hit_{n}_{i}"))
            totals.append(F.count_if(quiet & (F.col(f"z{n}") > t)).alias(f"false_{n}_{i}"))
            grid.append(F.struct(
                F.lit(n).alias("lookback"), F.lit(t).alias("threshold"),
                F.col(f"hit_{n}_{i}").alias("spikes_found"),
                F.col(f"false_{n}_{i}").alias("false_positives"),
            ))
    return (
        scored.agg(*totals)
        .select("spikes", "quiet_windows", F.inline(F.array(*grid)))
        .select(
            "lookback", "threshold", "spikes", "spikes_found",
            F.try_divide("spikes_found", "spikes").alias("recall"),
            "false_positives",
            (F.try_divide("false_positives", "quiet_windows") * QUIET_UNIT).alias("false_per_500"),
        )
    )
