"""Volume spikes: z-score of a window against the symbol's windows before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickscope import schemas as S

WINDOWS_PER_CHUNK = 8192


def with_window_index(windows: DataFrame) -> DataFrame:
    """Number a symbol's windows from 0 in ``window_start`` order.

    For window tables that did not come from :mod:`anchored`. Numbers are worked
    out per day and shifted by the count of earlier days, so no symbol has to
    pass through one task.
    """
    day = F.to_date("window_start")
    dated = windows.withColumn("_day", day)
    per_day = dated.groupBy("symbol", "_day").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("symbol").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_day.select("symbol", "_day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    in_day = F.row_number().over(Window.partitionBy("symbol", "_day").orderBy("window_start"))
    return (
        dated.withColumn("_pos", in_day)
        .join(offsets, ["symbol", "_day"])
        .withColumn("window_index", (F.col("_base") + F.col("_pos") - 1).cast("bigint"))
        .drop("_day", "_pos", "_base")
    )


def with_neighbours(windows: DataFrame, before: int, after: int = 0, chunk: int = WINDOWS_PER_CHUNK):
    """Rows cut into (symbol, chunk), with the rows just outside each chunk copied in.

    Returns the frame and the key columns. A frame reaching at most ``before``
    rows back and ``after`` rows on sees over those keys exactly what it would see
    over the whole symbol, while a symbol with millions of windows spreads over
    many tasks. Drop rows with ``_copy`` afterwards.
    """
    chunk = max(chunk, before, after)
    mine = F.floor(F.col("window_index") / chunk)
    place = F.col("window_index") % chunk
    targets = F.array_compact(F.array(
        mine,
        F.when(place >= chunk - before, mine + 1),
        F.when((place < after) & (mine > 0), mine - 1),
    ))
    spread = windows.withColumn("_mine", mine).withColumn("_chunk", F.explode(targets))
    spread = spread.withColumn("_copy", F.col("_chunk") != F.col("_mine")).drop("_mine")
    return spread, ["symbol", "_chunk"]


def baseline(keys: list[str], lookback: int) -> tuple[Column, Column, Column]:
    """Count, mean and population deviation of the volumes before a window."""
    past = Window.partitionBy(*keys).orderBy("window_index").rowsBetween(-lookback, -1)
    return F.count("volume").over(past), F.avg("volume").over(past), F.stddev_pop("volume").over(past)


def score_volume(
    windows: DataFrame,
    z_threshold: float = S.VOLUME_Z_THRESHOLD,
    lookback: int = S.VOLUME_LOOKBACK,
    warmup: int = S.VOLUME_WARMUP,
    chunk: int = WINDOWS_PER_CHUNK,
) -> DataFrame:
    """Add score_mean, score_std, anomaly_score and is_volume_anomaly.

    The baseline is the previous ``lookback`` volumes without the current one;
    flagged volumes stay in later baselines. Windows in warm-up, with fewer than
    five volumes behind them, or with a flat history have no score. Only upward
    moves above the threshold count.
    """
    if "window_index" not in windows.columns:
        windows = with_window_index(windows)
    spread, keys = with_neighbours(windows, lookback, 0, chunk)
    n, mean, std = baseline(keys, lookback)
    ready = (F.col("window_index") >= warmup) & (F.col("_n") >= S.VOLUME_MIN_HISTORY) & (F.col("_s") > 0)
    z = F.when(ready, (F.col("volume") - F.col("_m")) / F.col("_s"))
    z = F.when(F.abs(z) < float("inf"), z)  # a volume that is no number gives no score
    return (
        spread.withColumns({"_n": n, "_m": mean, "_s": std})
        .where(~F.col("_copy"))
        .withColumn("score_mean", F.when(ready, F.col("_m")))
        .withColumn("score_std", F.when(ready, F.col("_s")))
        .withColumn("anomaly_score", z)
        .withColumn("is_volume_anomaly", F.coalesce(F.col("anomaly_score") > z_threshold, F.lit(False)))
        .drop("_n", "_m", "_s", "_chunk", "_copy")
    )


def volume_anomalies(scored: DataFrame) -> DataFrame:
    """Flagged windows as volume-anomaly events."""
    return scored.where("is_volume_anomaly").select(
        "symbol", "window_start", "window_end", "volume", "trade_count",
        "anomaly_score", "score_mean", "score_std",
    )
