"""Anomaly events: both kinds in one frame, their payloads and their topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickscope import schemas as S
from tickscope.functions import text as X
from tickscope.functions.bocpd import RegimeParams
from tickscope.operators.regime import score_regime
from tickscope.operators.volume import score_volume

# The payloads' fields in their order on the wire.
VOLUME_PAYLOAD = (
    "symbol", "window_start", "window_end", "volume", "trade_count", "anomaly_score",
    "score_mean", "score_std",
)
REGIME_PAYLOAD = (
    "symbol", "window_start", "window_end", "realized_volatility", "changepoint_probability",
)


def score_windows(
    windows: DataFrame,
    z_threshold: float = S.VOLUME_Z_THRESHOLD,
    lookback: int = S.VOLUME_LOOKBACK,
    warmup: int = S.VOLUME_WARMUP,
    params: RegimeParams = RegimeParams(),
) -> DataFrame:
    """Both detectors' readings for every closed window."""
    return score_volume(score_regime(windows, params), z_threshold, lookback, warmup)


def anomaly_events(scored: DataFrame) -> DataFrame:
    """One row per event; a window can give a volume event and a regime event.

    ``event_order`` puts the volume event of a window first. The input is read
    once: each window is expanded into the events it holds.
    """
    kinds = F.array_compact(F.array(
        F.when(F.col("is_volume_anomaly"), F.lit(S.VOLUME_ANOMALY)),
        F.when(F.col("is_regime_change"), F.lit(S.REGIME_CHANGE)),
    ))
    return (
        scored.where(F.col("is_volume_anomaly") | F.col("is_regime_change"))
        .withColumn("anomaly_type", F.explode(kinds))
        .withColumn("event_order", F.when(F.col("anomaly_type") == S.VOLUME_ANOMALY, 0).otherwise(1))
    )


def union_events(volume: DataFrame, regime: DataFrame) -> DataFrame:
    """Two typed event frames as one, with the kind in ``anomaly_type``."""
    return volume.withColumn("anomaly_type", F.lit(S.VOLUME_ANOMALY)).unionByName(
        regime.withColumn("anomaly_type", F.lit(S.REGIME_CHANGE)), allowMissingColumns=True
    )


def with_details(events: DataFrame) -> DataFrame:
    """Add ``details``, the event's JSON payload with ISO timestamps."""

    def body(names):
        fields = [
            (X.iso_text(F.col(n)) if n in ("window_start", "window_end") else F.col(n)).alias(n)
            for n in names
        ]
        return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})

    kind = F.col("anomaly_type")
    unknown = F.concat(F.lit("unknown anomaly event type: "), F.coalesce(kind, F.lit("null")))
    details = (
        F.when(kind == S.VOLUME_ANOMALY, body(VOLUME_PAYLOAD))
        .when(kind == S.REGIME_CHANGE, body(REGIME_PAYLOAD))
        .otherwise(F.raise_error(unknown))
    )
    return events.withColumn("details", details)


def event_messages(events: DataFrame) -> DataFrame:
    """Events as ``topic, key, value``, each kind on its own topic."""
    topic = F.create_map(*[F.lit(x) for pair in S.ANOMALY_TYPE_TO_TOPIC.items() for x in pair])
    return with_details(events).select(
        F.element_at(topic, F.col("anomaly_type")).alias("topic"),
        F.col("symbol").cast("binary").alias("key"),
        F.col("details").cast("binary").alias("value"),
    )


def event_rows(events: DataFrame) -> DataFrame:
    """Events in the shape of the anomaly table (without ``detected_at``)."""
    return with_details(events).select(
        F.col("symbol").alias("ticker"), "window_start", "anomaly_type", "details"
    )
