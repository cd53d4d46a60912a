"""Row shapes (as DDL text) and fixed names shared by every operator."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Topic names, type names, required keys and defaults. They must
# equal what existing producers and consumers of these topics use.
# ---------------------------------------------------------------------------
TICKS_TOPIC = "market-ticks"
DLQ_TOPIC = "market-ticks-dlq"
VOLUME_TOPIC = "volume-anomalies"
REGIME_TOPIC = "regime-changes"

VOLUME_ANOMALY = "volume_anomaly"
REGIME_CHANGE = "regime_change"
ANOMALY_TYPES = (VOLUME_ANOMALY, REGIME_CHANGE)
TOPIC_TO_ANOMALY_TYPE = {VOLUME_TOPIC: VOLUME_ANOMALY, REGIME_TOPIC: REGIME_CHANGE}
ANOMALY_TYPE_TO_TOPIC = {kind: topic for topic, kind in TOPIC_TO_ANOMALY_TYPE.items()}

TRADE_KEYS = ("conditions", "exchange", "price", "size", "symbol", "tape", "timestamp", "trade_id")
QUOTE_KEYS = (
    "ask_exchange", "ask_price", "ask_size", "bid_exchange", "bid_price", "bid_size",
    "conditions", "symbol", "tape", "timestamp",
)
VOLUME_EVENT_KEYS = (
    "anomaly_score", "score_mean", "score_std", "symbol", "trade_count", "volume",
    "window_end", "window_start",
)
REGIME_EVENT_KEYS = (
    "changepoint_probability", "realized_volatility", "symbol", "window_end", "window_start",
)

TICK_ERROR_CLASS = "TickValidationError"

WINDOW_SECONDS = 10.0
VOLUME_Z_THRESHOLD = 4.5
VOLUME_LOOKBACK = 30
VOLUME_WARMUP = 30
VOLUME_MIN_HISTORY = 5
VOLATILITY_FLOOR = 1e-8
REGIME_HAZARD_LAMBDA = 100.0
REGIME_THRESHOLD = 0.5

FACTOR_WINDOW_ROWS = 60
FACTOR_MIN_ROWS = 20
SHARP_Z = 2.0
MATCH_DAYS = 1
PRICE_LOOKBACK_DAYS = 400

LIST_LIMIT = 50
DLQ_INSPECT_LIMIT = 20
FEED_LENGTH = 50
# ---------------------------------------------------------------------------


RAW_MESSAGE = (
    "key BINARY, value BINARY, topic STRING, partition INT, offset BIGINT, timestamp TIMESTAMP"
)

# Trade and quote share one wide row; ``type`` says which columns are filled.
TICK_FIELDS = (
    "type STRING, symbol STRING, timestamp STRING, price DOUBLE, size DOUBLE, exchange STRING, "
    "trade_id BIGINT, bid_price DOUBLE, bid_size DOUBLE, bid_exchange STRING, ask_price DOUBLE, "
    "ask_size DOUBLE, ask_exchange STRING, conditions ARRAY<STRING>, tape STRING"
)

DLQ_ENVELOPE = (
    "original_topic STRING, original_partition INT, original_offset BIGINT, original_key STRING, "
    "raw_value_b64 STRING, error STRING, failed_at STRING"
)

ANOMALY = (
    "ticker STRING, window_start TIMESTAMP, anomaly_type STRING, details STRING, "
    "detected_at TIMESTAMP"
)
