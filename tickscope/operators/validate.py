"""Validation of raw tick and anomaly-event payloads, all inside Catalyst.

Fixed values: the error texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickscope import schemas as S
from tickscope.functions import text as X


def _key_errors(checks: list[tuple[Column, Column]]) -> Column:
    """First failing check's message; null when all pass."""
    chain = None
    for failed, message in checks:
        chain = F.when(failed, message) if chain is None else chain.when(failed, message)
    return chain


def validate_ticks(raw: DataFrame, value: str = "value") -> DataFrame:
    """Add ``error`` and the typed tick columns to raw messages.

    ``error`` is null for a good tick, else the text of the first failed check:
    UTF-8, JSON, object, type, required keys, timestamp. Input columns (the raw
    value among them) are kept, so unknown extra fields are never lost. Only key
    presence and the timestamp decide; a present but mistyped field is a
    processing error that :func:`trades` raises.
    """
    checked = (
        raw.withColumn("_text", F.col(value).cast("string"))
        .withColumn("_utf8", F.is_valid_utf8(F.col("_text")))
        .withColumn("_json", F.col("_utf8") & X.is_single_json(F.col("_text")))
        .withColumn("_keys", F.when(F.col("_json"), F.json_object_keys(F.col("_text"))))
        .withColumn("tick", F.when(F.col("_keys").isNotNull(), F.from_json("_text", S.TICK_FIELDS)))
        .withColumn("_ts", X.iso_timestamp(F.col("tick.timestamp")))
    )
    kind = F.col("tick.type")
    _, shown_kind = X.json_field(F.col("_text"), "type")
    is_text, shown_time = X.json_field(F.col("_text"), "timestamp")
    # Digits alone may be a number, which is no timestamp.
    numeric = F.col("tick.timestamp").rlike(r"^\d+$") & ~is_text
    absent = F.when(kind == "trade", X.missing_keys(S.TRADE_KEYS, F.col("_keys"))).when(
        kind == "quote", X.missing_keys(S.QUOTE_KEYS, F.col("_keys"))
    )
    ts = F.col("_ts")
    error = _key_errors([
        (F.col(value).isNull(), F.lit("not valid json: null value")),
        (~F.col("_utf8"), F.lit("not valid utf-8: undecodable bytes")),
        (~F.col("_json"), F.lit("not valid json: malformed text")),
        (F.col("_keys").isNull(),
         F.concat(F.lit("expected a JSON object, got "), X.json_kind(F.col("_text")))),
        (kind.isNull() | ~kind.isin("trade", "quote"),
         F.concat(F.lit("unknown tick type: "), shown_kind)),
        (F.size(absent) > 0, F.concat(F.lit("missing required field(s): "), X.quoted_list(absent))),
        (ts.isNull() | numeric, F.concat(F.lit("invalid timestamp: "), shown_time)),
    ])
    typed = [
        F.col(f"tick.{name}").alias(name)
        for name in (
            "type", "symbol", "price", "size", "exchange", "trade_id", "bid_price", "bid_size",
            "bid_exchange", "ask_price", "ask_size", "ask_exchange", "conditions", "tape",
        )
    ]
    # The Kafka source has a column called ``timestamp`` too: the tick's is ``ts``.
    # The result comes out of a generator because filters are not pushed below
    # one: a filter on ``error`` pushed into the projections above would repeat
    # the JSON parsing many times over.
    result = F.array(F.struct(error.alias("error"), ts.alias("ts"), *typed))
    return checked.select(*raw.columns, F.inline(result))


def valid_ticks(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("error").isNull())


def rejected(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("error").isNotNull())


def trades(ticks: DataFrame) -> DataFrame:
    """Trade ticks only (quotes carry no traded price or size).

    A trade whose symbol, price or size is null or not a number passed the key
    check but cannot be processed: that stops the job, it is not dropped.
    """
    picked = ticks.where(F.col("type") == "trade")

    def needed(name: str) -> Column:
        fault = F.raise_error(F.lit(f"trade without a usable {name}"))
        bad = F.col(name).isNull()
        if name != "symbol":
            number = F.col(name).cast("double")
            bad |= F.isnan(number) | (F.abs(number) == float("inf"))
        return F.when(bad, fault).otherwise(F.col(name)).alias(name)

    others = [c for c in picked.columns if c not in ("symbol", "price", "size")]
    return picked.select(*others, needed("symbol"), needed("price"), needed("size"))


def validate_anomaly_events(
    raw: DataFrame, value: str = "value", topic: str = "topic"
) -> DataFrame:
    """Parse events read back from the two anomaly topics; a bad one fails the job.

    These payloads are our own output, so a malformed one is a bug: there is no
    dead-letter branch. Output: symbol, window_start, anomaly_type, details.
    """
    kind = F.create_map(*[F.lit(x) for pair in S.TOPIC_TO_ANOMALY_TYPE.items() for x in pair])
    parsed = (
        raw.withColumn("_text", F.col(value).cast("string"))
        .withColumn("anomaly_type", F.try_element_at(kind, F.col(topic)))
        .withColumn("_json", F.coalesce(F.is_valid_utf8("_text"), F.lit(False))
                    & X.is_single_json(F.col("_text")))
        .withColumn("_keys", F.when(F.col("_json"), F.json_object_keys("_text")))
        .withColumn("_symbol", F.get_json_object("_text", "$.symbol"))
        .withColumn("_start", F.get_json_object("_text", "$.window_start"))
    )
    problem = anomaly_event_error()
    checked = F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(F.col("_text"))
    # A generator again, so that later filters do not repeat the parsing.
    result = F.array(F.struct(
        "anomaly_type", F.col("_symbol").alias("symbol"),
        X.iso_timestamp(F.col("_start")).alias("window_start"), checked.alias("details"),
    ))
    keep = [c for c in raw.columns if c != value]
    # The condition is always true; it keeps the check from being pruned away.
    return parsed.select(*keep, F.inline(result)).where(F.col("details").isNotNull())


def anomaly_event_error() -> Column:
    """First failed check of a parsed anomaly event (needs its helper columns)."""
    kind = F.col("anomaly_type")
    absent = F.when(kind == S.VOLUME_ANOMALY, X.missing_keys(S.VOLUME_EVENT_KEYS, F.col("_keys"))).when(
        kind == S.REGIME_CHANGE, X.missing_keys(S.REGIME_EVENT_KEYS, F.col("_keys"))
    )
    return _key_errors([
        (~F.col("_json"), F.lit("not valid utf-8/json: malformed payload")),
        (F.col("_keys").isNull(),
         F.concat(F.lit("expected a JSON object, got "), X.json_kind(F.col("_text")))),
        (kind.isNull(), F.lit("unknown anomaly type")),
        (F.size(absent) > 0, F.concat(F.lit("missing required field(s): "), X.quoted_list(absent))),
        (X.iso_timestamp(F.col("_start")).isNull(),
         F.concat(F.lit("invalid window_start: "), X.quoted(F.col("_start")))),
    ])
