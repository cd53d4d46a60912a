"""Dead-letter envelopes: building, reading back, inspecting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickscope import schemas as S
from tickscope.functions import text as X


def _one_line_base64(value: Column) -> Column:
    """Base64 without the line breaks Spark puts after every 76 characters."""
    return F.translate(F.base64(value), "\r\n", "")


def envelopes(
    bad: DataFrame, failed_at: Column | None = None, error_class: str = S.TICK_ERROR_CLASS
) -> DataFrame:
    """One envelope per rejected message, keyed by where the message came from.

    ``bad`` has the raw message columns and ``error``. The raw bytes travel as
    base64; an undecodable key has its bad bytes replaced.
    """
    at = failed_at if failed_at is not None else F.current_timestamp()
    key_text = F.make_valid_utf8(F.col("key").cast("string"))
    return bad.select(
        F.col("topic").alias("original_topic"),
        F.col("partition").alias("original_partition"),
        F.col("offset").alias("original_offset"),
        F.when(F.length("key") > 0, key_text).alias("original_key"),
        _one_line_base64(F.coalesce(F.col("value"), F.lit(b""))).alias("raw_value_b64"),
        F.concat(F.lit(f"{error_class}: "), F.col("error")).alias("error"),
        X.iso_text(at).alias("failed_at"),
    )


def envelope_messages(rows: DataFrame, topic: str = S.DLQ_TOPIC) -> DataFrame:
    """Envelopes as ``topic, key, value`` for a message sink."""
    return rows.select(
        F.lit(topic).alias("topic"),
        F.col("original_key").cast("binary").alias("key"),
        F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).cast("binary").alias("value"),
    )


def parse_envelopes(messages: DataFrame, value: str = "value") -> DataFrame:
    """The reverse of :func:`envelope_messages`."""
    body = F.from_json(F.col(value).cast("string"), S.DLQ_ENVELOPE)
    return messages.select(body.alias("e")).select("e.*")


def decode(rows: DataFrame) -> DataFrame:
    """Add the original bytes and a ``topic[partition]@offset`` location."""
    return rows.withColumn("raw_value", F.unbase64("raw_value_b64")).withColumn(
        "location",
        F.format_string("%s[%d]@%d", "original_topic", "original_partition", "original_offset"),
    )


def replay_messages(rows: DataFrame) -> DataFrame:
    """Decoded envelopes as messages for the topic they first came from."""
    key = F.when(F.length("original_key") > 0, F.col("original_key").cast("binary"))
    return decode(rows).select(
        F.col("original_topic").alias("topic"), key.alias("key"), F.col("raw_value").alias("value"),
        "location",
    )


def inspect(rows: DataFrame, limit: int = S.DLQ_INSPECT_LIMIT) -> DataFrame:
    """The first ``limit`` records in source order; reads only, commits nothing."""
    first = rows.orderBy("original_topic", "original_partition", "original_offset").limit(limit)
    return decode(first).select(
        "location", F.col("original_key").alias("key"), "error", "failed_at", "raw_value"
    )
