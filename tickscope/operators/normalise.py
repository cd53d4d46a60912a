"""Provider records to tick rows, and rows to the JSON that goes on a topic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickscope import schemas as S
from tickscope.functions import text as X

# The payloads' fields in their order on the wire.
TRADE_PAYLOAD = (
    "type", "symbol", "timestamp", "price", "size", "exchange", "trade_id", "conditions", "tape",
)
QUOTE_PAYLOAD = (
    "type", "symbol", "timestamp", "bid_price", "bid_size", "bid_exchange",
    "ask_price", "ask_size", "ask_exchange", "conditions", "tape",
)


def to_utc(column, zone: str | None = None):
    """A provider's local clock time in ``zone`` as a UTC instant."""
    return F.to_utc_timestamp(column, zone) if zone else column.cast("timestamp")


def provider_ticks(records: DataFrame, zone: str | None = None) -> DataFrame:
    """Provider records as tick rows that `tick_messages` sends.

    ``records`` holds both kinds under the provider's own names: ``kind`` (trade or
    quote), ``symbol``, ``at`` (a local clock time in ``zone``, or an instant),
    ``price``, ``size``, ``venue``, ``id``, ``bid``, ``bid_size``, ``bid_venue``, ``ask``,
    ``ask_size``, ``ask_venue``, ``flags`` and ``tape``. Columns that a kind does not have
    are null in its rows; other kinds are none of this feed's and are left out.
    """
    trade, quote = F.col("kind") == "trade", F.col("kind") == "quote"

    def of(kind, name, cast):
        return F.when(kind, F.col(name).cast(cast))

    return records.where(trade | quote).select(
        F.col("kind").alias("type"), "symbol", to_utc(F.col("at"), zone).alias("ts"),
        of(trade, "price", "double").alias("price"), of(trade, "size", "double").alias("size"),
        of(trade, "venue", "string").alias("exchange"), of(trade, "id", "bigint").alias("trade_id"),
        of(quote, "bid", "double").alias("bid_price"), of(quote, "bid_size", "double").alias("bid_size"),
        of(quote, "bid_venue", "string").alias("bid_exchange"), of(quote, "ask", "double").alias("ask_price"),
        of(quote, "ask_size", "double").alias("ask_size"), of(quote, "ask_venue", "string").alias("ask_exchange"),
        F.col("flags").cast("array<string>").alias("conditions"), F.col("tape").cast("string").alias("tape"),
        *[c for c in ("arrival",) if c in records.columns],
    )


def tick_messages(ticks: DataFrame, topic: str = S.TICKS_TOPIC, raw: str | None = None) -> DataFrame:
    """Tick rows (``ts`` + typed columns) as ``topic, key, value``.

    The key is the symbol, so one symbol stays in one topic partition in order. Ticks
    that came in as messages go out as their ``raw`` value: fields of another type
    than the typed columns', and fields nobody knows, stay as they were.
    """
    rows = ticks.withColumn("timestamp", X.iso_text(F.col("ts")))

    def body(names):
        present = [n for n in names if n in rows.columns]
        return F.to_json(F.struct(*present), {"ignoreNullFields": "false"})

    value = F.when(F.col("type") == "trade", body(TRADE_PAYLOAD)).when(
        F.col("type") == "quote", body(QUOTE_PAYLOAD)
    )
    extra = [c for c in ("arrival",) if c in ticks.columns]
    return rows.select(
        F.lit(topic).alias("topic"),
        F.col("symbol").cast("binary").alias("key"),
        (value.cast("binary") if raw is None else F.col(raw)).alias("value"),
        *extra,
    )
