"""The streaming queries: dead letters, detection, table sink, replay, live view.

Each query has its own checkpoint and advances only after its sink has taken the
micro-batch. A fault in processing stops its query with nothing committed; bad
input never does, it goes to the dead letters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickscope import schemas as S
from tickscope.functions.series import DetectorParams
from tickscope.operators import deadletter, delivery, events, validate, views
from tickscope.sources.anomaly_table import AnomalyTable
from tickscope.sources.batch_table import BatchTable, stored
from tickscope.sources.messages import start_writing
from tickscope.streaming.detector import detect

EachBatch = Callable[[DataFrame, int], None]


def _start(rows: DataFrame, each: EachBatch, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_dead_letters(
    raw: DataFrame, fmt: str, location: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Rejected messages of a raw stream as envelopes on the dead-letter topic."""
    bad = validate.rejected(validate.validate_ticks(raw))
    rows = deadletter.envelope_messages(deadletter.envelopes(bad))
    return start_writing(rows, fmt, location, checkpoint, available_now)


def valid_trades(raw: DataFrame) -> DataFrame:
    """Valid trades of a raw stream, in the order of their topic partition.

    Messages are keyed by symbol, so a symbol's offsets order its trades.
    """
    ticks = validate.valid_ticks(validate.validate_ticks(raw))
    return validate.trades(ticks).select(
        "symbol", F.col("offset").alias("arrival"), "ts", "price", "size"
    )


def start_detection(
    raw: DataFrame,
    table: AnomalyTable,
    checkpoint: str,
    writer: str = "detection",
    params: DetectorParams = DetectorParams(),
    publish: EachBatch | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Raw messages to windows, windows to events, events into the table.

    ``publish`` may send the same events on (as ``topic, key, value``) before the
    table takes them; it sees a retried batch again, the table does not.
    """
    scored = detect(valid_trades(raw), params)

    def take(batch: DataFrame, number: int) -> None:
        found = events.anomaly_events(batch).persist()
        try:
            if publish is not None:
                publish(events.event_messages(found), number)
            table.upsert(events.event_rows(found), writer, number)
        finally:
            found.unpersist()

    return _start(scored, take, checkpoint, available_now)


def start_each_tick_batch(
    raw: DataFrame, process: EachBatch, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Hand every micro-batch of valid ticks to ``process``, the extension point.

    An error in ``process`` stops the query; the batch is handed over again on
    restart.
    """
    ticks = validate.valid_ticks(validate.validate_ticks(raw))
    return _start(ticks, process, checkpoint, available_now)


def start_table_sink(
    anomaly_messages: DataFrame,
    table: AnomalyTable,
    checkpoint: str,
    writer: str = "table-sink",
    available_now: bool = False,
) -> StreamingQuery:
    """Events from the two anomaly topics into the table; a malformed one is fatal."""
    parsed = validate.validate_anomaly_events(anomaly_messages).select(
        F.col("symbol").alias("ticker"), "window_start", "anomaly_type", "details",
        F.struct("timestamp", "topic", "partition", "offset").alias("arrival"),
    )

    def take(batch: DataFrame, number: int) -> None:
        table.upsert(batch, writer, number)

    return _start(parsed, take, checkpoint, available_now)


def start_replay(
    dead_letters: DataFrame, fmt: str, location: str, checkpoint: str
) -> StreamingQuery:
    """Send every dead letter not replayed yet back to its topic, then stop.

    The checkpoint is the replay's progress: a second run sends only what came
    since. A per-run limit is the source's admission limit.
    """
    rows = deadletter.replay_messages(deadletter.parse_envelopes(dead_letters))
    return start_writing(rows, fmt, location, checkpoint, available_now=True)


def replay_some(
    dead_letters: DataFrame, progress: str, limit: int, publish: Callable[[DataFrame], None]
) -> int:
    """Replay at most ``limit`` dead letters, oldest first; returns how many.

    ``progress`` is a parquet folder of locations already replayed, added to only
    after ``publish`` returns: a crash in between replays those records again and
    loses none. The limit is the operator's purpose, not a safeguard.
    """
    done = stored(dead_letters.sparkSession, progress, "location STRING")
    order = ["original_topic", "original_partition", "original_offset"]
    waiting = deadletter.decode(deadletter.parse_envelopes(dead_letters)).join(done, "location", "left_anti")
    chosen = waiting.orderBy(*order).limit(limit).persist()
    try:
        count = chosen.count()
        if count:
            publish(deadletter.replay_messages(chosen.drop("raw_value", "location")))
            chosen.select("location").coalesce(1).write.mode("append").parquet(progress)
        return count
    finally:
        chosen.unpersist()


AUDIT = (
    "trade_id BIGINT, ticker STRING, attempts BIGINT, first_processed_at TIMESTAMP, last_processed_at TIMESTAMP"
)


def start_delivery_audit(
    log: DataFrame,
    table: BatchTable,
    checkpoint: str,
    writer: str = "delivery-audit",
    available_now: bool = False,
) -> StreamingQuery:
    """Attempts of every trade id of a delivery log, kept up to date as the log grows.

    Counts live in the query's state; a micro-batch delivers the ids it changed to
    ``table`` (of `AUDIT`), and `current_audit` reads the newest row of each. A
    micro-batch that is handed over again finds its delivery there.
    """

    def take(batch: DataFrame, number: int) -> None:
        table.deliver(batch, writer, number)

    changed = delivery.delivery_audit(log).writeStream.foreachBatch(take).outputMode("update")
    changed = changed.option("checkpointLocation", checkpoint)
    return (changed.trigger(availableNow=True) if available_now else changed).start()


def newest_audit(rows: DataFrame) -> DataFrame:
    """The newest of each trade id's rows, with its writer and batch."""
    rest = [c for c in rows.columns if c != "trade_id"]
    newest = F.max_by(F.struct(*rest), F.struct("batch", "writer")).alias("newest")
    return rows.groupBy("trade_id").agg(newest).select("trade_id", "newest.*")


def current_audit(table: BatchTable) -> DataFrame:
    """One row per trade id, as `delivery.delivery_audit` of the log so far."""
    return newest_audit(table.deliveries()).drop("writer", "batch")


def start_live_view(
    raw: DataFrame,
    show: Callable[[DataFrame], None],
    checkpoint: str,
    length: int = S.FEED_LENGTH,
    available_now: bool = False,
) -> StreamingQuery:
    """Newest messages as they come, unvalidated, for display.

    ``show`` gets the current feed, newest arrival first, at most ``length``
    messages, whatever the size of a micro-batch. Open ``raw`` with ``starting='latest'``.
    """
    feed: list = []
    shape = "key BINARY, value BINARY, arrival STRUCT<timestamp: TIMESTAMP, partition: INT, offset: BIGINT>"

    def take(batch: DataFrame, number: int) -> None:
        arrived = batch.withColumn("arrival", F.struct("timestamp", "partition", "offset"))
        new = views.latest_messages(arrived.select("key", "value", "arrival"), length)
        feed[:] = (new.select("key", "value", "arrival").collect() + feed)[:length]
        show(batch.sparkSession.createDataFrame(feed, shape))

    return _start(raw, take, checkpoint, available_now)
