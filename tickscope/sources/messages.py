"""Reading and writing message topics, on Kafka or as files of the same shape."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickscope import schemas as S

FILE_FORMATS = ("parquet", "orc", "json")


Starting = str | dict[str, dict[int, int]]


def stream_messages(
    spark: SparkSession,
    fmt: str,
    location: str,
    topics: tuple[str, ...] | None = (S.TICKS_TOPIC,),
    starting: Starting = "earliest",
    per_trigger: int | None = None,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Messages as a stream with the Kafka source's columns.

    ``location`` is the bootstrap servers for ``fmt='kafka'``, else a folder.
    ``starting``: ``'earliest'``, ``'latest'`` (skips what is there when this is called), or
    the first offset by topic and partition; partitions not named start at the first
    message. Use a fresh checkpoint with the last two. ``per_trigger`` bounds a
    micro-batch in messages (Kafka) or files, and with files written with
    ``rows_per_file`` in messages too. ``topics=None`` takes every topic found in a
    folder, for readers that check the topic themselves.
    """
    reader = spark.readStream.format(fmt).options(**(options or {}))
    if fmt == "kafka":
        reader = (
            reader.option("kafka.bootstrap.servers", location)
            .option("subscribe", ",".join(topics))
            .option("startingOffsets", starting if isinstance(starting, str) else json.dumps(starting))
        )
        if per_trigger:
            reader = reader.option("maxOffsetsPerTrigger", per_trigger)
        return _of_topics(reader.load(), topics)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    rows = _of_topics(reader.schema(S.RAW_MESSAGE).load(location), topics)
    if starting == "latest":
        starting = next_offsets(read_messages(spark, fmt, location, topics, options))
    return rows if starting == "earliest" else _from_offsets(rows, starting)


def next_offsets(messages: DataFrame) -> dict[str, dict[int, int]]:
    """By topic and partition, the offset after the last message there; a row for each partition."""
    ends = messages.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("offset"))
    out: dict[str, dict[int, int]] = {}
    for r in ends.collect():
        out.setdefault(r["topic"], {})[r["partition"]] = r["offset"]
    return out


def _from_offsets(rows: DataFrame, starting: dict[str, dict[int, int]]) -> DataFrame:
    before = F.lit(False)
    for topic, partitions in starting.items():
        for partition, offset in partitions.items():
            here = (F.col("topic") == topic) & (F.col("partition") == partition)
            before |= here & (F.col("offset") < offset)
    return rows.where(~before)


def read_messages(
    spark: SparkSession,
    fmt: str,
    location: str,
    topics: tuple[str, ...] | None = (S.TICKS_TOPIC,),
    options: dict[str, str] | None = None,
) -> DataFrame:
    """All messages there are now, as a batch; ends at once on an empty topic."""
    reader = spark.read.format(fmt).options(**(options or {}))
    if fmt == "kafka":
        rows = (
            reader.option("kafka.bootstrap.servers", location)
            .option("subscribe", ",".join(topics))
            .option("startingOffsets", "earliest").option("endingOffsets", "latest").load()
        )
    else:
        rows = reader.schema(S.RAW_MESSAGE).load(location)
    return _of_topics(rows, topics)


def _of_topics(rows: DataFrame, topics: tuple[str, ...] | None) -> DataFrame:
    rows = rows.select("key", "value", "topic", "partition", "offset", "timestamp")
    return rows if topics is None else rows.where(F.col("topic").isin(*topics))


def start_writing(
    messages: DataFrame, fmt: str, location: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Write a stream of ``topic, key, value`` (and more columns, for files).

    Kafka honours the topic column; files are partitioned by it. The file sink's
    own log makes a retried micro-batch add nothing.
    """
    if fmt == "kafka":
        writer = messages.select("topic", "key", "value").writeStream.format("kafka").option(
            "kafka.bootstrap.servers", location
        )
    else:
        writer = messages.writeStream.format(fmt).option("path", location).partitionBy("topic")
    writer = writer.option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def write_messages(
    messages: DataFrame, fmt: str, location: str, mode: str = "append", rows_per_file: int | None = None
) -> None:
    """The same for a batch. ``rows_per_file`` bounds a file, and so what a reader admits with it."""
    if fmt == "kafka":
        messages.select("topic", "key", "value").write.format("kafka").option(
            "kafka.bootstrap.servers", location
        ).save()
    else:
        writer = messages.write.format(fmt).mode(mode).partitionBy("topic")
        (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).save(location)
