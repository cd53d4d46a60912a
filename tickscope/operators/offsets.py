"""Backlog of consumer groups and size of topics, from offset tables.

``watermarks``: topic, partition, low, high. ``committed``: group_id, topic,
partition, offset. One row per partition, so these stay small at any data size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def start_offsets(watermarks: DataFrame, committed: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Where each group continues in each existing partition of its topics.

    A partition the group never committed counts from its first retained
    message. Topics that do not exist have no rows.
    """
    return (
        subscriptions.join(watermarks, "topic")
        .join(committed, ["group_id", "topic", "partition"], "left")
        .withColumn("offset", F.coalesce("offset", "low"))
    )


def consumer_lag(watermarks: DataFrame, committed: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Messages each group still has to read; 0 when its topics do not exist."""
    behind = F.greatest(F.col("high") - F.col("offset"), F.lit(0))
    per_group = start_offsets(watermarks, committed, subscriptions).groupBy("group_id").agg(
        F.sum(behind).alias("lag")
    )
    return (
        subscriptions.select("group_id").distinct()
        .join(per_group, "group_id", "left")
        .select("group_id", F.coalesce("lag", F.lit(0)).cast("bigint").alias("lag"))
    )


def topic_sizes(watermarks: DataFrame, topics: DataFrame) -> DataFrame:
    """Messages retained per asked-for topic; 0 when it does not exist."""
    held = watermarks.groupBy("topic").agg(
        F.sum(F.greatest(F.col("high") - F.col("low"), F.lit(0))).alias("messages")
    )
    return topics.select("topic").distinct().join(held, "topic", "left").select(
        "topic", F.coalesce("messages", F.lit(0)).cast("bigint").alias("messages")
    )
