"""What readers see: anomaly lists, feeds, freshness, counts, the status row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickscope import schemas as S
from tickscope.functions import text as X


def newest_anomalies(
    anomalies: DataFrame,
    ticker: str | None = None,
    anomaly_type: str | None = None,
    limit: int = S.LIST_LIMIT,
) -> DataFrame:
    """Newest first, optionally of one ticker and one type; key breaks ties."""
    rows = anomalies
    if ticker is not None:
        rows = rows.where(F.col("ticker") == F.lit(ticker))
    if anomaly_type is not None:
        rows = rows.where(F.col("anomaly_type") == F.lit(anomaly_type))
    return rows.orderBy(
        F.desc("detected_at"), "ticker", "window_start", "anomaly_type"
    ).limit(limit)


def anomalies_in_time_order(anomalies: DataFrame) -> DataFrame:
    """Ticker, start and type with the UTC date, by window start."""
    return anomalies.select(
        "ticker", "window_start", "anomaly_type", F.to_date("window_start").alias("date")
    ).orderBy("window_start", "ticker", "anomaly_type")


def latest_messages(messages: DataFrame, length: int = S.FEED_LENGTH) -> DataFrame:
    """The newest messages by ``arrival`` whose value is JSON; nothing else is checked.

    One top-k over the scan: each task keeps ``length`` rows. A caller who knows how
    far back the feed reaches puts a bound on ``arrival`` first, and it reaches the scan.
    """
    readable = messages.withColumn("payload", F.col("value").cast("string")).where(
        F.is_valid_utf8("payload") & X.is_single_json(F.col("payload"))
    )
    return readable.orderBy(F.desc("arrival")).limit(length)


def waiting_messages(messages: DataFrame, marks: DataFrame, by: str = "viewer") -> DataFrame:
    """Each viewer's messages after the last one it has seen (all of them, if it has seen none).

    ``messages`` and ``marks`` share the column ``by``: who a message is for, and what a
    viewer follows. ``marks`` has one row per viewer and its ``seen`` arrival, which may be
    null; viewers without a row get nothing. There is no cap: a backlog is as long as it is.
    """
    seen = marks.select(by, "seen")
    late = F.col("seen").isNull() | (F.col("arrival") > F.col("seen"))
    return messages.join(seen, by).where(late).drop("seen")


def latest_per_symbol(ticks: DataFrame) -> DataFrame:
    """Each symbol's last tick by arrival (unique within a symbol).

    ``max_by`` combines before the shuffle, so a busy symbol sends one row per
    task. One per column, not one of a struct: numbers and times then stay in a
    hash aggregation, where a struct would need a sort first.
    """
    rest = [c for c in ticks.columns if c not in ("symbol", "arrival")]
    return ticks.groupBy("symbol").agg(
        F.max("arrival").alias("arrival"), *[F.max_by(c, "arrival").alias(c) for c in rest]
    )


def model_freshness(windows: DataFrame) -> DataFrame:
    """End of the last window each symbol's detectors have seen."""
    return windows.groupBy("symbol").agg(F.max("window_end").alias("last_updated"))


def anomaly_counts(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("ticker", "anomaly_type").agg(F.count(F.lit(1)).alias("anomalies"))


def with_labels(anomalies: DataFrame) -> DataFrame:
    """Display name of the anomaly type."""
    return anomalies.withColumn(
        "label",
        F.when(F.col("anomaly_type") == S.VOLUME_ANOMALY, "Volume Spike").otherwise("Regime Change"),
    )


def tick_text(ticks: DataFrame) -> DataFrame:
    """Display text of a tick: price and size of a trade, both sides of a quote."""
    # Never in exponent form: 12345678, not 1.2345678E7.
    size = F.regexp_replace(F.format_string("%.10f", F.col("size").cast("double")), r"\.?0+$", "")
    return ticks.withColumn(
        "detail",
        F.when(F.col("type") == "trade", F.concat(F.format_string("$%.2f × ", "price"), size))
        .otherwise(F.format_string("bid $%.2f / ask $%.2f", "bid_price", "ask_price")),
    )


def status_report(
    lag: DataFrame,
    dlq_depth: DataFrame,
    freshness: DataFrame,
    streaming_group: str,
    sink_group: str,
    checked_at: Column | None = None,
) -> DataFrame:
    """The report as rows: section, name, number, at.

    consumer_lag has a row for each of the two groups and dlq_depth one, with a
    ``number``; model_freshness has a row per tracked symbol and checked_at one, with
    an ISO time ``at``. However many symbols there are, no row grows and nothing is joined.
    """
    checked = checked_at if checked_at is not None else F.current_timestamp()
    none, no_time = F.lit(None).cast("bigint"), F.lit(None).cast("string")

    def lag_of(group: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("group_id") == group, F.col("lag"))), F.lit(0))

    def figure(section: str, name: str, number: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), F.lit(name).alias("name"), number.alias("number"), no_time.alias("at"))

    lags = lag.agg(F.array(
        figure("consumer_lag", "streaming", lag_of(streaming_group)),
        figure("consumer_lag", "storage_sink", lag_of(sink_group)),
    ).alias("rows"))
    depth = F.coalesce(F.sum("messages"), F.lit(0)).cast("bigint")
    dead = dlq_depth.agg(F.array(figure("dlq_depth", "dead_letters", depth)).alias("rows"))
    figures = lags.unionByName(dead).select(F.inline("rows"))
    fresh = freshness.select(
        F.lit("model_freshness").alias("section"), F.col("symbol").alias("name"), none.alias("number"),
        X.iso_text(F.col("last_updated")).alias("at"),
    )
    now = lag.sparkSession.range(1).select(
        F.lit("checked_at").alias("section"), F.lit("status").alias("name"), none.alias("number"),
        X.iso_text(checked).alias("at"),
    )
    return figures.unionByName(fresh).unionByName(now)
