"""The driver's tables mapped to the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickscope import schemas as S
from tickscope.functions import text as X

LONG_WINDOW_SECONDS = 900.0
DAY_PART_SECONDS = 43200.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """More tasks for work that is heavy per row, where the scan is a single one.

    The test tables are one row group each. A single split holds no more than
    ``spark.sql.files.maxPartitionBytes``, which bounds what is moved; tables of
    several splits are never shuffled by this.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() == 1 else rows


def trades(events: DataFrame, symbol) -> DataFrame:
    """Events as trades of ``symbol``; the event id is the arrival order."""
    return events.select(
        symbol.alias("symbol"), F.col("event_id").alias("arrival"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("size"),
    )


def trades_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few symbols with long series: the event type."""
    return trades(table(spark, sf_dir, "events"), F.col("event_type"))


def trades_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many symbols: the user."""
    return trades(table(spark, sf_dir, "events"), F.col("user_id").cast("string"))


def messages(events: DataFrame) -> DataFrame:
    """Events as raw messages: trades, quotes, and ten kinds of odd payloads.

    purchase and click become trades, view and signup quotes; error events are odd in a
    way picked by ``event_id % 10``: six fail one validation step each, one has text after
    the object, one a number for a timestamp, and two are valid trades, with keys that
    come twice and with a compact timestamp.
    """
    symbol = F.col("user_id").cast("string")
    size = F.get_json_object("props", "$.k").cast("double")
    common = {
        "symbol": symbol, "timestamp": X.iso_text(F.col("ts").cast("timestamp")),
        "conditions": F.array(F.lit("@")), "tape": F.lit("C"),
    }

    def body(**fields):
        cols = {**common, **fields}
        return F.to_json(F.struct(*[c.alias(n) for n, c in cols.items()]))

    price = F.col("value")
    trade = {"price": price, "size": size, "exchange": F.lit("V"), "trade_id": F.col("event_id")}
    quote = {
        "bid_price": price, "bid_size": size, "bid_exchange": F.lit("V"),
        "ask_price": price + 0.5, "ask_size": size, "ask_exchange": F.lit("V"),
    }
    no_price = {k: v for k, v in trade.items() if k != "price"}
    kind = F.col("event_id") % 10
    compact = F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd'T'HHmmss.SSSSSS'Z'")
    whole = body(type=F.lit("trade"), **trade)
    text = (
        F.when(F.col("event_type").isin("purchase", "click"), body(type=F.lit("trade"), **trade))
        .when(F.col("event_type").isin("view", "signup"), body(type=F.lit("quote"), **quote))
        .when(kind == 1, F.concat(F.lit("{not json "), F.col("props")))
        .when(kind == 2, F.concat(F.lit("["), F.col("props"), F.lit("]")))
        .when(kind == 3, body(type=F.lit("bar"), **trade))
        .when(kind == 4, body(type=F.lit("trade"), **no_price))
        .when(kind == 5, body(type=F.lit("trade"), **{**trade, "timestamp": F.lit("not-a-timestamp")}))
        .when(kind == 6, F.concat(whole, F.lit(" and more")))
        .when(kind == 7, F.concat(F.lit('{"symbol":"another","price":-1.0,'), F.substr(whole, F.lit(2))))
        .when(kind == 8, body(type=F.lit("trade"), **{**trade, "timestamp": F.lit(5)}))
        .when(kind == 9, body(type=F.lit("trade"), **{**trade, "timestamp": compact}))
    )
    broken = F.concat(F.unhex(F.lit("FFFE")), F.col("props").cast("binary"))
    # Out of a generator, so that filters on the value do not repeat making it.
    value = F.explode(F.array(F.coalesce(text.cast("binary"), broken)))
    return events.select(
        symbol.cast("binary").alias("key"),
        value.alias("value"),
        F.lit(S.TICKS_TOPIC).alias("topic"),
        (F.col("user_id") % 6).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spread(table(spark, sf_dir, "events")))


PROVIDER_ZONE = "Asia/Tokyo"


def provider_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a provider's records: local clock times, short names, both kinds and some bars."""
    size = F.get_json_object("props", "$.k").cast("double")
    kind = F.when(F.col("event_type").isin("purchase", "click"), "trade").when(
        F.col("event_type").isin("view", "signup"), "quote").otherwise("bar")
    return table(spark, sf_dir, "events").select(
        kind.alias("kind"), F.col("user_id").cast("string").alias("symbol"), F.col("ts").alias("at"),
        F.col("value").alias("price"), size.alias("size"), F.lit("V").alias("venue"),
        F.col("event_id").alias("id"), F.col("value").alias("bid"), size.alias("bid_size"),
        F.lit("V").alias("bid_venue"), (F.col("value") + 0.5).alias("ask"), size.alias("ask_size"),
        F.lit("Q").alias("ask_venue"), F.array(F.lit("@"), F.lit("I")).alias("flags"), F.lit("C").alias("tape"),
        F.col("event_id").alias("arrival"),
    )


def dense_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per return flag; nearly every day filled."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy(
        F.to_date("l_shipdate").alias("date"), F.col("l_returnflag").alias("ticker")
    ).agg(F.avg(unit).alias("close"), F.sum("l_quantity").alias("volume"))


def sparse_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per order priority; many days missing."""
    return table(spark, sf_dir, "orders").groupBy(
        F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("ticker")
    ).agg(F.avg("o_totalprice").alias("close"), F.sum("o_totalprice").alias("volume"))


def daily_windows(panel: DataFrame) -> DataFrame:
    """Panel days as window summaries."""
    return panel.select(
        F.col("ticker").alias("symbol"),
        F.col("date").cast("timestamp").alias("window_start"),
        F.date_add("date", 1).cast("timestamp").alias("window_end"),
        F.lit(1).cast("bigint").alias("trade_count"),
        "volume",
        F.lit(None).cast("double").alias("realized_volatility"),
    )


def watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_returnflag").alias("topic"), (F.col("l_suppkey") % 6).cast("int").alias("partition")
    ).agg(F.min("l_orderkey").alias("low"), F.max("l_orderkey").alias("high"))


STREAMING_GROUP, SINK_GROUP = "tick-readers", "anomaly-writers"


def subscriptions(marks: DataFrame) -> DataFrame:
    rows = [(STREAMING_GROUP, "A"), (STREAMING_GROUP, "absent"), (SINK_GROUP, "N"), (SINK_GROUP, "R")]
    return marks.sparkSession.createDataFrame(rows, "group_id STRING, topic STRING")


def committed(marks: DataFrame) -> DataFrame:
    """Offsets halfway through, in even partitions only."""
    halfway = F.floor((F.col("low") + F.col("high")) / 2)
    groups = F.when(F.col("topic") == "A", STREAMING_GROUP).otherwise(SINK_GROUP)
    return marks.where(F.col("partition") % 2 == 0).select(
        groups.alias("group_id"), "topic", "partition", halfway.alias("offset")
    )


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select(
        (F.col("user_id") + 1).alias("rank"), F.col("user_id").cast("string").alias("symbol")
    )


def delivery_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("trade_id"), F.col("l_returnflag").alias("ticker"),
        F.col("l_shipdate").cast("timestamp").alias("processed_at"),
    )


def lag_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event type, the events still to come after each hour."""
    ts = F.col("ts").cast("timestamp")
    hourly = table(spark, sf_dir, "events").groupBy(
        F.col("event_type").alias("run"), F.floor(F.unix_timestamp(ts) / 3600).alias("hour")
    ).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.unix_micros(ts)).alias("first"),
        F.max(F.unix_micros(ts)).alias("last"),
    )
    run = Window.partitionBy("run")
    done = F.sum("n").over(run.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(run)
    return hourly.select(
        "run",
        ((F.col("hour") + 1 - F.min("hour").over(run)) * 3600.0).alias("elapsed"),
        (total - done).alias("lag"),
        total.alias("burst_size"),
        ((F.max("last").over(run) - F.min("first").over(run)) / 1e6).alias("produce_seconds"),
    )
