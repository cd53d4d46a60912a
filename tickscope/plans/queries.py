"""One callable per operator, over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickscope import schemas as S
from tickscope.functions.series import DetectorParams
from tickscope.operators import (
    anchored, crossref, deadletter, delivery, evaluate, events, factors, normalise, offsets,
    regime, universe, upsert, validate, views, volume,
)
from tickscope.plans import inputs as I
from tickscope.session import apply_runtime_settings, ensure_checkpoint_dir, written
from tickscope.sources.anomaly_table import AnomalyTable
from tickscope.sources.batch_table import BatchTable, stored
from tickscope.sources.messages import stream_messages, write_messages
from tickscope.streaming import jobs
from tickscope.streaming.detector import detect, freshness_from_state, model_state
from tickscope.streaming.progress import ProgressLog, backlog_samples

Query = Callable[[SparkSession, str], DataFrame]

LOW_Z = 2.0


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


# --- validation, dead letters, payloads -------------------------------------------------


def tick_validation(spark, sf):
    checked = validate.validate_ticks(I.raw_messages(spark, sf))
    ok = F.col("error").isNull()
    return checked.select(
        F.col("offset").alias("event_id"), "error", F.when(ok, F.col("type")).alias("type"),
        F.when(ok, F.col("symbol")).alias("symbol"), F.when(ok, F.unix_micros("ts")).alias("ts_us"),
        F.when(ok, F.col("price")).alias("price"), F.when(ok, F.col("bid_price")).alias("bid_price"),
    )


def valid_and_rejected_counts(spark, sf):
    checked = validate.validate_ticks(I.raw_messages(spark, sf))
    branch = F.when(F.col("error").isNull(), "valid").otherwise("rejected")
    return checked.groupBy(branch.alias("branch"), "partition").agg(F.count(F.lit(1)).alias("n"))


def _dead_letters(spark, sf):
    checked = validate.validate_ticks(I.raw_messages(spark, sf))
    return deadletter.envelopes(validate.rejected(checked))


def dead_letter_envelopes(spark, sf):
    return _dead_letters(spark, sf).drop("failed_at")


def dead_letter_inspect(spark, sf):
    stored = deadletter.parse_envelopes(deadletter.envelope_messages(_dead_letters(spark, sf)))
    return deadletter.inspect(stored).select("location", "key", "error", F.hex("raw_value").alias("raw_hex"))


def dead_letter_replay(spark, sf):
    sent = deadletter.replay_messages(_dead_letters(spark, sf))
    return sent.select(
        "topic", F.col("key").cast("string").alias("key"), F.hex("value").alias("value_hex"), "location"
    )


def valid_trades(spark, sf):
    checked = validate.validate_ticks(I.raw_messages(spark, sf))
    rows = validate.trades(validate.valid_ticks(checked))
    return rows.select(
        "symbol", F.col("offset").alias("arrival"), F.unix_micros("ts").alias("ts_us"), "price", "size",
        "trade_id",
    )


def tick_messages(spark, sf):
    checked = validate.valid_ticks(validate.validate_ticks(I.raw_messages(spark, sf)))
    sent = normalise.tick_messages(checked.withColumn("arrival", F.col("offset")))
    text = F.col("value").cast("string")

    def field(name, cast="string"):
        return F.get_json_object(text, f"$.{name}").cast(cast).alias(name)

    return sent.select(
        F.col("arrival").alias("event_id"), "topic", F.col("key").cast("string").alias("key"),
        field("type"), field("symbol"), field("timestamp"), field("price", "double"),
        field("size", "double"), field("trade_id", "bigint"), field("bid_price", "double"),
        field("ask_price", "double"), field("ask_size", "double"), field("tape"),
    )


def provider_messages(spark, sf):
    """Provider records with local clock times, normalised and sent."""
    sent = normalise.tick_messages(normalise.provider_ticks(I.provider_records(spark, sf), I.PROVIDER_ZONE))
    text = F.col("value").cast("string")

    def field(name, cast="string"):
        return F.get_json_object(text, f"$.{name}").cast(cast).alias(name)

    return sent.select(
        F.col("arrival").alias("event_id"), "topic", F.col("key").cast("string").alias("key"),
        field("type"), field("timestamp"), field("price", "double"), field("size", "double"),
        field("exchange"), field("trade_id", "bigint"), field("bid_price", "double"),
        field("ask_price", "double"), field("ask_size", "double"), field("conditions"), field("tape"),
        F.size(F.json_object_keys(text)).alias("n_fields"),
    )


# --- windows -----------------------------------------------------------------------------


def _long_windows(spark, sf):
    return anchored.window_summaries(I.trades_by_type(spark, sf), I.LONG_WINDOW_SECONDS)


def _user_windows(spark, sf):
    return anchored.window_summaries(I.trades_by_user(spark, sf), I.DAY_PART_SECONDS)


def _summary_columns():
    return (
        "symbol", "window_index", F.unix_micros("window_start").alias("start_us"),
        F.unix_micros("window_end").alias("end_us"), "trade_count", _r("volume"),
        _r("realized_volatility"),
    )


def log_returns(spark, sf):
    """Buckets of 4,096 orders, so that prices are carried over their borders here too."""
    rows = anchored.log_returns_of(I.trades_by_type(spark, sf), 4096)
    return rows.select("symbol", "arrival", "previous_price", _r("log_return"))


def anchored_windows(spark, sf):
    return _long_windows(spark, sf).select(*_summary_columns())


def anchored_windows_many_symbols(spark, sf):
    return _user_windows(spark, sf).select(*_summary_columns())


def anchored_windows_split(spark, sf):
    """The same windows with every symbol cut into chunks of a few hundred trades."""
    split = anchored.window_summaries(I.trades_by_type(spark, sf), I.LONG_WINDOW_SECONDS, 512)
    return split.select(*_summary_columns())


def log_volatility(spark, sf):
    rows = _long_windows(spark, sf).where(F.col("realized_volatility").isNotNull())
    return rows.select(
        "symbol", "window_index",
        F.round(regime.log_volatility(F.col("realized_volatility")), 6).alias("log_volatility"),
    )


# --- detectors ---------------------------------------------------------------------------


def volume_scores(spark, sf):
    scored = volume.score_volume(_long_windows(spark, sf))
    return scored.select(
        "symbol", "window_index", F.unix_micros("window_start").alias("start_us"), _r("volume"),
        _r("score_mean"), _r("score_std"), _r("anomaly_score"), "is_volume_anomaly",
    )


def _low_bar(spark, sf):
    return volume.score_volume(_long_windows(spark, sf), z_threshold=LOW_Z)


def volume_anomalies(spark, sf):
    rows = volume.volume_anomalies(volume.score_volume(_long_windows(spark, sf)))
    return rows.select(
        "symbol", F.unix_micros("window_start").alias("start_us"),
        F.unix_micros("window_end").alias("end_us"), _r("volume"), "trade_count",
        _r("anomaly_score"), _r("score_mean"), _r("score_std"),
    )


def volume_anomalies_low_threshold(spark, sf):
    rows = volume.volume_anomalies(_low_bar(spark, sf))
    return rows.select(
        "symbol", F.unix_micros("window_start").alias("start_us"), _r("anomaly_score")
    )


def regime_scores(spark, sf):
    scored = regime.score_regime(_long_windows(spark, sf))
    return scored.where(F.col("realized_volatility").isNotNull()).select(
        "symbol", "window_index", _r("realized_volatility"), _r("changepoint_probability"),
        "is_regime_change",
    )


def regime_changes(spark, sf):
    """User windows: short series with real shifts between quiet and lively users."""
    rows = regime.regime_changes(regime.score_regime(_user_windows(spark, sf)))
    return rows.select(
        "symbol", F.unix_micros("window_start").alias("start_us"),
        F.unix_micros("window_end").alias("end_us"), _r("realized_volatility"),
        _r("changepoint_probability"),
    )


def anomaly_events(spark, sf):
    scored = events.score_windows(_long_windows(spark, sf), z_threshold=LOW_Z)
    return events.anomaly_events(scored).select(
        "symbol", F.unix_micros("window_start").alias("start_us"), "anomaly_type", "event_order",
        _r("anomaly_score"),
        _r("changepoint_probability"),
    )


def _both_kinds(spark, sf):
    """Both detectors' events: volume spikes of the long series, regime changes of the users."""
    spikes = volume.volume_anomalies(_low_bar(spark, sf))
    shifts = regime.regime_changes(regime.score_regime(_user_windows(spark, sf)))
    return events.union_events(spikes, shifts)


def anomaly_union(spark, sf):
    return _both_kinds(spark, sf).select(
        "anomaly_type", "symbol", F.unix_micros("window_start").alias("start_us"), _r("volume"),
        _r("realized_volatility"), _r("changepoint_probability"),
    )


def anomaly_payloads(spark, sf):
    text = F.col("value").cast("string")

    def number(name):
        return F.round(F.get_json_object(text, f"$.{name}").cast("double"), 6).alias(name)

    sent = events.event_messages(_both_kinds(spark, sf))
    return sent.select(
        "topic", F.col("key").cast("string").alias("key"),
        F.get_json_object(text, "$.window_start").alias("window_start"),
        F.get_json_object(text, "$.window_end").alias("window_end"),
        number("volume"), number("anomaly_score"), number("realized_volatility"),
        number("changepoint_probability"),
    )


def anomaly_event_parsing(spark, sf):
    """Events written to their topics and read back with validation."""
    back = validate.validate_anomaly_events(events.event_messages(_both_kinds(spark, sf)))
    return back.select(
        "topic", "anomaly_type", "symbol", F.unix_micros("window_start").alias("start_us"),
        F.size(F.json_object_keys("details")).alias("n_fields"),
    )


# --- anomaly table -----------------------------------------------------------------------


def _anomaly_log(spark, sf):
    """Every event delivered twice, the first time with a provisional reading of twice the size."""
    found = _both_kinds(spark, sf).withColumn("batch", F.explode(F.array(F.lit(0), F.lit(1))))

    def reading(name):
        return F.when(F.col("batch") == 0, 2 * F.col(name)).otherwise(F.col(name))

    found = found.withColumns({n: reading(n) for n in ("volume", "realized_volatility")})
    return events.with_details(found).select(
        F.col("symbol").alias("ticker"), "window_start", "anomaly_type", "details",
        (F.col("window_start") + F.make_dt_interval(hours=F.lit(1) + F.col("batch"))).alias("detected_at"),
        "batch",
    )


def _anomaly_table(spark, sf):
    return upsert.current_rows(_anomaly_log(spark, sf), order=["batch"])


def anomaly_upsert(spark, sf):
    def number(name):
        return F.round(F.get_json_object("details", f"$.{name}").cast("double"), 6).alias(name)

    return _anomaly_table(spark, sf).select(
        "ticker", F.unix_micros("window_start").alias("start_us"), "anomaly_type",
        F.get_json_object("details", "$.window_end").alias("window_end"),
        number("volume"), number("realized_volatility"), number("anomaly_score"),
        number("changepoint_probability"), F.unix_micros("detected_at").alias("detected_us"),
    )


def _listed(rows):
    return rows.select(
        "ticker", F.unix_micros("window_start").alias("start_us"), "anomaly_type",
        F.unix_micros("detected_at").alias("detected_us"),
    )


def newest_anomalies(spark, sf):
    return _listed(views.newest_anomalies(_anomaly_table(spark, sf)))


def newest_anomalies_filtered(spark, sf):
    rows = views.newest_anomalies(_anomaly_table(spark, sf), "click", S.VOLUME_ANOMALY, 20)
    return _listed(rows)


def anomalies_in_time_order(spark, sf):
    rows = views.anomalies_in_time_order(_anomaly_table(spark, sf))
    return rows.select(
        "ticker", F.unix_micros("window_start").alias("start_us"), "anomaly_type",
        F.col("date").cast("string").alias("date"),
    )


def anomaly_counts(spark, sf):
    return views.with_labels(views.anomaly_counts(_anomaly_table(spark, sf)))


# --- tick views --------------------------------------------------------------------------


def latest_ticks_feed(spark, sf):
    rows = I.raw_messages(spark, sf).withColumn("arrival", F.col("offset"))
    return views.latest_messages(rows).select(
        "arrival", F.col("key").cast("string").alias("key"),
        F.get_json_object("payload", "$.type").alias("type"),
    )


def waiting_messages(spark, sf):
    """Per user, who follows its own messages and has seen all up to its last purchase: what waits."""
    log = I.table(spark, sf, "events")
    rows = I.messages(log).select(
        F.col("key").cast("string").alias("viewer"), F.col("offset").alias("arrival"), "partition")
    bought = F.max(F.when(F.col("event_type") == "purchase", F.col("event_id")))
    marks = log.groupBy(F.col("user_id").cast("string").alias("viewer")).agg(bought.alias("seen"))
    return views.waiting_messages(rows, marks)


def latest_tick_per_symbol(spark, sf):
    return views.latest_per_symbol(I.trades_by_user(spark, sf)).select(
        "symbol", "arrival", F.unix_micros("ts").alias("ts_us"), "price", "size"
    )


def tick_text(spark, sf):
    checked = validate.valid_ticks(validate.validate_ticks(I.raw_messages(spark, sf)))
    return views.tick_text(checked).select(F.col("offset").alias("event_id"), "type", "detail")


# --- health ------------------------------------------------------------------------------


def model_freshness(spark, sf):
    rows = views.model_freshness(_long_windows(spark, sf))
    return rows.select("symbol", F.unix_micros("last_updated").alias("updated_us"))


def _lag(spark, sf):
    marks = I.watermarks(spark, sf)
    return offsets.consumer_lag(marks, I.committed(marks), I.subscriptions(marks))


def consumer_lag(spark, sf):
    return _lag(spark, sf)


def start_offsets(spark, sf):
    marks = I.watermarks(spark, sf)
    rows = offsets.start_offsets(marks, I.committed(marks), I.subscriptions(marks))
    return rows.select("group_id", "topic", "partition", "offset")


def topic_sizes(spark, sf):
    marks = I.watermarks(spark, sf)
    asked = spark.createDataFrame([("A",), ("N",), ("R",), ("absent",)], "topic STRING")
    return offsets.topic_sizes(marks, asked)


def status_report(spark, sf):
    marks = I.watermarks(spark, sf)
    dead = offsets.topic_sizes(marks, spark.createDataFrame([("R",)], "topic STRING"))
    fresh = views.model_freshness(_user_windows(spark, sf))
    report = views.status_report(_lag(spark, sf), dead, fresh, I.STREAMING_GROUP, I.SINK_GROUP)
    return report.where("section != 'checked_at'")


# --- factors and cross-reference ---------------------------------------------------------


def _panel_moves(panel):
    return factors.factor_move_z(factors.factor_scores(panel))


def factor_scores(spark, sf):
    rows = factors.factor_scores(I.dense_panel(spark, sf))
    return rows.select(F.col("date").cast("string").alias("date"), "ticker", "factor", _r("score"))


def factor_moves(spark, sf):
    rows = _panel_moves(I.dense_panel(spark, sf))
    return rows.select(F.col("date").cast("string").alias("date"), "ticker", "factor", _r("z"))


def factor_moves_sparse(spark, sf):
    rows = _panel_moves(I.sparse_panel(spark, sf))
    return rows.select(F.col("date").cast("string").alias("date"), "ticker", "factor", _r("z"))


def sharp_moves(spark, sf):
    rows = factors.sharp_moves(_panel_moves(I.sparse_panel(spark, sf)))
    return rows.select(F.col("date").cast("string").alias("date"), "ticker", "factor", _r("z"))


def _panel_cross_reference(spark, sf):
    panel = I.sparse_panel(spark, sf)
    flagged = volume.score_volume(I.daily_windows(panel), z_threshold=LOW_Z).where("is_volume_anomaly")
    rows = crossref.with_date(flagged.select(
        F.col("symbol").alias("ticker"), "window_start", F.lit(S.VOLUME_ANOMALY).alias("anomaly_type")
    ))
    return crossref.cross_reference(rows, factors.sharp_moves(_panel_moves(panel)))


def cross_reference(spark, sf):
    text = F.transform("matches", lambda m: F.concat_ws(
        "|", m["factor"], m["date"].cast("string"), F.round(m["z"], 4).cast("decimal(20,4)").cast("string")))
    return _panel_cross_reference(spark, sf).select(
        "ticker", F.col("anomaly_date").cast("string").alias("anomaly_date"), "anomaly_type",
        F.array_join(text, ";").alias("matches"), "coincides_with_sharp_factor_move",
    )


def match_summary(spark, sf):
    return crossref.match_summary(_panel_cross_reference(spark, sf))


# --- universe and prices -----------------------------------------------------------------


def universe_ticks(spark, sf):
    kept = universe.in_universe(
        I.trades_by_user(spark, sf), universe.cap_universe(I.universe(spark, sf), 50)
    )
    return kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), _rsum("size"))


def _rsum(name):
    return F.round(F.sum(name), 6).alias(f"sum_{name}")


def ticker_union(spark, sf):
    flagged = volume.volume_anomalies(_low_bar(spark, sf)).select(F.col("symbol").alias("ticker"))
    return universe.ticker_union(universe.cap_universe(I.universe(spark, sf), 50), flagged)


def prices_between(spark, sf):
    tickers = spark.createDataFrame([("A",), ("R",)], "ticker STRING")
    rows = universe.prices_between(I.dense_panel(spark, sf), tickers, "1995-01-01", "1996-02-05")
    return rows.select(
        F.col("date").cast("string").alias("date"), "ticker",
        F.round(F.ln("close"), 6).alias("log_close"),
    )


# --- delivery ----------------------------------------------------------------------------


def delivery_audit(spark, sf):
    rows = delivery.delivery_audit(I.delivery_log(spark, sf))
    return rows.select(
        "trade_id", "ticker", "attempts", F.unix_micros("first_processed_at").alias("first_us"),
        F.unix_micros("last_processed_at").alias("last_us"),
    )


def delivery_summary(spark, sf):
    expected = I.table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("n_expected"))
    return delivery.integrity_summary(delivery.delivery_audit(I.delivery_log(spark, sf)), expected)


def drain_summary(spark, sf):
    rows = delivery.drain_summary(I.lag_samples(spark, sf))
    return rows.select(
        "run", "burst_size", _r("produce_rate"), "peak_lag", _r("recovery_seconds")
    )


# --- detector evaluation -----------------------------------------------------------------


def detector_sweep(spark, sf):
    planted = F.col("window_index") % 97 == 60
    rows = _long_windows(spark, sf).select(
        "symbol", "window_index", planted.alias("is_spike"),
        F.when(planted, F.col("volume") * 10).otherwise(F.col("volume")).alias("volume"),
    )
    return evaluate.sweep(rows).select(
        "lookback", "threshold", "spikes", "spikes_found", "recall", "false_positives",
        "false_per_500",
    )


# --- the same through Structured Streaming -----------------------------------------------

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def _drained(spark, sf, transform) -> DataFrame:
    """Rows of a stream over the events table, run until it has read everything."""
    place = f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 64)
    rows = transform(source.parquet(f"{sf}/events*.parquet"))
    writer = rows.writeStream.format("parquet").option("path", f"{place}/rows")
    query = writer.option("checkpointLocation", f"{place}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{place}/rows")


def streamed_window_scores(spark, sf):
    params = DetectorParams(window_seconds=I.LONG_WINDOW_SECONDS)
    rows = _drained(spark, sf, lambda events: detect(I.trades(events, F.col("event_type")), params))
    return rows.select(
        "symbol", "window_index", F.unix_micros("window_start").alias("start_us"), _r("volume"),
        _r("score_mean"), _r("score_std"), _r("anomaly_score"), "is_volume_anomaly",
    )


# The shipped jobs, over topics made from the tables: a file holds at most so many messages.
ROWS_PER_FILE = 1 << 16
STORED_MESSAGE = "key BINARY, value BINARY, topic STRING"


def _place(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"


def _middle(spark, sf):
    """The event id that halves the events' range: what comes up to it, and what comes later."""
    return I.table(spark, sf, "events").agg(F.max("event_id")).first()[0] // 2


def _send(rows, place: str) -> str:
    write_messages(rows, "parquet", place, rows_per_file=ROWS_PER_FILE)
    return place


def streamed_dead_letters(spark, sf):
    place = _place(spark)
    raw = stream_messages(spark, "parquet", _send(I.raw_messages(spark, sf), f"{place}/topic"))
    jobs.start_dead_letters(raw, "parquet", f"{place}/dead", f"{place}/progress", True).awaitTermination()
    return deadletter.parse_envelopes(stored(spark, f"{place}/dead", STORED_MESSAGE)).drop("failed_at")


def streamed_replay(spark, sf):
    """Two runs of the replay job; the second finds the letters that came after the first."""
    place, middle = _place(spark), _middle(spark, sf)
    letters = _dead_letters(spark, sf)
    seen = []
    for part in (F.col("original_offset") <= middle, F.col("original_offset") > middle):
        _send(deadletter.envelope_messages(letters.where(part)), f"{place}/dead")
        source = spark.readStream.schema(STORED_MESSAGE).parquet(f"{place}/dead")
        jobs.start_replay(source, "parquet", f"{place}/back", f"{place}/progress").awaitTermination()
        seen.append(written(stored(spark, f"{place}/back", f"{STORED_MESSAGE}, location STRING")))
    first, both = seen
    runs = first.withColumn("run", F.lit(1)).unionByName(both.exceptAll(first).withColumn("run", F.lit(2)))
    return runs.select("topic", F.col("key").cast("string").alias("key"), F.hex("value").alias("value_hex"), "location", "run")


def _trade_messages(spark, sf):
    """Trades of the event types as messages of one topic partition each."""
    events = I.table(spark, sf, "events")
    trades = I.trades(events, F.col("event_type")).select(
        F.lit("trade").alias("type"), "symbol", "ts", "price", "size", F.lit("V").alias("exchange"),
        F.col("arrival").alias("trade_id"), F.array().cast("array<string>").alias("conditions"),
        F.lit("C").alias("tape"), "arrival")
    return normalise.tick_messages(trades).select(
        "key", "value", "topic", F.length("key").alias("partition"), F.col("arrival").alias("offset"),
        F.current_timestamp().alias("timestamp"))


def _listed_details(rows, *more):
    def number(name):
        return F.round(F.get_json_object("details", f"$.{name}").cast("double"), 6).alias(name)

    return rows.select(
        F.col("ticker").alias("symbol"), F.unix_micros("window_start").alias("start_us"), "anomaly_type",
        number("anomaly_score"), number("changepoint_probability"), *map(number, more))


def streamed_detection(spark, sf):
    """Messages to windows to events to the table, in two runs of the job with a fold in between."""
    place, middle = _place(spark), _middle(spark, sf)
    messages = _trade_messages(spark, sf)
    table = AnomalyTable(spark, f"{place}/table")
    params = DetectorParams(window_seconds=I.LONG_WINDOW_SECONDS, z_threshold=LOW_Z)
    for part in (F.col("offset") <= middle, F.col("offset") > middle):
        _send(messages.where(part), f"{place}/topic")
        raw = stream_messages(spark, "parquet", f"{place}/topic")
        jobs.start_detection(raw, table, f"{place}/progress", params=params, available_now=True).awaitTermination()
        table.compact()
    return _listed_details(table.read())


def streamed_table_sink(spark, sf):
    """Events on their topics, provisional readings first, into the table by two runs of the sink."""
    place = _place(spark)
    log = _anomaly_log(spark, sf)
    topics = F.create_map(*[F.lit(x) for pair in S.ANOMALY_TYPE_TO_TOPIC.items() for x in pair])
    table = AnomalyTable(spark, f"{place}/table")
    for batch in (0, 1):
        _send(log.where(F.col("batch") == batch).select(
            F.col("ticker").cast("binary").alias("key"), F.col("details").cast("binary").alias("value"),
            F.try_element_at(topics, F.col("anomaly_type")).alias("topic"), F.lit(0).alias("partition"),
            F.monotonically_increasing_id().alias("offset"), F.col("detected_at").alias("timestamp"),
        ), f"{place}/topic")
        sent = stream_messages(spark, "parquet", f"{place}/topic", topics=tuple(S.TOPIC_TO_ANOMALY_TYPE))
        jobs.start_table_sink(sent, table, f"{place}/progress", available_now=True).awaitTermination()
        table.compact()
    return _listed_details(table.read(), "volume", "realized_volatility")


def streamed_delivery_audit(spark, sf):
    """The audit as a stream in two runs, with a fold in between; most ids come up in both."""
    place = _place(spark)
    log = I.delivery_log(spark, sf)
    odd = F.pmod(F.xxhash64(*log.columns), F.lit(2))
    table = BatchTable(spark, f"{place}/table", jobs.AUDIT)
    for part in (0, 1):
        log.where(odd == part).write.mode("append").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(f"{place}/log")
        source = spark.readStream.schema(log.schema).parquet(f"{place}/log")
        jobs.start_delivery_audit(source, table, f"{place}/progress", available_now=True).awaitTermination()
        table.fold(jobs.newest_audit)
    return jobs.current_audit(table).select(
        "trade_id", "ticker", "attempts", F.unix_micros("first_processed_at").alias("first_us"),
        F.unix_micros("last_processed_at").alias("last_us"))


def _resumed(spark, sf) -> tuple[DataFrame, str]:
    """Detection of the first half, then of the rest by another query that starts from its state.

    The state goes over in an empty micro-batch of its own: Spark is slow at rows that come beside it.
    """
    place, middle = _place(spark), _middle(spark, sf)
    params = DetectorParams(window_seconds=I.LONG_WINDOW_SECONDS)
    events, rows, state = I.table(spark, sf, "events"), None, None
    for name, part in (("first", F.col("event_id") <= middle), ("second", F.col("event_id") > middle)):
        events.where("false").write.parquet(f"{place}/{name}/events")
        source = spark.readStream.schema(events.schema).parquet(f"{place}/{name}/events")
        found = detect(I.trades(source, F.col("event_type")), params, state, rows_in_memory=512)
        writer = found.writeStream.format("parquet").option("path", f"{place}/{name}/rows")
        writer = writer.option("checkpointLocation", f"{place}/{name}/progress").trigger(availableNow=True)
        if state is not None:
            writer.start().awaitTermination()
        events.where(part).write.mode("append").parquet(f"{place}/{name}/events")
        writer.start().awaitTermination()
        own = spark.read.schema(found.schema).parquet(f"{place}/{name}/rows")
        rows = own if rows is None else rows.unionByName(own)
        state = model_state(spark, f"{place}/{name}/progress")
    return rows, f"{place}/second/progress"


def resumed_window_scores(spark, sf):
    return _resumed(spark, sf)[0].select(
        "symbol", "window_index", F.unix_micros("window_start").alias("start_us"), _r("volume"),
        _r("score_mean"), _r("score_std"), _r("anomaly_score"), "is_volume_anomaly")


def freshness_from_saved_state(spark, sf):
    """What the state store of the resumed query says of every symbol."""
    rows = freshness_from_state(spark, _resumed(spark, sf)[1])
    return rows.select("symbol", F.unix_micros("last_updated").alias("updated_us"))


def late_subscriber_feed(spark, sf):
    """The live view of a viewer who came when half the messages were there: the newest of the rest."""
    place, middle = _place(spark), _middle(spark, sf)
    messages = I.raw_messages(spark, sf)
    _send(messages.where(F.col("offset") <= middle), f"{place}/topic")
    raw = stream_messages(spark, "parquet", f"{place}/topic", starting="latest")
    _send(messages.where(F.col("offset") > middle), f"{place}/topic")
    feeds = []
    jobs.start_live_view(raw, feeds.append, f"{place}/progress", available_now=True).awaitTermination()
    last = feeds[-1] if feeds else views.latest_messages(messages.where("false").withColumn("arrival", F.struct("offset")))
    return last.select(
        F.col("arrival.offset").alias("event_id"), F.col("key").cast("string").alias("key"),
        F.get_json_object(F.col("value").cast("string"), "$.type").alias("type"))


def streamed_drain(spark, sf):
    """A stream's own backlog, as its progress reports tell it."""
    place = _place(spark)
    name = f"drain-{uuid.uuid4().hex}"
    raw = stream_messages(spark, "parquet", _send(I.raw_messages(spark, sf), f"{place}/topic"), per_trigger=4)
    reports = ProgressLog(spark, f"{place}/reports")
    spark.streams.addListener(reports)
    try:
        ticks = raw.writeStream.queryName(name).format("noop").option("checkpointLocation", f"{place}/progress")
        query = ticks.trigger(availableNow=True).start()
        query.awaitTermination()
        reports.wait(query)
    finally:
        spark.streams.removeListener(reports)
    burst = I.table(spark, sf, "events").agg(F.count(F.lit(1)).alias("burst_size")).select(
        F.lit(name).alias("run"), "burst_size", F.lit(1.0).alias("produce_seconds"))
    summary = delivery.drain_summary(backlog_samples(reports.reports(), burst), settle_seconds=0.0)
    return summary.select(
        "burst_size", "produce_rate", (F.col("peak_lag") < F.col("burst_size")).alias("peak_below_burst"),
        F.col("recovery_seconds").isNotNull().alias("drained"))


QUERIES: tuple[Query, ...] = (
    tick_validation, valid_and_rejected_counts, dead_letter_envelopes, dead_letter_inspect,
    dead_letter_replay, valid_trades, tick_messages, provider_messages, log_returns, anchored_windows,
    anchored_windows_many_symbols, anchored_windows_split, log_volatility, volume_scores,
    volume_anomalies, volume_anomalies_low_threshold, regime_scores, regime_changes,
    anomaly_events, anomaly_union, anomaly_payloads, anomaly_event_parsing, anomaly_upsert,
    newest_anomalies, newest_anomalies_filtered, anomalies_in_time_order, anomaly_counts,
    latest_ticks_feed, waiting_messages, latest_tick_per_symbol, tick_text, model_freshness,
    consumer_lag, start_offsets, topic_sizes, status_report, factor_scores, factor_moves,
    factor_moves_sparse, sharp_moves, cross_reference, match_summary, universe_ticks,
    ticker_union, prices_between, delivery_audit, delivery_summary, drain_summary,
    detector_sweep, streamed_window_scores, streamed_dead_letters, streamed_replay, streamed_detection,
    streamed_table_sink, streamed_delivery_audit, resumed_window_scores, freshness_from_saved_state,
    late_subscriber_feed, streamed_drain,
)


def registry() -> dict[str, Query]:
    def prepared(query: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return query(apply_runtime_settings(spark), str(sf_dir))

        return run

    return {query.__name__: prepared(query) for query in QUERIES}
