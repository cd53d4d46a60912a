from __future__ import annotations

import datetime as dt
import json
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.plain import random_trades
from tickscope import schemas as S
from tickscope.functions.series import DetectorParams
from tickscope.operators import anchored, delivery, events
from tickscope.plans import queries
from tickscope.plans.queries import registry
from tickscope.sources.anomaly_table import AnomalyTable
from tickscope.sources.batch_table import BatchTable
from tickscope.sources.messages import next_offsets, read_messages, start_writing, stream_messages, write_messages
from tickscope.streaming import jobs
from tickscope.streaming.detector import TRADE, WAITING_NAME, WindowDetector, detect, freshness_from_state, model_state
from tickscope.streaming.ordered import MemoryStore, OrderedRows
from tickscope.streaming.progress import ProgressLog, backlog_samples, lag_samples

PARAMS = DetectorParams(window_seconds=4.0, z_threshold=1.5, warmup=10, lookback=12)


def trade_frame(spark, rows):
    frame = spark.createDataFrame(rows, "symbol STRING, arrival BIGINT, us BIGINT, price DOUBLE, size DOUBLE")
    return frame.withColumn("ts", F.timestamp_micros("us"))


def scored_rows(frame):
    names = ("realized_volatility", "score_mean", "score_std", "anomaly_score", "changepoint_probability")
    picked = frame.select(
        "symbol", "window_index", F.unix_micros("window_start").alias("s"), F.unix_micros("window_end").alias("e"),
        "trade_count", "volume", *[F.round(n, 8).alias(n) for n in names], "is_volume_anomaly",
        "is_regime_change",
    )
    return sorted(tuple(r) for r in picked.collect())


def run_stream(spark, source, out, checkpoint, **options):
    raw = spark.readStream.option("maxFilesPerTrigger", 1).schema(
        "symbol STRING, arrival BIGINT, us BIGINT, price DOUBLE, size DOUBLE, ts TIMESTAMP"
    ).parquet(source)
    query = (
        detect(raw, PARAMS, **options).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination(300)
    return query


def test_any_split_and_a_restart_give_the_batch_answer(spark, tmp_path):
    rows = random_trades(11, 1500)
    windows = anchored.window_summaries(trade_frame(spark, rows), PARAMS.window_seconds)
    batch = scored_rows(events.score_windows(windows, PARAMS.z_threshold, PARAMS.lookback, PARAMS.warmup))
    assert any(r[-2] for r in batch)

    rng = random.Random(4)
    cuts = sorted(rng.sample(range(1, len(rows)), 4))
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for i, part in enumerate(parts):
        shuffled = part[:]
        rng.shuffle(shuffled)
        trade_frame(spark, shuffled).coalesce(1).write.mode("append").parquet(source)
        if i in (2, len(parts) - 1):  # a stop and a restart in between
            run_stream(spark, source, out, checkpoint)
    assert scored_rows(spark.read.parquet(out)) == batch

    state = {r["symbol"]: r for r in model_state(spark, checkpoint).collect()}
    assert set(state) == {"A", "B", "C"}
    fresh = {r["symbol"]: r["at"] for r in freshness_from_state(spark, checkpoint).select(
        "symbol", F.unix_micros("last_updated").alias("at")).collect()}
    assert fresh == {s: max(r[3] for r in batch if r[0] == s) for s in "ABC"}


def test_rows_come_back_in_order_from_a_bounded_memory(tmp_path):
    import os
    import tracemalloc

    class Files:
        largest = 0

        def put(self, name, data):
            (tmp_path / name.replace("/", "_")).write_bytes(data)

        def take(self, name):
            path = tmp_path / name.replace("/", "_")
            data = path.read_bytes()
            os.unlink(path)
            return data

    def rows(values):
        out = np.zeros(len(values), TRADE)
        out["arrival"], out["size"] = values, np.asarray(values) * 2.0
        return out

    rng = np.random.default_rng(1)
    cases = {
        "spread": rng.permutation(1_000_000) * 977 - 5000, "one value": np.full(5000, 7), "few": np.arange(10)[::-1],
        "dense then far": np.concatenate([rng.permutation(20_000), 10 ** 12 + rng.permutation(20_000)]), "none": np.zeros(0, int),
    }
    for values in cases.values():
        ordered, want = OrderedRows(Files(), "arrival", limit=2000), np.sort(values)
        tracemalloc.start()
        for at in range(0, len(values), 700):
            ordered.add(rows(values[at:at + 700]))
        at = 0
        for part in ordered.in_order():
            assert len(part) <= 2000
            assert (part["arrival"] == want[at:at + len(part)]).all() and (part["size"] == part["arrival"] * 2.0).all()
            at += len(part)
        assert at == len(values) and not list(tmp_path.iterdir())
        assert tracemalloc.get_traced_memory()[1] < 16 << 20  # the rows alone are 32 MB
        tracemalloc.stop()


def test_a_symbol_beyond_the_memory_of_a_batch_and_a_run_from_saved_state(spark, tmp_path):
    rows = random_trades(12, 1400)
    windows = anchored.window_summaries(trade_frame(spark, rows), PARAMS.window_seconds)
    batch = scored_rows(events.score_windows(windows, PARAMS.z_threshold, PARAMS.lookback, PARAMS.warmup))
    found, state = [], None
    for i, part in enumerate((rows[:600], rows[600:])):
        random.Random(i).shuffle(part)
        source, out, checkpoint = (str(tmp_path / f"{n}{i}") for n in ("in", "out", "ck"))
        trade_frame(spark, part).coalesce(1).write.parquet(source)
        run_stream(spark, source, out, checkpoint, initial=state, rows_in_memory=50)
        found += scored_rows(spark.read.parquet(out))
        state = model_state(spark, checkpoint)
        waiting = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", WAITING_NAME).load()
        assert waiting.count() == 0
    assert sorted(found) == batch


def test_streamed_audit_equals_the_batch_audit_for_any_split(spark, tmp_path):
    rng = random.Random(6)
    shape = "trade_id BIGINT, ticker STRING, processed_at TIMESTAMP"
    log = [(rng.randrange(40), rng.choice("AB"), dt.datetime(2024, 1, 1, 0, rng.randrange(60))) for _ in range(300)]
    table = BatchTable(spark, str(tmp_path / "t"), jobs.AUDIT)
    for part in (log[:90], log[90:100], log[100:]):
        spark.createDataFrame(part, shape).repartition(2).write.mode("append").parquet(str(tmp_path / "log"))
        source = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
        jobs.start_delivery_audit(source, table, str(tmp_path / "ck"), available_now=True).awaitTermination(300)
    batch = delivery.delivery_audit(spark.createDataFrame(log, shape))
    want = sorted(tuple(r) for r in batch.select(*jobs.current_audit(table).columns).collect())
    assert sorted(tuple(r) for r in jobs.current_audit(table).collect()) == want
    again = batch.withColumn("attempts", F.lit(99).cast("bigint"))
    assert not table.deliver(again, "delivery-audit", 0)  # a redelivered batch
    table.fold(jobs.newest_audit)
    assert sorted(tuple(r) for r in jobs.current_audit(table).collect()) == want


def test_starting_from_offsets_and_files_of_bounded_length(spark, tmp_path):
    path = str(tmp_path / "topic")
    rows = raw_frame(spark, [b"{}"] * 100).withColumn("partition", (F.col("offset") % 2).cast("int"))
    write_messages(rows.coalesce(1), "parquet", path, rows_per_file=16)
    assert next_offsets(read_messages(spark, "parquet", path)) == {S.TICKS_TOPIC: {0: 99, 1: 100}}
    raw = stream_messages(spark, "parquet", path, starting={S.TICKS_TOPIC: {1: 90}}, per_trigger=1)
    sizes, seen = [], []

    def take(batch, number):
        offsets = [r["offset"] for r in batch.collect()]
        sizes.append(len(offsets))
        seen.extend(offsets)

    query = raw.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "ck"))
    query.trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(seen) == sorted([n for n in range(0, 100, 2)] + [n for n in range(91, 100, 2)])
    assert len(sizes) == 7 and max(sizes) <= 16


def test_progress_reports_are_kept_as_a_table(spark, spiky, tmp_path):
    reports = ProgressLog(spark, str(tmp_path / "reports"), at_once=1)
    spark.streams.addListener(reports)
    try:
        raw = stream_messages(spark, "parquet", spiky, per_trigger=1)
        writer = raw.writeStream.queryName("watched").format("noop").option("checkpointLocation", str(tmp_path / "ck"))
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination(120)
        reports.wait(query)
    finally:
        spark.streams.removeListener(reports)
    burst = spark.createDataFrame([("watched", 183, 0.5)], "run STRING, burst_size BIGINT, produce_seconds DOUBLE")
    samples = backlog_samples(reports.reports(), burst)
    assert [r["lag"] for r in samples.orderBy("elapsed").collect()][:2] == [92, 0]
    summary = delivery.drain_summary(samples, settle_seconds=0.0).first()
    assert summary["peak_lag"] == 92 and summary["recovery_seconds"] > 0 and summary["produce_rate"] == 366


def tick(symbol, seconds, price, size, number, **changes):
    body = {
        "type": "trade", "symbol": symbol, "price": price, "size": size, "exchange": "V",
        "timestamp": f"2024-01-01T{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}+00:00",
        "trade_id": number, "conditions": [], "tape": "C",
    }
    body.update(changes)
    return json.dumps({k: v for k, v in body.items() if v is not None}).encode()


def raw_frame(spark, values, first=0):
    rows = [(b"A", bytearray(v), S.TICKS_TOPIC, 0, first + i) for i, v in enumerate(values)]
    return spark.createDataFrame(
        rows, "key BINARY, value BINARY, topic STRING, partition INT, offset BIGINT"
    ).withColumn("timestamp", F.current_timestamp())


@pytest.fixture()
def spiky(spark, tmp_path):
    """A raw topic with one big spike, three bad messages and some quotes."""
    rng = random.Random(9)
    values = []
    for i in range(60):
        size = 90_000 if i == 50 else 100 + rng.randrange(20)
        values.append(tick("A", 11 * i, 100.0 + rng.random(), size, i))
        values.append(tick("A", 11 * i + 3, 100.0 + rng.random(), 10, 1000 + i))
        values.append(tick("A", 11 * i + 4, 100.0 + rng.random(), 10, 2000 + i))
    values[5:5] = [b"{not json", tick("A", 9, 1, 1, 1, type="bar"), tick("A", 9, None, 1, 1)]
    path = str(tmp_path / "topic")
    half = len(values) // 2
    raw_frame(spark, values[:half]).coalesce(1).write.parquet(path)
    raw_frame(spark, values[half:], half).coalesce(1).write.mode("append").parquet(path)
    return path


def test_bad_messages_go_aside_and_spikes_reach_the_table_once(spark, spiky, tmp_path):
    raw = stream_messages(spark, "parquet", spiky, per_trigger=1)
    dead = str(tmp_path / "dead")
    for _ in range(2):
        jobs.start_dead_letters(raw, "parquet", dead, str(tmp_path / "ck-dead"), True).awaitTermination(300)
    letters = spark.read.parquet(dead)
    assert letters.count() == 3 and {r["topic"] for r in letters.collect()} == {S.DLQ_TOPIC}

    table = AnomalyTable(spark, str(tmp_path / "table"))
    sent = str(tmp_path / "sent")

    def publish(messages, number):
        messages.write.mode("append").partitionBy("topic").parquet(sent)

    checkpoint = str(tmp_path / "ck-detect")
    for _ in range(2):
        query = jobs.start_detection(raw, table, checkpoint, publish=publish, available_now=True)
        query.awaitTermination(300)
    found = [r for r in table.read().collect() if r["anomaly_type"] == S.VOLUME_ANOMALY]
    assert len(found) == 1 and json.loads(found[0]["details"])["volume"] > 90_000
    topics = {r["topic"] for r in spark.read.parquet(sent).collect()}
    assert S.VOLUME_TOPIC in topics

    # The published events, read back through the table sink, give the same rows.
    events_topic = str(tmp_path / "events")
    spark.read.parquet(sent).select(
        "key", "value", "topic", F.lit(0).alias("partition"),
        F.monotonically_increasing_id().alias("offset"), F.current_timestamp().alias("timestamp"),
    ).write.parquet(events_topic)
    second = AnomalyTable(spark, str(tmp_path / "table2"))
    stream = stream_messages(spark, "parquet", events_topic, topics=None)
    jobs.start_table_sink(stream, second, str(tmp_path / "ck-sink"), available_now=True).awaitTermination(300)
    key = ("ticker", "window_start", "anomaly_type", "details")
    assert sorted(map(tuple, second.read().select(*key).collect())) == sorted(
        map(tuple, table.read().select(*key).collect()))


def test_replay_sends_each_dead_letter_once(spark, spiky, tmp_path):
    raw = stream_messages(spark, "parquet", spiky)
    dead = str(tmp_path / "dead")
    jobs.start_dead_letters(raw, "parquet", dead, str(tmp_path / "ck"), True).awaitTermination(300)
    stored = "key BINARY, value BINARY, topic STRING"
    back = str(tmp_path / "back")
    for _ in range(2):
        stream = spark.readStream.schema(stored).parquet(dead)
        jobs.start_replay(stream, "parquet", back, str(tmp_path / "ck-replay")).awaitTermination(300)
    again = spark.read.parquet(back).collect()
    assert len(again) == 3 and {r["topic"] for r in again} == {S.TICKS_TOPIC}
    assert b"{not json" in {bytes(r["value"]) for r in again}

    sent: list = []
    letters = spark.read.parquet(dead)
    counts = [
        jobs.replay_some(letters, str(tmp_path / "progress"), 2, lambda rows: sent.extend(rows.collect()))
        for _ in range(3)
    ]
    assert counts == [2, 1, 0] and len({r["location"] for r in sent}) == 3


def test_empty_topic_drains_at_once(spark, tmp_path):
    path = str(tmp_path / "empty")
    raw_frame(spark, [b"x"]).where("false").write.parquet(path)
    assert read_messages(spark, "parquet", path).count() == 0
    rows = stream_messages(spark, "parquet", path).select("topic", "key", "value")
    query = start_writing(rows, "parquet", str(tmp_path / "o"), str(tmp_path / "c"), available_now=True)
    assert query.awaitTermination(120)


def test_a_processing_error_stops_the_query_and_the_batch_comes_again(spark, spiky, tmp_path):
    raw = stream_messages(spark, "parquet", spiky)
    seen = []

    def process(batch, number):
        n = batch.count()
        if not seen:
            seen.append(("failed", n))
            raise ValueError("bug in processing")
        seen.append(("done", n))

    checkpoint = str(tmp_path / "ck")
    with pytest.raises(Exception, match="bug in processing"):
        jobs.start_each_tick_batch(raw, process, checkpoint, True).awaitTermination(120)
    query = jobs.start_each_tick_batch(raw, process, checkpoint, True)
    query.awaitTermination(120)
    assert seen == [("failed", 180), ("done", 180)]
    samples = lag_samples(spark, "r", query.recentProgress, 183, 1.0).collect()
    assert samples[-1]["lag"] == 0


def test_live_view_keeps_the_newest_json(spark, spiky, tmp_path):
    shown = []
    raw = stream_messages(spark, "parquet", spiky, per_trigger=1)
    jobs.start_live_view(
        raw, lambda feed: shown.append([bytes(r["value"]) for r in feed.collect()]),
        str(tmp_path / "ck"), length=5, available_now=True,
    ).awaitTermination(120)
    assert len(shown) == 2 and len(shown[-1]) == 5
    assert json.loads(shown[-1][0])["trade_id"] == 2059


def test_starting_latest_skips_what_is_there(spark, spiky, tmp_path):
    raw = stream_messages(spark, "parquet", spiky, starting="latest")
    raw_frame(spark, [b"{}"], 900).write.mode("append").parquet(spiky)
    seen = []
    jobs.start_live_view(
        raw, lambda feed: seen.extend(bytes(r["value"]) for r in feed.collect()), str(tmp_path / "ck"),
        available_now=True,
    ).awaitTermination(120)
    assert seen == [b"{}"]


class CountingStore(MemoryStore):
    puts = 0

    def put(self, name, data):
        assert name not in self
        self.puts += 1
        self[name] = data

    def take(self, name):
        return self.pop(name)


@pytest.mark.parametrize("order", ["in order", "backwards", "overlapping", "any", "one value"])
def test_waiting_pieces_are_as_long_as_memory_allows(order):
    n, limit, ways = 20_000, 100, 4
    rng = np.random.default_rng(2)
    values = {
        "in order": np.arange(n), "backwards": np.arange(n)[::-1], "overlapping": np.arange(n) + rng.integers(0, 50, n),
        "any": rng.permutation(n), "one value": np.full(n, 7),
    }[order]
    rows = np.zeros(n, TRADE)
    rows["arrival"], rows["size"] = values, np.arange(n)
    store = CountingStore()
    ordered = OrderedRows(store, "arrival", limit)
    for at in range(0, n, 1000):
        ordered.add(rows[at:at + 1000])
    parts = list(ordered.in_order())
    assert [len(part) for part in parts] == [limit] * (n // limit) and not store
    got = np.concatenate(parts)
    assert (got["arrival"] == np.sort(values)).all() and (values[got["size"].astype(int)] == got["arrival"]).all()
    pieces, passes = n // limit, {"overlapping": 1, "any": 5}.get(order, 0)
    assert store.puts <= pieces * (1 + ways * passes)


def test_few_rows_in_memory_need_no_frame_and_state_call_for_every_few_trades():
    class State(dict):
        calls = 0

        def updateValue(self, key, value):
            self.calls += 1
            self[key] = value

        def getValue(self, key):
            self.calls += 1
            return self[key]

        def removeKey(self, key):
            self.calls += 1
            del self[key]

        def exists(self):
            return False

        def update(self, value):
            self["saved"] = value

    class Handle:
        series, waiting = State(), State()

        def getValueState(self, name, schema):
            return self.series

        def getMapState(self, name, key, value):
            return self.waiting

    def run(rows_in_memory):
        detector, handle = WindowDetector(PARAMS, rows_in_memory), Handle()
        handle.series, handle.waiting = State(), State()
        detector.init(handle)
        frames = list(detector.handleInputRows(("A",), iter([trades[:4000], trades[4000:]]), None))
        return pd.concat(frames, ignore_index=True), frames, handle

    at = np.arange(10_000)
    trades = pd.DataFrame({"arrival": at, "ts_us": at * 700_000, "price": 50.0 + at % 13, "size": 1.0 + at * 7 % 11})
    want, _, whole = run(1 << 18)
    got, frames, handle = run(100)
    pd.testing.assert_frame_equal(got, want)
    assert len(got) > 1500 and list(map(len, frames)) == [len(got)]
    assert not handle.waiting and handle.waiting.calls == 3 * 100
    assert handle.series["saved"][:2] == whole.series["saved"][:2]


def test_resumed_scores_and_freshness_take_the_state_over_without_rows_beside_it(spark, tmp_path):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = [
        (i, start + dt.timedelta(seconds=200 * i + rng.randrange(400)), i % 7, "ab"[i % 2], 1.0 + rng.random(),
         json.dumps({"k": rng.randrange(1, 90)}))
        for i in range(2400)
    ]
    rng.shuffle(rows)
    spark.createDataFrame(rows, queries.EVENTS).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    scores, checkpoint = queries._resumed(spark, str(tmp_path))
    batches = [n for n in os.listdir(f"{checkpoint.removeprefix('file:')}/commits") if n.isdigit()]
    assert sorted(batches) == ["0", "1"]
    saved = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "series")
    handed = saved.option("batchId", 0).load().select("key.symbol", "value.window_index").collect()
    assert {r["symbol"] for r in handed} == {"a", "b"} and all(r["window_index"] > 100 for r in handed)
    wanted = registry()["volume_scores"](spark, str(tmp_path))
    got = registry()["resumed_window_scores"](spark, str(tmp_path)).select(*wanted.columns)
    assert wanted.count() > 300 and scores.count() == got.count()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, wanted.collect()), key=str)
    fresh = registry()["freshness_from_saved_state"](spark, str(tmp_path))
    assert sorted(map(tuple, fresh.collect())) == sorted(
        (s, max(r["end"] for r in scores.select("symbol", F.unix_micros("window_end").alias("end")).collect() if r["symbol"] == s))
        for s in "ab")
