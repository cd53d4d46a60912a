from __future__ import annotations

import base64
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tickscope import schemas as S
from tickscope.functions import text as X
from tickscope.operators import deadletter, normalise, validate, views

TRADE = {
    "type": "trade", "symbol": "ZQTR", "timestamp": "2024-03-07T11:47:20+00:00", "price": 48.25, "size": 730,
    "exchange": "K", "trade_id": 77031, "conditions": ["F", "T"], "tape": "B",
}
QUOTE = {
    "type": "quote", "symbol": "ZQTR", "timestamp": "2024-03-07T11:47:20+00:00", "bid_price": 48.0,
    "bid_size": 14, "bid_exchange": "J", "ask_price": 48.5, "ask_size": 9, "ask_exchange": "P",
    "conditions": ["H"], "tape": "B",
}


def without(body, *keys, **changes):
    return json.dumps({k: v for k, v in {**body, **changes}.items() if k not in keys}).encode()


BAD = [
    (b"\xff\xfe\x00\x01", "not valid utf-8"),
    (b"{not json", "not valid json"),
    (b"", "not valid json"),
    (without(TRADE) + b" x", "not valid json"),
    (without(TRADE) + b"]", "not valid json"),
    (without(TRADE) + b"}", "not valid json"),
    (without(TRADE) + b"," + without(TRADE), "not valid json"),
    (None, "not valid json: null value"),
    (b"[1, 2, 3]", "expected a JSON object, got list"),
    (b'"text"', "expected a JSON object, got str"),
    (b"12", "expected a JSON object, got int"),
    (b"1.5e3", "expected a JSON object, got float"),
    (b"true", "expected a JSON object, got bool"),
    (b"null", "expected a JSON object, got NoneType"),
    (without(TRADE, type="bar"), "unknown tick type: 'bar'"),
    (without(TRADE, "type"), "unknown tick type: None"),
    (without(TRADE, "price"), "missing required field(s): ['price']"),
    (without(TRADE, "tape", "price"), "missing required field(s): ['price', 'tape']"),
    (without(QUOTE, "bid_price"), "missing required field(s): ['bid_price']"),
    (without(TRADE, "timestamp"), "missing required field(s): ['timestamp']"),
    (without(TRADE, timestamp="not-a-timestamp"), "invalid timestamp: 'not-a-timestamp'"),
    (without(TRADE, timestamp="2024"), "invalid timestamp: '2024'"),
    (without(TRADE, timestamp="11:47:20"), "invalid timestamp: '11:47:20'"),
    (without(TRADE, timestamp="2024-02-31"), "invalid timestamp: '2024-02-31'"),
    (without(TRADE, timestamp=None), "invalid timestamp: None"),
    (without(TRADE, timestamp=5), "invalid timestamp: 5"),
    (without(TRADE, timestamp=20240307), "invalid timestamp: 20240307"),
    (without(TRADE, type=["trade"]), "unknown tick type: ['trade']"),
    (without(TRADE, type=True), "unknown tick type: True"),
]
GOOD = [
    (without(TRADE), 1709812040), (without(QUOTE), 1709812040), (without(TRADE, extra={"a": [1]}), 1709812040),
    (b"  " + without(TRADE) + b"\n", 1709812040), (without(TRADE, timestamp="2024-03-07"), 1709769600),
    (without(TRADE, timestamp="2024-03-07T06:47:20-05:00"), 1709812040),
    (without(TRADE, timestamp="2024-03-07 11:47:20.25"), 1709812040),
]


def raw(spark, values, key=b"ZQTR", topic=S.TICKS_TOPIC):
    rows = [
        (None if key is None else bytearray(key), None if v is None else bytearray(v), topic, 3, 42 + i)
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(
        rows, "key BINARY, value BINARY, topic STRING, partition INT, offset BIGINT"
    ).withColumn("timestamp", F.current_timestamp())


def test_every_failure_has_its_message(spark):
    checked = validate.validate_ticks(raw(spark, [v for v, _ in BAD])).orderBy("offset").collect()
    for row, (value, message) in zip(checked, BAD):
        assert row["error"] is not None and row["error"].startswith(message), (value, row["error"])
    assert validate.valid_ticks(validate.validate_ticks(raw(spark, [v for v, _ in BAD]))).count() == 0


def test_good_ticks_pass_and_keep_their_raw_value(spark):
    checked = validate.validate_ticks(raw(spark, [v for v, _ in GOOD]))
    rows = checked.withColumn("s", F.floor(F.unix_micros("ts") / 1_000_000)).orderBy("offset").collect()
    assert [(r["error"], r["s"]) for r in rows] == [(None, s) for _, s in GOOD]
    assert bytes(rows[2]["value"]) == GOOD[2][0]
    assert validate.rejected(checked).count() == 0


def test_only_trades_go_on_and_unusable_ones_stop_the_job(spark):
    ticks = validate.valid_ticks(validate.validate_ticks(raw(spark, [without(TRADE), without(QUOTE)])))
    assert [r["price"] for r in validate.trades(ticks).collect()] == [48.25]
    for broken in (without(TRADE, price="abc"), without(TRADE, size=None)):
        ticks = validate.valid_ticks(validate.validate_ticks(raw(spark, [broken])))
        with pytest.raises(Exception, match="trade without a usable"):
            validate.trades(ticks).collect()


def test_filter_on_error_does_not_repeat_the_parsing(spark):
    plan = validate.rejected(validate.validate_ticks(raw(spark, [b"x"])))._jdf.queryExecution().optimizedPlan()
    text = plan.toString()
    assert text.index("Filter") < text.index("Generate")
    assert text.count("from_json") == 1


def test_envelope_round_trip(spark):
    long_value = b'{"bad": "json"' + b" " * 300
    bad = raw(spark, [long_value]).withColumn("error", F.lit("not valid json"))
    stored = deadletter.envelope_messages(deadletter.envelopes(bad, error_class="ValueError"))
    message = stored.collect()[0]
    body = json.loads(bytes(message["value"]))
    assert message["topic"] == S.DLQ_TOPIC and bytes(message["key"]) == b"ZQTR"
    assert body["original_topic"] == S.TICKS_TOPIC and body["original_partition"] == 3
    assert body["original_offset"] == 42 and body["original_key"] == "ZQTR"
    assert body["error"] == "ValueError: not valid json" and body["failed_at"].endswith("+00:00")
    assert base64.b64decode(body["raw_value_b64"], validate=True) == long_value

    back = deadletter.replay_messages(deadletter.parse_envelopes(stored)).collect()[0]
    assert (back["topic"], bytes(back["key"]), bytes(back["value"])) == (S.TICKS_TOPIC, b"ZQTR", long_value)
    shown = deadletter.inspect(deadletter.parse_envelopes(stored)).collect()
    assert shown[0]["location"] == "market-ticks[3]@42"


@pytest.mark.parametrize("key,want", [(None, None), (b"", None), (b"\xffA", "�A")])
def test_envelope_keys(spark, key, want):
    bad = raw(spark, [None], key).withColumn("error", F.lit("x"))
    row = deadletter.envelopes(bad).collect()[0]
    assert row["original_key"] == want and row["raw_value_b64"] == ""


def test_inspect_shows_the_first_twenty(spark):
    bad = raw(spark, [b"x"] * 30).withColumn("error", F.lit("x"))
    shown = deadletter.inspect(deadletter.envelopes(bad)).collect()
    assert [r["location"] for r in shown] == [f"market-ticks[3]@{n}" for n in range(42, 62)]
    assert deadletter.inspect(deadletter.envelopes(bad.where("false"))).collect() == []


def test_ticks_to_messages_and_back(spark):
    ticks = validate.valid_ticks(validate.validate_ticks(raw(spark, [without(TRADE), without(QUOTE)])))
    sent = normalise.tick_messages(ticks).collect()
    assert [json.loads(bytes(r["value"])) for r in sent] == [TRADE, QUOTE]
    assert {(r["topic"], bytes(r["key"])) for r in sent} == {(S.TICKS_TOPIC, b"ZQTR")}
    local = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-07 06:47:20' AS t").select(
        normalise.to_utc(F.col("t"), "America/New_York").cast("string").alias("t"))
    assert local.first()["t"] == "2024-03-07 11:47:20"


VOLUME = {
    "symbol": "ZQTR", "window_start": "2024-03-07T11:47:20+00:00", "window_end": "2024-03-07T11:47:30+00:00",
    "volume": 812.5, "trade_count": 19, "anomaly_score": 6.25, "score_mean": 312.5, "score_std": 80.0,
}
REGIME = {
    "symbol": "ZQTR", "window_start": "2024-03-07T11:47:20+00:00", "window_end": "2024-03-07T11:47:30+00:00",
    "realized_volatility": 0.045, "changepoint_probability": 0.64,
}


def test_anomaly_events_parse_by_topic(spark):
    both = raw(spark, [without(VOLUME)], topic=S.VOLUME_TOPIC).union(raw(spark, [without(REGIME)], topic=S.REGIME_TOPIC))
    rows = validate.validate_anomaly_events(both).collect()
    assert [(r["symbol"], r["anomaly_type"], json.loads(r["details"])) for r in rows] == [
        ("ZQTR", "volume_anomaly", VOLUME), ("ZQTR", "regime_change", REGIME)]


@pytest.mark.parametrize("value,topic,message", [
    (b"{not json", S.VOLUME_TOPIC, "not valid utf-8/json"),
    (b"\xff", S.VOLUME_TOPIC, "not valid utf-8/json"),
    (None, S.VOLUME_TOPIC, "not valid utf-8/json"),
    (b"[1]", S.VOLUME_TOPIC, "expected a JSON object, got list"),
    (without(VOLUME), "another-topic", "unknown anomaly type"),
    (without(VOLUME, "volume"), S.VOLUME_TOPIC, "missing required field"),
    (without(VOLUME), S.REGIME_TOPIC, "changepoint_probability"),
    (without(VOLUME, window_start="soon"), S.VOLUME_TOPIC, "invalid window_start: 'soon'"),
])
def test_a_bad_anomaly_event_stops_the_job(spark, value, topic, message):
    with pytest.raises(Exception) as caught:
        validate.validate_anomaly_events(raw(spark, [value], topic=topic)).select("symbol").collect()
    assert message in str(caught.value)


def test_provider_records_become_ticks(spark):
    shape = ("kind STRING, symbol STRING, at TIMESTAMP_NTZ, price DOUBLE, size DOUBLE, venue STRING, id BIGINT, bid DOUBLE, bid_size DOUBLE, "
             "bid_venue STRING, ask DOUBLE, ask_size DOUBLE, ask_venue STRING, flags ARRAY<STRING>, tape STRING")
    at = dt.datetime(2024, 3, 7, 6, 47, 20)
    rows = spark.createDataFrame([
        ("trade", "ZQTR", at, 48.25, 730.0, "K", 77031, None, None, None, None, None, None, ["F", "T"], "B"),
        ("quote", "ZQTR", at, None, None, None, None, 48.0, 14.0, "J", 48.5, 9.0, "P", ["H"], "B"),
        ("bar", "ZQTR", at, 1.0, 1.0, None, None, None, None, None, None, None, None, None, None)], shape)
    sent = normalise.tick_messages(normalise.provider_ticks(rows, "America/New_York")).collect()
    assert [json.loads(bytes(r["value"])) for r in sent] == [TRADE, QUOTE]


def test_feed_and_texts(spark):
    values = [without(TRADE, trade_id=i) for i in range(60)] + [b"{broken", b"\xff"]
    messages = raw(spark, values).withColumn("arrival", F.col("offset"))
    feed = views.latest_messages(messages).collect()
    assert len(feed) == 50 and json.loads(feed[0]["payload"])["trade_id"] == 59
    assert views.latest_messages(messages.where("false"), 50).collect() == []
    for_viewers = messages.withColumn("viewer", F.concat(F.lit("v"), F.col("arrival") % 3))
    marks = spark.createDataFrame([("v0", 50), ("v1", None), ("v9", 1)], "viewer STRING, seen BIGINT")
    left = {tuple(r) for r in views.waiting_messages(for_viewers, marks).select("viewer", "arrival").collect()}
    arrivals = [r["arrival"] for r in messages.collect()]
    assert left == {(f"v{a % 3}", a) for a in arrivals if a % 3 == 1 or (a % 3 == 0 and a > 50)}
    ticks = validate.valid_ticks(validate.validate_ticks(raw(spark, [without(TRADE), without(QUOTE)])))
    assert [r["detail"] for r in views.tick_text(ticks).collect()] == ["$48.25 × 730", "bid $48.00 / ask $48.50"]


def test_sizes_are_shown_without_exponent(spark):
    shape = "type STRING, price DOUBLE, size DOUBLE, bid_price DOUBLE, ask_price DOUBLE"
    ticks = spark.createDataFrame([("trade", 1.0, n, None, None) for n in (12345678.0, 0.0005, 100.0, 0.0)], shape)
    assert [r["detail"] for r in views.tick_text(ticks).collect()] == [
        "$1.00 × 12345678", "$1.00 × 0.0005", "$1.00 × 100", "$1.00 × 0"]


@pytest.mark.parametrize("price, size", [(float("nan"), 1.0), (1.0, float("inf")), (1.0, None)])
def test_numbers_that_are_none_stop_the_job(spark, price, size):
    ticks = spark.createDataFrame([("trade", "S", price, size)], "type STRING, symbol STRING, price DOUBLE, size DOUBLE")
    with pytest.raises(Exception, match="without a usable"):
        validate.trades(ticks).collect()


TIMES = (
    "20240307", "2024-W01-1", "2024W011", "2024-W10", "2020-W53-7", "2021-W53-1", "2024-W00-1", "2024-W10-0",
    "2024-W10-8", "0000-01-01", "0001-01-01", "2024-02-30", "20240230", "2024-03-07t15:30", "2024-03-07_15:30:01",
    "2024-03-07T153001", "2024-03-07T15", "2024-03-07T24:00", "2024-03-07T15:60", "20240307T153001.25+0530",
    "2024-03-07T15:30:01.123456789012", "2024-03-07T15:30:01,5Z", "2024-03-07T15:30+19:00", "2024-03-07T15:30-23:59:59",
    "2024-03-07T15:30+24:00", "2024-03-07T15:3", "2024-3-7", "soon", "", "2024-03-07T", "2024-03-07T15:30:01.",
)


def test_timestamps_are_read_like_the_standard_library_does(spark):
    from datetime import UTC, datetime, timedelta

    def want(text):
        try:
            at = datetime.fromisoformat(text)
        except ValueError:
            return None
        return ((at if at.tzinfo else at.replace(tzinfo=UTC)) - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)

    rows = spark.createDataFrame([(t,) for t in TIMES], "t STRING")
    got = {r["t"]: r["us"] for r in rows.select("t", F.unix_micros(X.iso_timestamp(F.col("t"))).alias("us")).collect()}
    assert got == {t: want(t) for t in TIMES}


def test_fields_of_another_type_are_published_as_they_came(spark):
    odd = without(TRADE, trade_id="abc-1", conditions="x")
    ticks = validate.valid_ticks(validate.validate_ticks(raw(spark, [odd])))
    assert [bytes(r["value"]) for r in normalise.tick_messages(ticks, raw="value").collect()] == [odd]


def test_the_last_of_equal_keys_counts(spark):
    twice = without(TRADE).replace(b'"price": 48.25', b'"price": 1.0, "price": 48.25')
    row = validate.validate_ticks(raw(spark, [twice])).first()
    assert (row["error"], row["price"]) == (None, 48.25)
