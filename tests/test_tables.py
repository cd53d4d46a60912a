from __future__ import annotations

import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickscope import schemas as S
from tickscope.operators import crossref, delivery, factors, offsets, universe, upsert, views
from tickscope.sources.anomaly_table import AnomalyTable
from tickscope.sources.batch_table import BatchTable

ROW = "ticker STRING, window_start TIMESTAMP, anomaly_type STRING, details STRING, detected_at TIMESTAMP, arrival BIGINT"


def at(minute):
    return dt.datetime(2024, 1, 2, 15, minute)


def deliveries(spark, rows):
    return spark.createDataFrame(rows, ROW)


TWO = [
    ("A", at(0), S.VOLUME_ANOMALY, "v1", at(10), 1),
    ("A", at(0), S.REGIME_CHANGE, "r1", at(11), 2),
]
NEWER = [
    ("A", at(0), S.VOLUME_ANOMALY, "v3", at(20), 4),
    ("A", at(0), S.VOLUME_ANOMALY, "v2", at(19), 3),
    ("B", at(5), S.VOLUME_ANOMALY, "b1", at(21), 5),
]
MERGED = [
    ("A", S.REGIME_CHANGE, "r1", at(11)), ("A", S.VOLUME_ANOMALY, "v3", at(10)), ("B", S.VOLUME_ANOMALY, "b1", at(21)),
]


def content(frame):
    return sorted(tuple(r) for r in frame.select("ticker", "anomaly_type", "details", "detected_at").collect())


def test_merge_keeps_first_detection_and_newest_details(spark):
    empty = spark.createDataFrame([], S.ANOMALY)
    once = upsert.merge(empty, deliveries(spark, TWO))
    twice = upsert.merge(once, deliveries(spark, TWO))
    assert content(once) == content(twice) and once.count() == 2
    assert content(upsert.merge(twice, deliveries(spark, NEWER))) == MERGED
    with pytest.raises(Exception, match="anomaly_type not allowed"):
        upsert.merge(empty, deliveries(spark, [("A", at(0), "other", "x", at(1), 1)])).collect()


def test_table_deliveries_retries_and_compaction(spark, tmp_path):
    table = AnomalyTable(spark, str(tmp_path / "anomalies"))
    assert table.read().count() == 0 and table.compact() == 0
    clock = lambda m: F.lit(at(m))
    assert table.upsert(deliveries(spark, TWO), "w", 0, clock(30))
    assert not table.upsert(deliveries(spark, NEWER), "w", 0, clock(31))  # batch 0 again: ignored
    assert table.read().count() == 2
    assert table.upsert(deliveries(spark, NEWER), "w", 1, clock(32))
    assert content(table.read()) == MERGED
    base = table.compact()
    assert content(table.read()) == MERGED and table.compact() == base
    assert table.upsert(deliveries(spark, TWO), "other", 0, clock(33))
    assert content(table.read()) == [
        ("A", S.REGIME_CHANGE, "r1", at(11)), ("A", S.VOLUME_ANOMALY, "v1", at(10)), MERGED[2]]
    assert table.compact() != base
    assert table.batches.deliveries().count() == 3
    with pytest.raises(Exception, match="anomaly_type not allowed"):
        table.upsert(deliveries(spark, [("A", at(0), "other", "x", at(1), 1)]), "w", 9)


def test_folded_batches_are_neither_read_nor_listed(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "t"), "k BIGINT, v BIGINT")
    rows = spark.range(3).selectExpr("id AS k", "id * 10 AS v").coalesce(1)

    def newest(frame):
        return frame.groupBy("k").agg(F.max_by(F.struct("v", "writer", "batch"), "batch").alias("x")).select("k", "x.*")

    files = []
    for batch in range(12):
        assert table.deliver(rows.withColumn("v", F.col("v") + batch), "w", batch)
        assert not table.deliver(rows, "w", batch)
        if batch % 3 == 2:
            table.fold(newest)
            files.append(len(table.deliveries().inputFiles()))
            assert not table.deliver(rows, "w", batch - 2)  # folded: still known
    assert files[-1] == files[1] <= 8
    assert {tuple(r)[:2] for r in newest(table.deliveries()).collect()} == {(k, 10 * k + 11) for k in range(3)}
    # A writer that began before a fold and ends after it is not lost.
    late = BatchTable(spark, table.path, table.schema)
    late._generation = lambda: (table._generation()[0] - 1, {})
    assert late.deliver(rows.withColumn("k", F.col("k") + 100), "slow", 0)
    assert table.deliveries().where("k >= 100").count() == 3
    table.fold(newest)
    assert table.deliveries().where("k >= 100").count() == 3


def test_lists(spark):
    rows = [("T%02d" % (i % 7), at(i % 60), S.ANOMALY_TYPES[i % 2], "{}", at(i % 60), i) for i in range(80)]
    frame = deliveries(spark, rows)
    newest = views.newest_anomalies(frame).collect()
    assert len(newest) == 50 and newest[0]["detected_at"] == at(59)
    one = views.newest_anomalies(frame, "T01", S.REGIME_CHANGE, 3).collect()
    assert len(one) == 3 and {(r["ticker"], r["anomaly_type"]) for r in one} == {("T01", S.REGIME_CHANGE)}
    assert views.newest_anomalies(frame.where("false")).collect() == []
    quote = views.newest_anomalies(frame, "x' OR '1'='1").collect()
    assert quote == []
    assert "TakeOrderedAndProject" in views.newest_anomalies(frame)._jdf.queryExecution().executedPlan().toString()
    labels = {r["label"] for r in views.with_labels(frame).collect()}
    assert labels == {"Volume Spike", "Regime Change"}


def test_filters_on_the_key_reach_the_files(spark, tmp_path):
    table = AnomalyTable(spark, str(tmp_path / "t"))
    table.upsert(deliveries(spark, TWO), "w", 0)
    plan = views.newest_anomalies(table.read(), "A", S.VOLUME_ANOMALY)._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan"):]
    assert "EqualTo(ticker,A), EqualTo(anomaly_type," in scan


def marks(spark, rows):
    return spark.createDataFrame(rows, "topic STRING, partition INT, low BIGINT, high BIGINT")


def test_lag_and_sizes(spark):
    water = marks(spark, [("t", 0, 0, 15), ("t", 1, 0, 25), ("n", 0, 5, 20), ("d", 0, 0, 30), ("q", 0, 0, 3),
                          ("q", 1, 5, 5), ("q", 2, 0, 2)])
    done = spark.createDataFrame(
        [("g", "t", 0, 10), ("g", "t", 1, 20), ("full", "d", 0, 30), ("past", "d", 0, 99)],
        "group_id STRING, topic STRING, partition INT, offset BIGINT")
    subs = spark.createDataFrame(
        [("g", "t"), ("new", "n"), ("full", "d"), ("past", "d"), ("none", "missing"), ("two", "t"), ("two", "n")],
        "group_id STRING, topic STRING")
    lag = {r["group_id"]: r["lag"] for r in offsets.consumer_lag(water, done, subs).collect()}
    assert lag == {"g": 10, "new": 15, "full": 0, "past": 0, "none": 0, "two": 55}
    asked = spark.createDataFrame([("q",), ("missing",)], "topic STRING")
    sizes = {r["topic"]: r["messages"] for r in offsets.topic_sizes(water, asked).collect()}
    assert sizes == {"q": 5, "missing": 0}

    fresh = spark.createDataFrame([("A", at(1)), ("B", None)], "symbol STRING, last_updated TIMESTAMP")
    report = views.status_report(offsets.consumer_lag(water, done, subs), offsets.topic_sizes(water, asked),
                                 fresh, "g", "absent")
    rows = {tuple(r)[:2]: tuple(r)[2:] for r in report.collect()}
    assert rows.pop(("checked_at", "status"))[1].endswith("+00:00")
    assert rows == {
        ("consumer_lag", "streaming"): (10, None), ("consumer_lag", "storage_sink"): (0, None),
        ("dlq_depth", "dead_letters"): (5, None),
        ("model_freshness", "A"): (None, "2024-01-02T15:01:00+00:00"), ("model_freshness", "B"): (None, None)}
    assert "NestedLoop" not in report._jdf.queryExecution().executedPlan().toString()


def day(n):
    return dt.date(2024, 1, n)


def test_cross_reference_cases(spark):
    anomalies = crossref.with_date(spark.createDataFrame(
        [("AAPL", dt.datetime(2024, 1, 10, 23, 59), "regime_change"), ("COP", at(0), "volume_anomaly")],
        "ticker STRING, window_start TIMESTAMP, anomaly_type STRING"))
    shape = "date DATE, ticker STRING, factor STRING, z DOUBLE"
    moves = spark.createDataFrame([
        (day(11), "AAPL", "momentum", 3.0), (day(9), "AAPL", "momentum", -2.5), (day(10), "AAPL", "volatility", 2.0),
        (day(20), "AAPL", "momentum", 9.0), (day(10), "MSFT", "momentum", 9.0), (day(10), "AAPL", "momentum", 1.0),
    ], shape)
    sharp = factors.sharp_moves(moves)
    assert sharp.count() == 5
    rows = {r["ticker"]: r for r in crossref.cross_reference(anomalies, sharp).collect()}
    assert [tuple(m) for m in rows["AAPL"]["matches"]] == [
        ("momentum", day(9), -2.5), ("momentum", day(11), 3.0), ("volatility", day(10), 2.0)]
    assert rows["AAPL"]["anomaly_date"] == day(10) and rows["AAPL"]["coincides_with_sharp_factor_move"]
    assert rows["COP"]["matches"] == [] and not rows["COP"]["coincides_with_sharp_factor_move"]
    none = crossref.cross_reference(anomalies, sharp.where("false"))
    assert none.count() == 2 and crossref.match_summary(none).first()[:] == (0, 2)
    assert crossref.match_summary(none.where("false")).first()[:] == (0, 0)


def panel(spark, n, jump=None, seed=3):
    rng, price, rows = random.Random(seed), 100.0, []
    for i, date in enumerate(pd.bdate_range("2023-01-02", periods=n)):
        price *= 1 + (0.25 if i == jump else rng.gauss(0, 0.01))
        rows.append((date.date(), "AAPL", price))
    return spark.createDataFrame(rows, "date DATE, ticker STRING, close DOUBLE")


def test_factor_bounds(spark):
    def z(frame):
        return factors.factor_move_z(factors.factor_scores(frame))

    assert factors.sharp_moves(z(panel(spark, 300, 250))).count() > 0
    assert factors.sharp_moves(z(panel(spark, 300)), 3.0).count() < 10
    assert z(panel(spark, 15)).count() == 0
    nothing = factors.factor_move_z(factors.factor_scores(panel(spark, 15), factors={}))
    assert nothing.columns == ["date", "ticker", "factor", "z"] and nothing.count() == 0


def test_moves_of_a_sparse_panel_match_a_filled_grid(spark):
    rng, rows = random.Random(12), []
    for i, date in enumerate(pd.date_range("2023-01-01", periods=260)):
        for ticker in "ABC":
            if rng.random() < {"A": 0.9, "B": 0.7, "C": 1.0}[ticker] and i % 50:
                rows.append((date.date(), ticker, 7.0 if ticker == "C" and i > 100 else rng.gauss(0, 1)))
    scores = spark.createDataFrame(rows, "date DATE, ticker STRING, score DOUBLE")
    extra = {"mine": lambda prices: scores}
    long = factors.factor_scores(scores.withColumn("close", F.lit(1.0)), factors={}, extra=extra)
    got = {(r["date"], r["ticker"]): r["z"] for r in factors.factor_move_z(long).collect()}

    wide = pd.DataFrame(rows, columns=["date", "ticker", "score"]).pivot(index="date", columns="ticker", values="score")
    want = {}
    for ticker in "ABC":
        moves = [b - a for a, b in zip(wide[ticker], wide[ticker][1:])]
        moves = [math.nan, *moves]
        for i, move in enumerate(moves):
            seen = [m for m in moves[max(0, i - 59): i + 1] if not math.isnan(m)]
            if math.isnan(move) or len(seen) < 20:
                continue
            mean = sum(seen) / len(seen)
            sd = math.sqrt(sum((m - mean) ** 2 for m in seen) / (len(seen) - 1))
            if sd > 0:
                want[wide.index[i], ticker] = (move - mean) / sd
    assert got.keys() == want.keys() and len(want) > 200
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_universe(spark):
    names = spark.createDataFrame([(i + 1, f"S{i}") for i in range(5)], "rank INT, symbol STRING")
    ticks = spark.createDataFrame([(f"S{i % 5}", i) for i in range(20)], "symbol STRING, arrival BIGINT")
    assert universe.in_universe(ticks, universe.cap_universe(names, 2)).count() == 8
    assert universe.in_universe(ticks, universe.cap_universe(names)).count() == 20
    plan = universe.in_universe(ticks, names)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    odd = spark.createDataFrame([("S1",), ("ZZ",)], "ticker STRING")
    assert sorted(r[0] for r in universe.ticker_union(names, odd).collect()) == ["S0", "S1", "S2", "S3", "S4", "ZZ"]


def test_price_dates_reach_the_scan(spark, tmp_path):
    assert universe.price_range(dt.date(2026, 8, 3)) == ("2025-06-30", "2026-08-04")
    panel(spark, 30).write.parquet(str(tmp_path / "p"))
    bars = spark.read.parquet(str(tmp_path / "p"))
    some = universe.prices_between(bars, spark.createDataFrame([("AAPL",)], "ticker STRING"), "2023-01-10", "2023-01-12")
    assert sorted(r["date"] for r in some.collect()) == [dt.date(2023, 1, 10), dt.date(2023, 1, 11)]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date,2023-01-10)" in plan and "LessThan(date,2023-01-12)" in plan


def test_delivery_audit(spark):
    log = [(i, "K", at(0)) for i in range(300)] + [(150, "K", at(5))]
    frame = spark.createDataFrame(log, "trade_id BIGINT, ticker STRING, processed_at TIMESTAMP")
    expected = spark.createDataFrame([(300,)], "n_expected BIGINT")
    audit = delivery.delivery_audit(frame)
    assert delivery.integrity_summary(audit, expected).first()[:] == (300, 300, 2, True, True, True)
    early = delivery.delivery_audit(frame.where("trade_id <= 150 AND processed_at < '2024-01-02 15:05:00'"))
    assert delivery.integrity_summary(early, expected).first()[:] == (151, 151, 1, False, True, False)
    twice = audit.where("trade_id = 150").select("attempts", "first_processed_at", "last_processed_at").first()
    assert twice[:] == (2, at(0), at(5))
    nothing = delivery.integrity_summary(audit.where("false"), expected).first()
    assert nothing[:] == (0, 0, 0, False, True, False)


def test_drain_summary(spark):
    def run(name, *samples):
        return [(name, float(e), lag, 8000, 0.5) for e, lag in samples]

    rows = (
        run("drained", (1, 0), (2, 7948), (30, 4000), (61.4, 0), (62, 0))
        + run("stuck", (1, 100), (120, 50)) + run("short", (1, 10), (1.5, 0))
    )
    frame = spark.createDataFrame(rows, "run STRING, elapsed DOUBLE, lag BIGINT, burst_size BIGINT, produce_seconds DOUBLE")
    got = {r["run"]: (r["peak_lag"], r["recovery_seconds"], r["produce_rate"]) for r in delivery.drain_summary(frame).collect()}
    assert got == {"drained": (7948, 61.4, 16000.0), "stuck": (100, None, 16000.0), "short": (10, 1.5, 16000.0)}


def test_latest_tick_and_freshness(spark):
    ticks = spark.createDataFrame([("A", 1, 5.0), ("A", 3, 7.0), ("B", 2, 1.0)], "symbol STRING, arrival BIGINT, price DOUBLE")
    assert sorted(map(tuple, views.latest_per_symbol(ticks).collect())) == [("A", 3, 7.0), ("B", 2, 1.0)]
    plan = views.latest_per_symbol(ticks)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    windows = spark.createDataFrame([("A", at(1)), ("A", at(4))], "symbol STRING, window_end TIMESTAMP")
    assert views.model_freshness(windows).first()[:] == ("A", at(4))


def test_drain_peak_ends_with_the_drain(spark):
    rows = [("r", 1.0, 10, 10, 1.0), ("r", 3.0, 0, 10, 1.0), ("r", 4.0, 900, 10, 1.0), ("z", 1.0, 5, 5, 0.0)]
    frame = spark.createDataFrame(rows, "run STRING, elapsed DOUBLE, lag BIGINT, burst_size BIGINT, produce_seconds DOUBLE")
    got = {r["run"]: (r["peak_lag"], r["produce_rate"]) for r in delivery.drain_summary(frame).collect()}
    assert got == {"r": (10, 10.0), "z": (5, None)}
