from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.plain import BASE_US, changepoint_odds, volume_scores
from tickscope.functions.bocpd import RegimeDetector, RegimeParams
from tickscope.operators import evaluate, events, regime, volume

STEP = 10_000_000


def summaries(spark, series):
    """series: {symbol: [(volume, volatility), ...]}, one window every 10 s."""
    rows = [
        (s, i, BASE_US + i * STEP, float(v), vol)
        for s, values in series.items() for i, (v, vol) in enumerate(values)
    ]
    made = spark.createDataFrame(
        rows, "symbol STRING, window_index BIGINT, us BIGINT, volume DOUBLE, realized_volatility DOUBLE"
    )
    return made.select(
        "symbol", "window_index", F.timestamp_micros("us").alias("window_start"),
        F.timestamp_micros(F.col("us") + STEP).alias("window_end"), F.lit(5).cast("bigint").alias("trade_count"),
        "volume", "realized_volatility",
    )


def flagged(frame, flag):
    out = {}
    for r in frame.where(flag).select("symbol", "window_index").collect():
        out.setdefault(r["symbol"], []).append(r["window_index"])
    return out


@pytest.fixture(scope="module")
def benchmark_series():
    series = {}
    for seed in range(20):
        random.seed(seed)
        series[f"spike{seed}"] = [(100_000.0 if i == 600 else random.gauss(1000, 100), 0.01) for i in range(700)]
        random.seed(seed)
        series[f"lift{seed}"] = [
            (random.gauss(8000, 800) if 600 <= i < 630 else random.gauss(1000, 100), 0.01) for i in range(800)
        ]
    random.seed(1)
    series["quiet"] = [(random.gauss(1000, 100), 0.01) for _ in range(500)]
    return series


def test_volume_benchmarks(spark, benchmark_series):
    hits = flagged(volume.score_volume(summaries(spark, benchmark_series)), "is_volume_anomaly")
    for seed in range(20):
        assert any(abs(i - 600) <= 3 for i in hits[f"spike{seed}"])
        assert any(597 <= i <= 633 for i in hits[f"lift{seed}"])
    assert len(hits.get("quiet", [])) < 5


@pytest.mark.parametrize("chunk", [40, 97, 8192])
def test_volume_scores_do_not_depend_on_chunks(spark, chunk):
    rng = random.Random(2)
    series = {
        "A": [(rng.choice([5.0, 7.0, 90.0, 100.0 * rng.random()]), None) for _ in range(400)],
        "flat": [(0.1, None)] * 50 + [(9.0, None)] * 2,
        "short": [(1.0, None)] * 7,
    }
    scored = volume.score_volume(summaries(spark, series), 2.0, 30, 30, chunk)
    assert scored.count() == 459
    got = {(r["symbol"], r["window_index"]): r for r in scored.collect()}
    for s, values in series.items():
        for i, (z, flag) in enumerate(volume_scores([v for v, _ in values], 2.0)):
            row = got[s, i]
            if s == "flat" and 30 <= i <= 50:
                assert row["anomaly_score"] is None  # no spread, no score
                continue
            assert row["is_volume_anomaly"] == flag
            assert (row["anomaly_score"] is None) == (z is None)
            if z is not None:
                assert row["anomaly_score"] == pytest.approx(z, abs=1e-9)


def test_window_numbers_from_start_times(spark):
    frame = summaries(spark, {"A": [(1.0, None)] * 30, "B": [(1.0, None)] * 3})
    spaced = frame.withColumn("window_start", F.timestamp_seconds(F.col("window_index") * 40_000))
    again = volume.with_window_index(spaced.withColumnRenamed("window_index", "want"))
    assert again.where("want <> window_index").count() == 0 and again.count() == 33


def gauss(seed, *pieces):
    random.seed(seed)
    return [random.gauss(mu, sd) for n, mu, sd in pieces for _ in range(n)]


def flags(xs, **params):
    detector = RegimeDetector(RegimeParams(**params))
    return [i for i, x in enumerate(xs) if detector.update(x)], detector


def test_changepoints_of_known_series():
    assert flags(gauss(42, (150, 0, 1), (150, 0, 5)), hazard_lambda=250)[0] == [150]
    assert 150 in flags(gauss(1, (150, 0, 1), (150, 20, 1)), hazard_lambda=250)[0]
    assert flags(gauss(7, (300, 0, 1)), hazard_lambda=250)[0] == []
    assert len(flags(gauss(3, (2000, 0, 1)), hazard_lambda=250)[1].run) < 200


def test_shortest_run_always_has_the_hazard():
    detector = RegimeDetector(RegimeParams(hazard_lambda=100))
    for x in (0.0, 1.0, -50.0, 200.0, -300.0):
        detector.update(x)
        assert math.exp(detector.now[0][0]) == pytest.approx(0.01)


def test_one_update_of_the_posterior():
    detector = RegimeDetector()
    detector.update(4.0)
    run, mean, beta = detector.run[1], detector.now[1][1], math.exp(detector.now[2][1])
    assert (run, mean) == (1, 2.0)  # kappa 2, alpha 1.5
    assert beta == pytest.approx(1 + 16 / 4)


def test_against_the_unpruned_textbook_form():
    xs = gauss(8, (60, 0, 1), (60, 3, 2))
    detector = RegimeDetector(RegimeParams(prune_below=1e-300))
    got = [(detector.update(x), detector.probability)[1] for x in xs]
    assert got == pytest.approx(changepoint_odds(xs), abs=1e-9)


def test_pruning_hardly_moves_the_odds():
    xs = gauss(8, (80, 0, 1), (80, 3, 2))
    detector = RegimeDetector()
    got = [(detector.update(x), detector.probability)[1] for x in xs]
    assert got == pytest.approx(changepoint_odds(xs), abs=5e-3)


def test_regime_series(spark):
    random.seed(0)
    shift = [(1000.0, abs(random.gauss(s, 0.1 * s))) for s in [0.05] * 200 + [0.3] * 200]
    random.seed(2)
    calm = [(1000.0, abs(random.gauss(0.05, 0.005))) for _ in range(300)]
    gaps = [(1000.0, None if i % 3 else v) for i, (_, v) in enumerate(shift)]
    scored = regime.score_regime(summaries(spark, {"shift": shift, "calm": calm, "gaps": gaps}))
    hits = flagged(scored, "is_regime_change")
    assert any(195 <= i <= 210 for i in hits["shift"]) and "calm" not in hits
    # Windows without volatility change nothing: same as leaving them out.
    odds = scored.where("symbol = 'gaps' AND realized_volatility IS NOT NULL").orderBy("window_index")
    alone = RegimeDetector()
    for row in odds.collect():
        alone.update(math.log(row["realized_volatility"] + 1e-8))
        assert row["changepoint_probability"] == pytest.approx(alone.probability)
    assert scored.where("symbol = 'gaps' AND changepoint_probability IS NULL").count() == 266


def test_both_events_of_one_window(spark):
    random.seed(0)
    series = [(random.gauss(1000, 100), abs(random.gauss(0.05, 0.005))) for _ in range(200)]
    series += [(50_000.0, 3.0)] + [(1000.0, 3.0 + 0.1 * i) for i in range(5)]
    found = events.anomaly_events(events.score_windows(summaries(spark, {"A": series})))
    rows = found.select("window_index", "anomaly_type", "event_order").orderBy("window_index", "event_order").collect()
    assert [tuple(r) for r in rows[:2]] == [(200, "volume_anomaly", 0), (200, "regime_change", 1)]
    topics = {r["topic"] for r in events.event_messages(found).collect()}
    assert topics == {"volume-anomalies", "regime-changes"}
    both = events.union_events(
        volume.volume_anomalies(events.score_windows(summaries(spark, {"A": series}))),
        regime.regime_changes(events.score_windows(summaries(spark, {"A": series}))),
    )
    assert both.count() == found.count()


def test_unknown_event_type_fails(spark):
    rows = summaries(spark, {"A": [(1.0, 1.0)]}).withColumn("anomaly_type", F.lit("other")).withColumns(
        {n: F.lit(0.0) for n in ("anomaly_score", "score_mean", "score_std", "changepoint_probability")})
    with pytest.raises(Exception, match="unknown anomaly event type: other"):
        events.event_messages(rows).collect()


def test_sweep_finds_the_planted_spikes(spark, benchmark_series):
    frame = summaries(spark, {k: v for k, v in benchmark_series.items() if k.startswith("spike")})
    truth = frame.withColumn("is_spike", F.col("window_index") == 600)
    grid = {(r["lookback"], r["threshold"]): r for r in evaluate.sweep(truth, chunk=128).collect()}
    assert len(grid) == 28
    chosen = grid[30, 4.5]
    assert chosen["spikes"] == 20 and chosen["recall"] == 1.0 and chosen["false_per_500"] < 0.1
    assert grid[10, 3.0]["false_positives"] > grid[50, 6.0]["false_positives"]
    whole = {(r["lookback"], r["threshold"]): r for r in evaluate.sweep(truth).collect()}
    assert whole == grid
