from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.plain import BASE_US, random_trades, windows
from tickscope.functions.anchors import NEVER, StepTable, anchor_positions
from tickscope.operators import anchored, hotkeys


def frame(spark, rows):
    made = spark.createDataFrame(rows, "symbol STRING, arrival BIGINT, us BIGINT, price DOUBLE, size DOUBLE")
    return made.withColumn("ts", F.timestamp_micros("us"))


def closed(spark, rows, seconds=10.0, **options):
    out = anchored.window_summaries(frame(spark, rows), seconds, **options).select(
        "symbol", "window_index", F.unix_micros("window_start"), F.unix_micros("window_end"),
        "trade_count", "volume", "realized_volatility",
    )
    return sorted(tuple(r) for r in out.collect())


def rounded(rows):
    return [(*r[:6], None if r[6] is None else round(r[6], 9)) for r in rows]


def stdev(values):
    mean = sum(values) / len(values)
    return math.sqrt(sum((v - mean) ** 2 for v in values) / (len(values) - 1))


# Example trades as (second, price, size) and the windows they close,
# as (start, end, count, volume, volatility).
EXAMPLES = [
    ([(0, 100, 10), (5, 100.5, 20), (9.9, 101, 5)], []),
    ([(0, 100, 10), (2, 100.5, 20), (5, 101, 15), (11, 101.2, 5)],
     [(0, 11, 3, 45.0, stdev([math.log(100.5 / 100), math.log(101 / 100.5)]))]),
    ([(0, 100, 10), (11, 101.2, 5), (12, 101.25, 2), (21, 101.3, 1)],
     [(0, 11, 1, 10.0, None), (11, 21, 2, 7.0, stdev([math.log(1.012), math.log(101.25 / 101.2)]))]),
    ([(0, 100, 10), (11, 101, 5)], [(0, 11, 1, 10.0, None)]),
    ([(0, 100, 10), (1, 101, 10), (2, 99, 10), (11, 100, 10)],
     [(0, 11, 3, 30.0, stdev([math.log(1.01), math.log(99 / 101)]))]),
    ([(0, 100, 10), (11, 110, 10), (15, 100, 10), (18, 121, 10), (22, 130, 10)],
     [(0, 11, 1, 10.0, None),
      (11, 22, 3, 30.0, stdev([math.log(1.1), math.log(100 / 110), math.log(1.21)]))]),
    ([(0, 100, 10), (3600, 100, 10)], [(0, 3600, 1, 10.0, None)]),
    # a late trade joins the open window; a zero price gives no return on either side
    ([(0, 100, 1), (12, 0, 2), (3, 50, 4), (21, 60, 8), (22, 60, 1)], [(0, 12, 1, 1.0, None), (12, 22, 3, 14.0, None)]),
    # equal times stay together
    ([(0, 1, 1), (0, 1, 2), (10, 1, 4), (10, 1, 8), (20, 1, 1)], [(0, 10, 2, 3.0, None), (10, 20, 2, 12.0, 0.0)]),
]


def test_worked_examples(spark):
    rows, want = [], []
    for n, (trades, expected) in enumerate(EXAMPLES):
        symbol = f"S{n}"
        rows += [(symbol, i, BASE_US + round(t * 1e6), float(p), float(z)) for i, (t, p, z) in enumerate(trades)]
        want += [
            (symbol, i, BASE_US + s * 1_000_000, BASE_US + e * 1_000_000, c, v, vol)
            for i, (s, e, c, v, vol) in enumerate(expected)
        ]
    assert rounded(closed(spark, rows)) == rounded(sorted(want))


@pytest.mark.parametrize("seconds", [4, 60])
def test_random_series(spark, seconds):
    rows = random_trades(5, 3000)
    assert rounded(closed(spark, rows, float(seconds))) == rounded(windows(rows, seconds))


@pytest.mark.parametrize("seconds,per_chunk", [(4, 37), (60, 11), (900, 300)])
def test_cutting_a_symbol_into_chunks_changes_nothing(spark, monkeypatch, seconds, per_chunk):
    monkeypatch.setattr(anchored, "CHUNKS_PER_GROUP", 5)
    rows = random_trades(6, 1200)
    got = closed(spark, rows, float(seconds), rows_per_chunk=per_chunk)
    assert rounded(got) == rounded(windows(rows, seconds))


def test_step_tables_agree_with_following_the_chain():
    rng = np.random.default_rng(3)
    for _ in range(200):
        ts = np.cumsum(rng.integers(0, 6, 60)) - rng.integers(0, 9, 60)
        width = int(rng.integers(1, 25))
        cuts = sorted(set([0, *rng.integers(1, 59, 4).tolist(), 60]))
        parts = [ts[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        tables, floor = [], NEVER
        for part in parts:
            tables.append(StepTable.of_trades(part, width, floor))
            floor = max(floor, int(part.max()))
        whole = tables[0]
        for table in tables[1:]:
            whole = whole.then(table, width)
        at = anchor_positions(ts, width, None)
        want = (int(ts[at][-1]), len(at) - 1)
        state = (NEVER, -1)
        for table in tables:
            state = table.apply(*state, width)
        assert state == want and whole.apply(NEVER, -1, width) == want


def test_step_tables_keep_only_what_an_open_window_can_ask_for():
    rng = np.random.default_rng(4)
    for width in (1, 10, 200, 5000):
        ts = np.cumsum(rng.integers(0, 6, 4000)) - rng.integers(0, 9, 4000)
        parts = np.split(ts, 50)
        floors = [NEVER, *np.maximum.accumulate([p.max() for p in parts])[:-1].tolist()]
        level = [StepTable.of_trades(p, width, f) for p, f in zip(parts, floors)]
        states, state = [], (NEVER, -1)
        for table in level:
            states.append(state)
            state = table.apply(*state, width)
        while len(level) > 1:  # pairwise rounds
            level = [level[i].then(level[i + 1], width) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
            for table in level:
                asked = ts[(ts > table.floor) & (ts < table.floor + width)]
                assert len(table.due) <= len(np.unique(asked)) + 1
        assert level[0].apply(NEVER, -1, width) == state
        # From the middle on, the combined table leads from the state there to the same end.
        half = [StepTable.of_trades(p, width, f) for p, f in zip(parts[25:], floors[25:])]
        whole = half[0]
        for table in half[1:]:
            whole = whole.then(table, width)
        assert whole.apply(*states[25], width) == state


def test_chunks_are_ordered_bounded_and_only_for_hot_keys(spark):
    rows = frame(spark, random_trades(8, 2000)).select("symbol", "arrival", "price")
    buckets, bound = hotkeys.chunk_hot_keys(rows, "symbol", "arrival", 500, top=F.max("arrival"))
    cut = hotkeys.with_buckets(rows, buckets, "symbol", "arrival", 500, "chunk", "top")
    got = cut.groupBy("symbol", "chunk").agg(
        F.count(F.lit(1)).alias("n"), F.min("arrival").alias("lo"), F.max("arrival").alias("hi"), F.max("top").alias("top")
    ).orderBy("symbol", "chunk").collect()
    assert sum(r["n"] for r in got) == 2000
    assert {r["symbol"] for r in got if r["chunk"] is not None} == {"A"}
    hot = [r for r in got if r["symbol"] == "A"]
    assert max(r["chunk"] for r in hot) < bound <= len(hot)
    assert len(hot) >= 3 and all(r["n"] <= 500 + 16 and r["top"] == r["hi"] for r in hot)
    assert all(a["hi"] < b["lo"] for a, b in zip(hot, hot[1:]))
    assert hotkeys.chunk_hot_keys(rows, "symbol", "arrival", 5000) is None


@pytest.mark.parametrize("per_bucket", [1, 8, 1 << 20])
def test_log_returns_are_carried_over_bucket_borders(spark, per_bucket):
    rows = random_trades(9, 800)
    got = anchored.log_returns_of(frame(spark, rows), per_bucket)
    last, want = {}, set()
    for symbol, arrival, _, price, _ in rows:
        before = last.get(symbol)
        ret = math.log(price / before) if before and price else None
        want.add((symbol, arrival, before, None if ret is None else round(ret, 9)))
        last[symbol] = price
    assert {(r["symbol"], r["arrival"], r["previous_price"], None if r["log_return"] is None else round(r["log_return"], 9))
            for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    trades_ordered = [x for x in plan.splitlines() if "Window [" in x and "row_number" in x]
    assert len(trades_ordered) == 1 and "_bucket" in trades_ordered[0].split("windowspecdefinition(")[1].split(")")[0]


def test_one_sort_and_one_shuffle_before_the_fold(spark):
    plan = anchored.window_summaries(frame(spark, random_trades(1, 50)))._jdf.queryExecution().executedPlan().toString()
    before_fold = plan[plan.index("MapInArrow"):]
    assert before_fold.count("Exchange") == 1 and before_fold.count("Sort ") == 1
