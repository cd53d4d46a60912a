"""Data-anchored tumbling windows per symbol."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickscope import schemas as S
from tickscope.functions.anchors import NEVER, StepTable, anchor_positions, log_returns
from tickscope.operators.hotkeys import ROWS_PER_CHUNK, bucket_of, chunk_hot_keys, with_buckets
from tickscope.session import written

CHUNKS_PER_GROUP = 512
ROWS_PER_BUCKET = 1 << 17

ASSIGNED = "symbol STRING, window_index BIGINT, start_us BIGINT, end_us BIGINT, size DOUBLE, log_return DOUBLE"
STEPS = "symbol STRING, place BIGINT, floor_us BIGINT, due BINARY, out BINARY, opened BINARY"
ENTRIES = "symbol STRING, place BIGINT, open_us BIGINT, open_index BIGINT"


def log_return(price, previous):
    """ln(price / previous); null unless both are positive."""
    return F.when((price > 0) & (previous > 0), F.log(price / previous))


def assign_windows(
    trades: DataFrame,
    window_seconds: float = S.WINDOW_SECONDS,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Window number, start and log return for every trade.

    ``trades``: symbol, arrival, ts, price, size, with ``arrival`` an integer
    giving the processing order, unique within a symbol. Besides one row per
    trade (``end_us`` null) there is one marker row per closed window, carrying
    ``end_us`` only; :func:`summarise` folds both in one aggregation.

    The window number counts from 0 within the symbol. Symbols with more than
    ``rows_per_chunk`` trades are cut into chunks that run in parallel; the open
    window and last price at each chunk's start are worked out first.
    """
    width = round(window_seconds * 1_000_000)
    ticks = trades.select(
        "symbol", "arrival", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.col("price").cast("double").alias("price"), F.col("size").cast("double").alias("size"),
    )
    cut = chunk_hot_keys(
        ticks, "symbol", "arrival", rows_per_chunk,
        top=F.max("ts_us"), last_price=F.max_by("price", "arrival"),
    )
    columns = ["symbol", "ts_us", "price", "size"]
    if cut is None:
        keys, ready = ["symbol"], ticks
    else:
        keys = ["symbol", "chunk"]
        columns += ["chunk", "open_us", "open_index", "carried"]
        entries = _chunk_entries(ticks, *cut, width, rows_per_chunk)
        found = ("chunk", "open_us", "open_index", "carried")
        ready = with_buckets(ticks, entries, "symbol", "arrival", rows_per_chunk, *found)
        ready = ready.withColumn("chunk", F.coalesce("chunk", F.lit(0)))
    ordered = ready.repartition(*keys).sortWithinPartitions(*keys, "arrival")
    return ordered.select(*columns).mapInArrow(_assigner(width), ASSIGNED)


def summarise(assigned: DataFrame) -> DataFrame:
    """One row per closed window; the last, still open one is left out."""
    ret = F.col("log_return")
    return (
        assigned.groupBy("symbol", "window_index")
        .agg(
            F.min("start_us").alias("start_us"),
            F.max("end_us").alias("end_us"),
            F.count("start_us").alias("trade_count"),
            F.sum("size").alias("volume"),
            F.when(F.count(ret) >= 2, F.stddev_samp(ret)).alias("realized_volatility"),
        )
        .where(F.col("end_us").isNotNull())
        .select(
            "symbol", "window_index",
            F.timestamp_micros("start_us").alias("window_start"),
            F.timestamp_micros("end_us").alias("window_end"),
            "trade_count", "volume", "realized_volatility",
        )
    )


def window_summaries(
    trades: DataFrame,
    window_seconds: float = S.WINDOW_SECONDS,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    return summarise(assign_windows(trades, window_seconds, rows_per_chunk))


def _assigner(width: int):
    """Arrow mapper over rows sorted by symbol, chunk and arrival.

    Holds one batch and one open window at a time, however long a symbol is.
    """

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_us, index, last = None, None, -1, np.nan
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            symbol = batch.column("symbol")
            chunk = batch.column("chunk") if "chunk" in batch.schema.names else None
            ts = batch.column("ts_us").to_numpy(zero_copy_only=False)
            price = batch.column("price").to_numpy(zero_copy_only=False)
            differs = pc.not_equal(symbol[1:], symbol[:-1])
            if chunk is not None:
                differs = pc.or_(differs, pc.not_equal(chunk[1:], chunk[:-1]))
            edges = [0, *(np.flatnonzero(differs.to_numpy(zero_copy_only=False)) + 1).tolist(), n]
            start = np.empty(n, dtype=np.int64)
            number = np.empty(n, dtype=np.int64)
            previous = np.append(last, price[:-1])
            anchors = []
            for a, b in zip(edges[:-1], edges[1:]):
                this = (symbol[a].as_py(), None if chunk is None else chunk[a].as_py())
                if this != key:
                    key, open_us, index, previous[a] = this, None, -1, np.nan
                    if chunk is not None:
                        entry = [batch.column(c)[a].as_py() for c in ("open_us", "open_index", "carried")]
                        if entry[0] is not None:
                            open_us, index = entry[:2]
                        if entry[2] is not None:
                            previous[a] = entry[2]
                at = anchor_positions(ts[a:b], width, open_us)
                opened = np.zeros(b - a, dtype=np.int64)
                opened[at] = 1
                opened = np.cumsum(opened)
                starts = np.append(np.int64(0 if open_us is None else open_us), ts[a:b][at])
                start[a:b] = starts[opened]
                number[a:b] = opened + index
                index += len(at)
                open_us = int(starts[-1])
                anchors.append(at + a)
            last = price[-1]
            closing = np.concatenate(anchors)
            closing = closing[number[closing] > 0]
            yield _with_markers(batch, number, start, ts, log_returns(price, previous), closing)

    return assign


def _with_markers(batch, number, start, ts, returns, closing) -> pa.RecordBatch:
    n, m, symbol = batch.num_rows, len(closing), batch.column("symbol")
    marker = np.arange(n + m) >= n
    void = np.full(m, np.nan)
    returns = np.concatenate([returns, void])
    return pa.RecordBatch.from_arrays(
        [
            pa.concat_arrays([symbol, symbol.take(pa.array(closing))]),
            pa.array(np.concatenate([number, number[closing] - 1])),
            pa.array(np.concatenate([start, np.zeros(m, np.int64)]), mask=marker),
            pa.array(np.concatenate([np.zeros(n, np.int64), ts[closing]]), mask=~marker),
            pa.concat_arrays([batch.column("size"), pa.nulls(m, pa.float64())]),
            pa.array(returns, mask=np.isnan(returns)),
        ],
        names=["symbol", "window_index", "start_us", "end_us", "size", "log_return"],
    )


def _chunk_entries(
    ticks: DataFrame, buckets: DataFrame, chunks: int, width: int, rows_per_chunk: int
) -> DataFrame:
    """The buckets with the open window, window number and last price at the start of their chunk.

    Each chunk is turned into a step table on its own, and a parallel prefix scan runs
    over the tables: neighbours are combined in groups, the groups' tables in groups
    again, until one walk covers a symbol; then every level gives its groups' entries
    to the level below. Tables stream by, so a task holds two of them, and each keeps
    only the entries that can be asked for.
    """
    so_far = Window.partitionBy("symbol").orderBy("bucket")
    top_before = F.max("top").over(so_far.rowsBetween(Window.unboundedPreceding, -1))
    first = Window.partitionBy("symbol", "chunk").orderBy("bucket")
    first = first.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    facts = written(
        buckets.withColumns({"floor_us": F.coalesce(top_before, F.lit(NEVER)), "carried": F.lag("last_price").over(so_far)})
        .select(
            "symbol", "bucket", "chunk",
            F.first("floor_us").over(first).alias("floor_us"), F.first("carried").over(first).alias("carried"),
        )
    )
    hot = with_buckets(ticks, facts, "symbol", "arrival", rows_per_chunk, "chunk", "floor_us").where(
        F.col("chunk").isNotNull()
    )
    ordered = hot.repartition("symbol", "chunk").sortWithinPartitions("symbol", "chunk", "arrival")
    tables = ordered.select("symbol", F.col("chunk").alias("place"), "floor_us", "ts_us").mapInArrow(
        _stepper(width), STEPS
    )
    entries = _entries(tables, width, chunks)
    nothing = F.lit(None).cast("bigint")
    fresh = F.col("open_index") < 0
    return facts.join(entries.withColumnRenamed("place", "chunk"), ["symbol", "chunk"]).select(
        "symbol", "bucket", "chunk", "carried",
        F.when(fresh, nothing).otherwise(F.col("open_us")).alias("open_us"),
        F.when(fresh, nothing).otherwise(F.col("open_index")).alias("open_index"),
    )


def _entries(tables: DataFrame, width: int, places: int) -> DataFrame:
    """symbol, place, open_us, open_index: the state before every stretch; ``places`` bounds their numbers."""
    start = tables.withColumns({"open_us": F.lit(NEVER), "open_index": F.lit(-1).cast("bigint")})
    if places <= CHUNKS_PER_GROUP:
        return written(_in_order(start, "symbol").mapInArrow(_walker(width), ENTRIES))
    tables = written(tables)
    group = F.floor(F.col("place") / CHUNKS_PER_GROUP).alias("group")
    whole = _in_order(tables.select("*", group), "symbol", "group").mapInArrow(_combiner(width), STEPS)
    above = _entries(whole, width, -(-places // CHUNKS_PER_GROUP)).withColumnRenamed("place", "group")
    below = tables.select("*", group).join(above, ["symbol", "group"])
    return written(_in_order(below, "symbol", "group").mapInArrow(_walker(width), ENTRIES))


def _in_order(tables: DataFrame, *keys: str) -> DataFrame:
    """Few rows, each a table: one partition for each group, in order of place."""
    if "group" not in tables.columns:
        tables = tables.withColumn("group", F.lit(0).cast("bigint"))
    return tables.repartition(*keys).sortWithinPartitions("symbol", "group", "place")


def _stepper(width: int):
    """Arrow mapper from trades in order of symbol, chunk and arrival to a step table for each chunk.

    Of a chunk it holds the times that were the latest so far, all that a table needs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, records = None, []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            symbol, place, floor = (batch.column(c) for c in ("symbol", "place", "floor_us"))
            ts = batch.column("ts_us").to_numpy(zero_copy_only=False)
            differs = pc.or_(pc.not_equal(symbol[1:], symbol[:-1]), pc.not_equal(place[1:], place[:-1]))
            edges = [0, *(np.flatnonzero(differs.to_numpy(zero_copy_only=False)) + 1).tolist(), len(ts)]
            done = []
            for a, b in zip(edges[:-1], edges[1:]):
                this = (symbol[a].as_py(), place[a].as_py(), floor[a].as_py())
                if this != key:
                    if key is not None:
                        done.append((key, records))
                    key, records = this, []
                records.append(np.unique(np.maximum.accumulate(ts[a:b])))
            if done:
                yield _table_rows([(k, _table_of(k, r, width)) for k, r in done])
        if key is not None:
            yield _table_rows([(key, _table_of(key, records, width))])

    return run


def _table_of(key: tuple, records: list[np.ndarray], width: int) -> StepTable:
    return StepTable.of_trades(np.concatenate(records), width, key[2])


def _table_rows(tables: list[tuple[tuple, StepTable]]) -> pa.RecordBatch:
    columns = [
        pa.array([key[0] for key, _ in tables], pa.string()),
        pa.array([key[1] for key, _ in tables], pa.int64()),
        pa.array([table.floor for _, table in tables], pa.int64()),
        *(pa.array([getattr(table, f).tobytes() for _, table in tables], pa.binary()) for f in ("due", "out", "opened")),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in STEPS.split(", ")])


def _read_tables(batch: pa.RecordBatch) -> Iterator[tuple[dict, StepTable]]:
    for i in range(batch.num_rows):
        row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
        parts = (np.frombuffer(row.pop(f), np.int64) for f in ("due", "out", "opened"))
        yield row, StepTable(*parts, row["floor_us"])


def _combiner(width: int):
    """Arrow mapper that folds the tables of a group, which come in order, into one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, whole = None, None
        for batch in batches:
            for row, table in _read_tables(batch):
                this = (row["symbol"], row["group"])
                if this == key:
                    whole = whole.then(table, width)
                    continue
                if key is not None:
                    yield _table_rows([(key, whole)])
                key, whole = this, table
        if key is not None:
            yield _table_rows([(key, whole)])

    return run


def _walker(width: int):
    """Arrow mapper that leads a state through the tables of a group; each row has the group's first state."""
    names = [c.split()[0] for c in ENTRIES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for row, table in _read_tables(batch):
                this = (row["symbol"], row["group"])
                if this != key:
                    key, state = this, (row["open_us"], row["open_index"])
                out.append((row["symbol"], row["place"], *state))
                state = table.apply(*state, width)
            columns = list(zip(*out)) if out else [[]] * len(names)
            types = [pa.string(), *[pa.int64()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    return run


def log_returns_of(trades: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``trades`` with the price of the symbol's previous trade and the log return from it.

    ``arrival`` gives the order, as for windows. A symbol is cut into buckets of at
    most ``rows_per_bucket`` orders (a power of two); each bucket is ordered by itself
    and one boundary row for each carries the last price over to the next. So the
    trades of a symbol spread over tasks, and only boundaries are looked at together.
    """
    bits = rows_per_bucket.bit_length() - 1
    cut = trades.withColumn("_bucket", bucket_of("arrival", bits))
    keys = ["symbol", "_bucket"]
    last = cut.groupBy(*keys).agg(F.max_by("price", "arrival").alias("_last"))
    boundary = last.select(*keys, F.lag("_last").over(Window.partitionBy("symbol").orderBy("_bucket")).alias("_carried"))
    within = Window.partitionBy(*keys).orderBy("arrival")
    known = cut.withColumns({"_lag": F.lag("price").over(within), "_place": F.row_number().over(within)})
    previous = F.when(F.col("_place") == 1, F.col("_carried")).otherwise(F.col("_lag"))
    joined = known.join(boundary, keys).withColumn("previous_price", previous)
    return joined.withColumn("log_return", log_return(F.col("price"), F.col("previous_price"))).select(
        *trades.columns, "previous_price", "log_return"
    )
