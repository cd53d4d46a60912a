"""Streaming windows and detectors: one state value per symbol."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import MapState, StatefulProcessor, StatefulProcessorHandle

from tickscope.functions.series import OUTPUT, STATE, DetectorParams, SymbolSeries
from tickscope.streaming.ordered import ROWS_IN_MEMORY, OrderedRows

STATE_NAME, WAITING_NAME = "series", "waiting"
STATE_FIELDS = [part.split(" ", 1) for part in STATE.split(", ")]
OUTPUT_NAMES = [part.split()[0] for part in OUTPUT.split(", ")]
ROWS_PER_FRAME = 1 << 12  # closed windows that leave together
TRADE = np.dtype([("arrival", "<i8"), ("ts_us", "<i8"), ("price", "<f8"), ("size", "<f8")])


class StateStore:
    """Pieces of a micro-batch in the key's map state."""

    def __init__(self, state: MapState):
        self.state = state

    def put(self, name: str, data: bytes) -> None:
        self.state.updateValue((name,), (data,))

    def take(self, name: str) -> bytes:
        data = bytes(self.state.getValue((name,))[0])
        self.state.removeKey((name,))
        return data


class WindowDetector(StatefulProcessor):
    """Keeps a symbol's open window and model state between micro-batches.

    Rows of a symbol arrive in shuffle order. Up to ``rows_in_memory`` are put in arrival
    order at once; more of them wait in the state store in ordered pieces, and are fed to
    the series part by part, so a symbol may fill a micro-batch of any size.
    """

    def __init__(self, params: DetectorParams = DetectorParams(), rows_in_memory: int = ROWS_IN_MEMORY):
        self.params, self.rows_in_memory = params, rows_in_memory

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.series = handle.getValueState(STATE_NAME, STATE)
        self.waiting = handle.getMapState(WAITING_NAME, "piece STRING", "rows BINARY")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ordered = OrderedRows(StateStore(self.waiting), "arrival", self.rows_in_memory)
        for frame in rows:
            ordered.add(_trades(frame))
        series = SymbolSeries(self.params, self.series.get() if self.series.exists() else None)
        closed = []
        for trades in ordered.in_order():
            closed += series.feed(trades["ts_us"], trades["price"], trades["size"])
            if len(closed) >= ROWS_PER_FRAME:
                yield _scored(key[0], closed)
                closed = []
        if closed:
            yield _scored(key[0], closed)
        self.series.update(series.state())

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.series.update(tuple(_plain(row[name], kind) for name, kind in STATE_FIELDS))

    def close(self) -> None:
        pass


def _scored(symbol: str, closed: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame([(symbol, *row) for row in closed], columns=OUTPUT_NAMES)
    return frame.astype({
        n: "float64" for n in OUTPUT_NAMES if n.startswith(("realized", "score", "anomaly", "change"))
    })


def _trades(frame: pd.DataFrame) -> np.ndarray:
    out = np.empty(len(frame), TRADE)
    for name in TRADE.names:
        out[name] = frame[name].to_numpy(dtype=TRADE[name])
    return out


def _plain(value, kind: str):
    """A value of a state row as the state store takes it."""
    if kind.startswith("ARRAY"):
        cast = int if "BIGINT" in kind else float
        return [cast(x) for x in value]
    if value is None or value != value:
        return None
    return int(value) if kind == "BIGINT" else float(value)


def detect(
    trades: DataFrame,
    params: DetectorParams = DetectorParams(),
    initial: DataFrame | None = None,
    rows_in_memory: int = ROWS_IN_MEMORY,
) -> DataFrame:
    """Scored windows of a streaming trade frame (symbol, arrival, ts, price, size).

    ``initial``: `model_state` of an earlier query, to go on from with a new checkpoint. Spark
    hands it over in the first micro-batch, whose rows then come slowly and a symbol's all at
    once; make that an empty one.
    """
    rows = trades.select(
        "symbol", F.col("arrival").cast("bigint").alias("arrival"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.col("price").cast("double").alias("price"), F.col("size").cast("double").alias("size"),
    )
    scored = rows.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=WindowDetector(params, rows_in_memory), outputStructType=OUTPUT, outputMode="append",
        timeMode="none", initialState=None if initial is None else initial.groupBy("symbol"),
    )
    def or_null(name):
        return F.nanvl(F.col(name), F.lit(None).cast("double")).alias(name)

    return scored.select(
        "symbol", "window_index", F.timestamp_micros("start_us").alias("window_start"),
        F.timestamp_micros("end_us").alias("window_end"), "trade_count", "volume",
        or_null("realized_volatility"), or_null("score_mean"), or_null("score_std"),
        or_null("anomaly_score"), "is_volume_anomaly", or_null("changepoint_probability"),
        "is_regime_change",
    )


def model_state(spark, checkpoint: str) -> DataFrame:
    """Saved state of every symbol, read from a stopped or running query's checkpoint."""
    rows = (
        spark.read.format("statestore").option("path", checkpoint).option("stateVarName", STATE_NAME).load()
    )
    return rows.select(F.col("key.symbol").alias("symbol"), "value.*")


def freshness_from_state(spark, checkpoint: str) -> DataFrame:
    """End of the last window each symbol's models were fed; null before the first."""
    return model_state(spark, checkpoint).select(
        "symbol", F.timestamp_micros("last_end_us").alias("last_updated")
    )
