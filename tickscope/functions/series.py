"""One symbol's running state: open window, return carry, both detectors.

The streaming counterpart of the batch plans, for the rows of one symbol in one
micro-batch. Numpy does the per-trade work; Python loops run per closed window.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from tickscope import schemas as S
from tickscope.functions.anchors import anchor_positions, log_returns
from tickscope.functions.bocpd import RegimeDetector, RegimeParams


@dataclass(frozen=True)
class DetectorParams:
    """Settings of the streaming detectors; defaults are the batch defaults."""

    window_seconds: float = S.WINDOW_SECONDS
    z_threshold: float = S.VOLUME_Z_THRESHOLD
    lookback: int = S.VOLUME_LOOKBACK
    warmup: int = S.VOLUME_WARMUP
    regime: RegimeParams = field(default_factory=RegimeParams)


STATE = (
    "open_us BIGINT, window_index BIGINT, trades BIGINT, volume DOUBLE, ret_n BIGINT, ret_mean DOUBLE, "
    "ret_m2 DOUBLE, last_price DOUBLE, last_end_us BIGINT, history ARRAY<DOUBLE>, updates BIGINT, "
    "run ARRAY<BIGINT>, logp ARRAY<DOUBLE>, mean ARRAY<DOUBLE>, log_beta ARRAY<DOUBLE>"
)

OUTPUT = (
    "symbol STRING, window_index BIGINT, start_us BIGINT, end_us BIGINT, trade_count BIGINT, "
    "volume DOUBLE, realized_volatility DOUBLE, score_mean DOUBLE, score_std DOUBLE, "
    "anomaly_score DOUBLE, is_volume_anomaly BOOLEAN, changepoint_probability DOUBLE, "
    "is_regime_change BOOLEAN"
)


class SymbolSeries:
    def __init__(self, params: DetectorParams, state: tuple | None = None):
        self.params = params
        self.width = round(params.window_seconds * 1_000_000)
        self.detector = RegimeDetector(params.regime)
        self.open_us, self.index = None, -1
        self.trades, self.volume = 0, 0.0
        self.ret_n, self.ret_mean, self.ret_m2 = 0, 0.0, 0.0
        self.last_price, self.last_end_us = None, None
        self.history: list[float] = []
        if state is not None:
            (self.open_us, self.index, self.trades, self.volume, self.ret_n, self.ret_mean,
             self.ret_m2, self.last_price, self.last_end_us, history) = state[:10]
            self.history = list(history)
            self.detector.restore(state[10:15])

    def state(self) -> tuple:
        return (
            self.open_us, self.index, self.trades, self.volume, self.ret_n, self.ret_mean,
            self.ret_m2, self.last_price, self.last_end_us, self.history, *self.detector.state(),
        )

    def feed(self, ts: np.ndarray, price: np.ndarray, size: np.ndarray) -> list[tuple]:
        """Take trades in arrival order; return a scored row per closed window."""
        last = np.nan if self.last_price is None else self.last_price
        returns = log_returns(price, np.append(last, price[:-1]))
        at = anchor_positions(ts, self.width, self.open_us)
        closed = []
        edges = [0, *at.tolist(), len(ts)]
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            if i > 0:
                if self.open_us is not None:
                    closed.append(self._close(int(ts[a])))
                self._open(int(ts[a]))
            self._add(size[a:b], returns[a:b])
        self.last_price = float(price[-1])
        return closed

    def _open(self, start: int) -> None:
        self.open_us, self.index = start, self.index + 1
        self.trades, self.volume = 0, 0.0
        self.ret_n, self.ret_mean, self.ret_m2 = 0, 0.0, 0.0

    def _add(self, size: np.ndarray, returns: np.ndarray) -> None:
        self.trades += len(size)
        self.volume += float(size.sum())
        fresh = returns[~np.isnan(returns)]
        n = len(fresh)
        if n:
            mean = float(fresh.mean())
            gap, total = mean - self.ret_mean, self.ret_n + n
            self.ret_m2 += float(np.square(fresh - mean).sum()) + gap * gap * self.ret_n * n / total
            self.ret_mean += gap * n / total
            self.ret_n = total

    def _close(self, end: int) -> tuple:
        p = self.params
        volatility = math.sqrt(self.ret_m2 / (self.ret_n - 1)) if self.ret_n >= 2 else None
        mean = std = z = None
        if self.index >= p.warmup and len(self.history) >= S.VOLUME_MIN_HISTORY:
            past = np.asarray(self.history)
            # A flat history has deviation 0 exactly, whatever rounding says.
            spread = 0.0 if past.min() == past.max() else float(past.std())
            if spread > 0:
                mean, std = float(past.mean()), spread
                z = (self.volume - mean) / std
        self.history = [*self.history, self.volume][-p.lookback:]
        odds, shifted = None, False
        if volatility is not None:
            shifted = self.detector.update(math.log(volatility + S.VOLATILITY_FLOOR))
            odds = self.detector.probability
        self.last_end_us = end
        return (
            self.index, self.open_us, end, self.trades, self.volume, volatility, mean, std, z,
            z is not None and z > p.z_threshold, odds, shifted,
        )
