"""Bayesian online changepoint detection (Adams & MacKay, 2007) for one series.

The run-length distribution is kept as numpy vectors, one entry per surviving
run length, with a Normal-Gamma posterior each. Under that prior the posterior's
kappa and alpha depend on the run length alone, so only run length, mean, beta
and log probability are stored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class RegimeParams:
    """Defaults of the regime detector."""

    hazard_lambda: float = 100.0
    mu0: float = 0.0
    kappa0: float = 1.0
    alpha0: float = 1.0
    beta0: float = 1.0
    threshold: float = 0.5
    short_run: int = 1
    prune_below: float = 1e-4

    @property
    def warmup(self) -> int:
        return 2 * (self.short_run + 1)


def _logsumexp(values: np.ndarray) -> float:
    top = np.maximum.reduce(values)
    return -math.inf if top == -math.inf else top + math.log(np.add.reduce(np.exp(values - top)))


class RunTable:
    """Per run length: what of the predictive density and update depends on it alone.

    Rows: constant of the log density, exponent, weight of the squared gap in
    beta, step of the mean. Shared by all series a worker handles.
    """

    def __init__(self, params: RegimeParams):
        self.params = params
        self.values = np.empty((4, 0))

    def upto(self, longest: int) -> np.ndarray:
        known = self.values.shape[1]
        if longest >= known:
            p = self.params
            run = np.arange(known, max(256, 2 * (longest + 1)))
            kappa, alpha = p.kappa0 + run, p.alpha0 + 0.5 * run
            gammas = np.array([math.lgamma(a + 0.5) - math.lgamma(a) for a in alpha.tolist()])
            fresh = np.stack([
                gammas - 0.5 * np.log(2.0 * math.pi * (kappa + 1.0) / kappa),
                alpha + 0.5,
                kappa / (2.0 * (kappa + 1.0)),
                1.0 / (kappa + 1.0),
            ])
            self.values = np.concatenate([self.values, fresh], axis=1)
        return self.values


class RegimeDetector:
    """Feed one value at a time; ``probability`` is P(run length <= short_run).

    Growth and changepoint branches share one evidence term, so after dividing by
    it the new run of length 0 always has the hazard's probability. Beta is kept
    as its logarithm: the term the density needs is also what the update adds.
    """

    def __init__(self, params: RegimeParams = RegimeParams(), table: RunTable | None = None):
        self.params = params
        self._table = table or RunTable(params)
        self._log_hazard = math.log(1.0 / params.hazard_lambda)
        self._log_stay = math.log1p(-1.0 / params.hazard_lambda)
        self._floor = math.log(params.prune_below)
        self.reset()

    def reset(self) -> None:
        p = self.params
        self.updates = 0
        self.run = np.zeros(1, dtype=np.int64)
        # Rows: log probability, mean, log beta.
        self.now = np.array([[0.0], [p.mu0], [math.log(p.beta0)]])

    def state(self) -> tuple:
        return (self.updates, self.run.tolist(), *self.now.tolist())

    def restore(self, state: tuple) -> None:
        self.updates = int(state[0])
        self.run = np.asarray(state[1], dtype=np.int64)
        self.now = np.asarray(state[2:5], dtype=float)

    def update(self, x: float) -> bool:
        p, run = self.params, self.run
        logp, mean, log_beta = self.now
        constant, exponent, weight, step = self._table.upto(int(run[-1])).take(run, axis=1)
        gap = x - mean
        growth = np.log1p(weight * gap * gap * np.exp(-log_beta))
        joint = logp + constant - 0.5 * log_beta - exponent * growth
        new = np.empty((3, len(run) + 1))
        new[:, 0] = self._log_hazard, p.mu0, math.log(p.beta0)
        np.subtract(joint, _logsumexp(joint) - self._log_stay, out=new[0, 1:])
        np.add(mean, gap * step, out=new[1, 1:])
        np.add(log_beta, growth, out=new[2, 1:])
        longer = np.empty(len(run) + 1, dtype=np.int64)
        longer[0] = 0
        np.add(run, 1, out=longer[1:])
        keep = new[0] >= self._floor
        keep[: p.short_run + 1] = True
        if np.count_nonzero(keep) < len(longer):
            new, longer = new.compress(keep, axis=1), longer.compress(keep)
        self.now, self.run = new, longer
        self.updates += 1
        return self.updates > p.warmup and self.probability >= p.threshold

    @property
    def probability(self) -> float:
        return sum(map(math.exp, self.now[0, : self.params.short_run + 1].tolist()))
