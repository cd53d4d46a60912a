"""Plain-Python versions of the definitions, written for checking only."""

from __future__ import annotations

import math
import random
import statistics

BASE_US = 1_704_067_200_000_000


def random_trades(seed: int, n: int, symbols="ABC", weights=(8, 1, 1)):
    """(symbol, arrival, ts_us, price, size) with late, equal and far-apart times."""
    rng = random.Random(seed)
    clock = dict.fromkeys(symbols, 0)
    rows = []
    for i in range(n):
        s = rng.choices(symbols, weights)[0]
        clock[s] += rng.choice([0, 0, 1, 2, 5, -7, 15 if rng.random() < 0.1 else 3])
        rows.append((
            s, 3 * i, BASE_US + clock[s] * 1_000_000 + rng.randrange(3),
            rng.choice([100.0, 101.5, 99.0, 0.0, 102.0]), float(rng.randrange(100)),
        ))
    return rows


def windows(rows, seconds):
    """Closed windows of trades in arrival order."""
    width, open_windows, out = seconds * 1_000_000, {}, []
    for symbol, _, us, price, size in rows:
        w = open_windows.setdefault(symbol, {"start": None, "last": None, "index": -1})
        if w["start"] is None or us - w["start"] >= width:
            if w["start"] is not None:
                vol = statistics.stdev(w["returns"]) if len(w["returns"]) > 1 else None
                out.append((symbol, w["index"], w["start"], us, w["n"], w["volume"], vol))
            w.update(start=us, n=0, volume=0.0, returns=[], index=w["index"] + 1)
        if w["last"] is not None and price > 0 and w["last"] > 0:
            w["returns"].append(math.log(price / w["last"]))
        w["last"] = price
        w["n"] += 1
        w["volume"] += size
    return sorted(out)


def volume_scores(volumes, threshold=4.5, lookback=30, warmup=30):
    """(z or None, flagged) per window of one symbol."""
    out = []
    for i, v in enumerate(volumes):
        past = volumes[max(0, i - lookback): i]
        z = None
        if i >= warmup and len(past) >= 5:
            sd = statistics.pstdev(past)
            z = (v - statistics.fmean(past)) / sd if sd > 0 else None
        out.append((z, z is not None and z > threshold))
    return out


def changepoint_odds(xs, lam=100.0, short=1, least=0.0):
    """Run-length posterior in linear space and by its textbook form.

    Kept whole, or without longer runs whose weight is below ``least``.
    """
    weights, stats, out = [1.0], [(0.0, 1.0, 1.0, 1.0)], []
    for x in xs:
        dens = []
        for mu, kappa, alpha, beta in stats:
            dof, scale = 2 * alpha, math.sqrt(beta * (kappa + 1) / (alpha * kappa))
            t = (x - mu) / scale
            dens.append(
                math.gamma((dof + 1) / 2) / (math.gamma(dof / 2) * math.sqrt(dof * math.pi) * scale)
                * (1 + t * t / dof) ** (-(dof + 1) / 2)
            )
        evidence = sum(w * d for w, d in zip(weights, dens))
        grown = [w * d * (1 - 1 / lam) / evidence for w, d in zip(weights, dens)]
        weights = [1 / lam, *grown]
        moved = [
            ((kappa * mu + x) / (kappa + 1), kappa + 1, alpha + 0.5,
             beta + kappa * (x - mu) ** 2 / (2 * (kappa + 1)))
            for mu, kappa, alpha, beta in stats
        ]
        stats = [(0.0, 1.0, 1.0, 1.0), *moved]
        kept = [i for i, w in enumerate(weights) if i <= short or w >= least]
        weights, stats = [weights[i] for i in kept], [stats[i] for i in kept]
        out.append(sum(weights[: short + 1]))
    return out
