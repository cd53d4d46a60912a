"""Numpy helpers for data-anchored windows; used by batch and streaming jobs.

Times are microseconds. A window opens at an anchor trade and stays open until
the first later trade (in arrival order) at least ``width`` after the anchor;
that trade closes it and is the next anchor. Late trades join the open window.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

NEVER = -(1 << 62)  # open-window start of a symbol that has no trade yet


def anchor_positions(ts: np.ndarray, width: int, open_start: int | None) -> np.ndarray:
    """Positions in ``ts`` (arrival order) of the trades that open a window."""
    highest = np.maximum.accumulate(ts).tolist()
    found = []
    at = 0
    if open_start is None:
        found.append(0)
        open_start = highest[0]
    while (at := bisect_left(highest, open_start + width, at)) < len(highest):
        found.append(at)
        open_start = highest[at]
    return np.asarray(found, dtype=np.int64)


def log_returns(price: np.ndarray, previous: np.ndarray) -> np.ndarray:
    """ln(price / previous), NaN unless both are positive."""
    out = np.full(len(price), np.nan)
    usable = (price > 0) & (previous > 0)
    out[usable] = np.log(price[usable] / previous[usable])
    return out


class StepTable:
    """What one stretch of trades does to the open window, for any window open before it.

    If the window open before the stretch started at ``a``, then the first entry
    ``k`` with ``a + width <= due[k]`` gives the start of the window open after
    the stretch (``out[k]``) and how many windows were opened in it
    (``opened[k]``); with no such entry the open window stays as it was. Two
    tables for neighbouring stretches combine into one, in any grouping, so long
    series can be cut into stretches, handled apart and scanned in rounds.

    ``floor`` is the latest time before the stretch. No open window is due later than
    ``floor + width``, so entries beyond the first that reaches it are never asked
    for and not kept, in a combined table neither: its size follows the trades of one
    window width, not the length of the stretch.
    """

    __slots__ = ("due", "out", "opened", "floor")

    def __init__(self, due, out, opened, floor: int):
        self.due = np.asarray(due, dtype=np.int64)
        self.out = np.asarray(out, dtype=np.int64)
        self.opened = np.asarray(opened, dtype=np.int64)
        self.floor = floor

    @classmethod
    def of_trades(cls, ts: np.ndarray, width: int, floor: int) -> StepTable:
        """The table of trades in arrival order; ``floor`` is ``NEVER`` if none came before."""
        records = np.unique(np.maximum.accumulate(ts))
        n = len(records)
        # Each record's next anchor, then pointer doubling to the last one.
        jump = np.searchsorted(records, records + width)
        last = np.arange(n)
        count = np.ones(n, dtype=np.int64)
        ahead = np.append(jump, n)
        hops = np.append(count, 0)
        stop = np.append(last, n)
        while (ahead[:n] < n).any():
            live = ahead[:n] < n
            target = ahead[:n][live]
            hops[:n][live] += hops[target]
            stop[:n][live] = stop[target]
            ahead[:n][live] = ahead[target]
        after = np.searchsorted(records, floor, side="right")
        return cls(records[after:], records[stop[:n]][after:], hops[:n][after:], floor).pruned(width)

    def pruned(self, width: int) -> StepTable:
        """Without entries that no open window asks for, or that lead where their successor does."""
        kept = slice(0, int(np.searchsorted(self.due, self.floor + width)) + 1)
        due, out, opened = self.due[kept], self.out[kept], self.opened[kept]
        if len(due) > 1:
            keep = np.append((out[1:] != out[:-1]) | (opened[1:] != opened[:-1]), True)
            due, out, opened = due[keep], out[keep], opened[keep]
        return StepTable(due, out, opened, self.floor)

    def apply(self, start: int, index: int, width: int) -> tuple[int, int]:
        k = int(np.searchsorted(self.due, start + width))
        if k == len(self.due):
            return start, index
        return int(self.out[k]), index + int(self.opened[k])

    def then(self, later: StepTable, width: int) -> StepTable:
        """The table of this stretch followed by ``later``."""
        k = np.searchsorted(later.due, self.out + width)
        moved = k < len(later.due)
        out, opened = self.out.copy(), self.opened.copy()
        out[moved] = later.out[k[moved]]
        opened[moved] += later.opened[k[moved]]
        rest = slice(0, None)
        if len(self.due):
            rest = slice(int(np.searchsorted(later.due, self.due[-1], side="right")), None)
        return StepTable(
            np.concatenate([self.due, later.due[rest]]),
            np.concatenate([out, later.out[rest]]),
            np.concatenate([opened, later.opened[rest]]),
            self.floor,
        ).pruned(width)
