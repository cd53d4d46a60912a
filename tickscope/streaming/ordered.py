"""Rows of one key put in order within a bounded memory."""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort
from collections import deque
from collections.abc import Iterable, Iterator
from typing import NamedTuple, Protocol

import numpy as np

ROWS_IN_MEMORY = 1 << 18
WAYS = 4  # runs merged at once


class Store(Protocol):
    """Where pieces wait: a key-value state, for one."""

    def put(self, name: str, data: bytes) -> None: ...

    def take(self, name: str) -> bytes: ...


class MemoryStore(dict):
    """A store for use outside a stream."""

    put = dict.__setitem__
    take = dict.pop


class Piece(NamedTuple):
    """Rows in the store: ordered, from ``first`` to ``last`` of the field."""

    name: str
    rows: int
    first: int
    last: int


class OrderedRows:
    """Takes structured arrays in any order and gives them back ordered by one field.

    Up to ``limit`` rows stay in memory. Beyond that they are ordered and put into the
    store as one piece; merging holds about as many rows again. In the end pieces whose
    ranges do not overlap are read one after the other, each once, so rows that came in
    order, or in stretches that were, cost no more than that. Pieces that overlap are laid
    into as few runs as can be, and ``WAYS`` runs at a time are merged in parts of
    ``limit / WAYS`` rows until one is left: the passes grow with the logarithm of the runs,
    whatever the values are. Rows equal in the field keep no order of their own.
    """

    def __init__(self, store: Store, field: str, limit: int = ROWS_IN_MEMORY):
        self.store, self.field, self.limit = store, field, limit
        self.held: list[np.ndarray] = []
        self.rows = 0
        self.pieces: list[Piece] = []
        self.names = 0
        self.dtype = None

    def add(self, rows: np.ndarray) -> None:
        self.dtype = rows.dtype
        for at in range(0, len(rows), self.limit):
            part = rows[at:at + self.limit]
            if self.rows and self.rows + len(part) > self.limit:
                self._spill()
            self.held.append(part)
            self.rows += len(part)

    def in_order(self) -> Iterator[np.ndarray]:
        """All rows, in arrays of at most ``limit``; the store is left empty."""
        if not self.pieces:
            if self.rows:
                yield self._sorted()
            return
        self._spill()
        yield from _blocks(self._ordered(), self.limit)

    def _ordered(self) -> Iterator[np.ndarray]:
        pieces = sorted(self.pieces, key=lambda piece: (piece.first, piece.last))
        self.pieces, at = [], 0
        while at < len(pieces):
            last, end = pieces[at].last, at + 1
            while end < len(pieces) and pieces[end].first < last:
                last, end = max(last, pieces[end].last), end + 1
            yield from self._merged(self._few(_runs(pieces[at:end])))
            at = end

    def _few(self, runs: list[list[Piece]]) -> list[list[Piece]]:
        """At most ``WAYS`` runs with the same rows, the shortest merged first."""
        heap = [(sum(piece.rows for piece in run), i, run) for i, run in enumerate(runs)]
        heapq.heapify(heap)
        # Merged so that the last round, which is not written, gets as many runs as it can.
        take = (len(heap) - 2) % (WAYS - 1) + 2
        while len(heap) > WAYS:
            shortest = [heapq.heappop(heap) for _ in range(take)]
            merged = self._merged([run for _, _, run in shortest])
            run = [self._put(block) for block in _blocks(merged, self._part())]
            heapq.heappush(heap, (sum(n for n, _, _ in shortest), shortest[0][1], run))
            take = WAYS
        return [run for _, _, run in heap]

    def _merged(self, runs: list[list[Piece]]) -> Iterator[np.ndarray]:
        """The rows of ``runs`` in order."""
        if len(runs) == 1:
            yield from (self._taken(piece) for piece in runs[0])
            return
        waiting = [deque(run) for run in runs]
        heads = [self._head(run) for run in waiting]
        while heads:
            # What is still in the store comes after the last row of its run's head.
            bounds = [head[self.field][-1] for head, run in zip(heads, waiting) if run]
            if bounds:
                cuts = [int(np.searchsorted(head[self.field], min(bounds), side="right")) for head in heads]
            else:
                cuts = [len(head) for head in heads]
            yield self._in_field_order([head[:cut] for head, cut in zip(heads, cuts)])
            heads = [head[cut:] for head, cut in zip(heads, cuts)]
            heads = [head if len(head) or not run else self._head(run) for head, run in zip(heads, waiting)]
            waiting = [run for head, run in zip(heads, waiting) if len(head)]
            heads = [head for head in heads if len(head)]

    def _head(self, run: deque[Piece]) -> np.ndarray:
        """The next rows of a run, no more than a merge may hold of it; the others of a longer piece go back."""
        rows, part = self._taken(run.popleft()), self._part()
        if len(rows) > part:
            run.extendleft([self._put(rows[at:at + part]) for at in range(part, len(rows), part)][::-1])
        return rows[:part].copy()

    def _part(self) -> int:
        return max(1, self.limit // WAYS)

    def _put(self, rows: np.ndarray) -> Piece:
        piece = Piece(str(self.names), len(rows), int(rows[self.field][0]), int(rows[self.field][-1]))
        self.names += 1
        self.store.put(piece.name, rows.tobytes())
        return piece

    def _taken(self, piece: Piece) -> np.ndarray:
        return np.frombuffer(self.store.take(piece.name), self.dtype)

    def _sorted(self) -> np.ndarray:
        rows = self._in_field_order(self.held)
        self.held, self.rows = [], 0
        return rows

    def _in_field_order(self, parts: list[np.ndarray]) -> np.ndarray:
        rows = np.concatenate(parts)
        return rows[np.argsort(rows[self.field], kind="stable")]

    def _spill(self) -> None:
        if self.rows:
            self.pieces.append(self._put(self._sorted()))


def _runs(pieces: list[Piece]) -> list[list[Piece]]:
    """Pieces ordered by ``first`` in as few runs as can be; in a run none overlaps the next."""
    runs: list[list[Piece]] = []
    ends: list[tuple[int, int]] = []  # last value and number of each run, ordered
    for piece in pieces:
        fits = bisect_right(ends, (piece.first, len(pieces)))
        if fits:
            number = ends.pop(fits - 1)[1]
            runs[number].append(piece)
        else:
            number = len(runs)
            runs.append([piece])
        insort(ends, (piece.last, number))
    return runs


def _blocks(arrays: Iterable[np.ndarray], size: int) -> Iterator[np.ndarray]:
    """The same rows in arrays of ``size``, the last one of what is left."""
    held, rows = [], 0
    for array in arrays:
        while len(array):
            part = array[:size - rows]
            held.append(part)
            rows, array = rows + len(part), array[len(part):]
            if rows == size:
                yield held[0] if len(held) == 1 else np.concatenate(held)
                held, rows = [], 0
    if rows:
        yield np.concatenate(held)
