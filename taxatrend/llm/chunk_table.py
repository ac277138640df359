"""A table of distinct chunks: each is encoded once, and whole texts are put together from it by position."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np


class Rows(dict):
    """Row numbers of chunks; a chunk not yet met gets the next number and waits to be encoded."""

    def __init__(self):
        super().__init__()
        self.waiting: list[str] = []

    def __missing__(self, chunk: str) -> int:
        row = self[chunk] = len(self)
        self.waiting.append(chunk)
        return row


class ChunkTable:
    """Chunk -> row number; the rows' ids lie one after the other in one array.

    ``encode(chunks)`` gives the ids of chunks not yet met. Memory is bounded: beyond ``entries`` chunks or ``pool`` ids
    the table starts anew with the next batch, so a chunk may be encoded again, never differently.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], entries: int = 500_000, pool: int = 8_000_000):
        self.encode, self.entries, self.pool = encode, entries, pool
        self.clear()

    def clear(self) -> None:
        self.rows = Rows()
        self.ids = np.empty(1 << 16, np.int32)
        self.ends = np.zeros(1 << 14, np.int64)  # row r's ids end at ends[r + 1]

    def _add(self, n: int, chunks: list[str]) -> None:
        """Encode the chunks of rows n and on."""
        found = self.encode(chunks)
        if n + len(found) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(len(self.ends) + len(found), np.int64)])
        start = int(self.ends[n])
        self.ends[n + 1 : n + 1 + len(found)] = start + np.cumsum([len(f) for f in found])
        stop = int(self.ends[n + len(found)])
        if stop > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(len(self.ids) + stop - start, np.int32)])
        self.ids[start:stop] = np.fromiter((i for f in found for i in f), np.int32, stop - start)

    def lookup(self, texts: Iterable[list[str]]) -> list[np.ndarray]:
        """For each text, given as its chunks, the rows of its chunks in order."""
        if len(self.rows) > self.entries or self.ends[len(self.rows)] > self.pool:
            self.clear()
        row, n, waiting = self.rows.__getitem__, len(self.rows), self.rows.waiting
        rows = [np.fromiter(map(row, t), np.int64, len(t)) for t in texts]
        for at in range(0, len(waiting), 4096):
            self._add(n + at, waiting[at : at + 4096])
        waiting.clear()
        return rows

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the rows one after the other, and the number of ids of each row."""
        starts = self.ends[rows]
        counts = self.ends[rows + 1] - starts
        before = np.cumsum(counts) - counts
        return self.ids[np.arange(int(counts.sum())) + np.repeat(starts - before, counts)], counts
