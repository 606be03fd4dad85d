"""Words of whole texts as numpy arrays: runs of bytes of one kind, a chunk of Arrow batches at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that a task works on at a time; its arrays take some thirty times as much.
CHUNK = 8 << 20

#: Lower case for A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[pa.Table]:
    """Batches put together until they hold `size` bytes."""
    held, room = [], size
    for batch in batches:
        held.append(batch)
        room -= batch.nbytes
        if room <= 0:
            yield pa.Table.from_batches(held)
            held, room = [], size
    if held:
        yield pa.Table.from_batches(held)


def joined(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, where each text begins and the last one ends); texts have no nulls."""
    a = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    a = a.cast(pa.large_string())
    if not len(a):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = a.buffers()
    at = np.frombuffer(at, np.int64)[a.offset : a.offset + len(a) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


@dataclass(frozen=True)
class Runs:
    """Maximal runs of marked bytes; none crosses the end of a text."""

    start: np.ndarray
    length: np.ndarray
    text: np.ndarray
    #: the bytes of all runs, one after the other, and where each begins there
    data: np.ndarray
    at: np.ndarray

    @staticmethod
    def of(b: np.ndarray, ends: np.ndarray, marked: np.ndarray) -> Runs:
        inner = ends[(ends > 0) & (ends < len(b))]
        after = np.zeros(len(b) + 1, bool)
        after[1:] = marked
        after[inner] = False
        start = np.flatnonzero(marked & ~after[:-1])
        before = np.zeros(len(b) + 1, bool)
        before[:-1] = marked
        before[inner] = False
        stop = np.flatnonzero(marked & ~before[1:]) + 1
        length = stop - start
        at = np.zeros(len(start) + 1, np.int64)
        np.cumsum(length, out=at[1:])
        return Runs(start, length, np.searchsorted(ends, start, side="right") - 1, b[marked], at)

    def strings(self, which: np.ndarray | None = None) -> pa.Array:
        """The runs, or those of a mask, as Arrow strings."""
        if which is None:
            return _strings(self.data, self.at)
        at = np.zeros(int(which.sum()) + 1, np.int64)
        np.cumsum(self.length[which], out=at[1:])
        return _strings(self.data[np.repeat(which, self.length)], at)


def _strings(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(np.ascontiguousarray(data)))
