"""Words and lines of a batch of texts as numpy arrays.

A batch of texts is one UTF-8 buffer with offsets, so splitting, counting and hashing are a few
array passes over all texts of a slice at once and no Python object is made for a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once in a task; a longer single text is a slice of its own.
SLICE_BYTES = 1 << 20

_U = np.uint64
_STEP = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def numbers(n: int, seed: int = 0) -> np.ndarray:
    """`n` fixed pseudo-random 64-bit numbers, the same in every process."""
    with np.errstate(over="ignore"):
        return mixed((np.arange(1, n + 1, dtype=_U) + _U(seed) * _U(1 << 32)) * _U(_STEP))


_BYTE = numbers(256, 1)
_BASE = 0xD1342543DE82EF95
_UNBASE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base, and of its inverse, from the 0th to the nth."""
    if not _POWERS or len(_POWERS[0]) <= n:
        _POWERS[:] = []
        for base in (_BASE, _UNBASE):
            step = np.full(max(n + 1, SLICE_BYTES + 1), base, dtype=_U)
            step[0] = 1
            _POWERS.append(np.multiply.accumulate(step))
    return _POWERS


def byte_set(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


#: What ends a word: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = byte_set(b" \t\n\x0b\x0c\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Texts:
    """Rows `first` to `first + len(self)` of a batch; text i is `data[offsets[i]:offsets[i+1]]`."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def per_text(self, at: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """Sums by text of what lies at the ascending byte positions `at`."""
        ends = np.searchsorted(at, self.offsets)
        if weights is None:
            return np.diff(ends)
        return np.diff(np.concatenate([[0], np.cumsum(weights)])[ends])

    def count(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text are in `mask`."""
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return np.diff(total[self.offsets])


@dataclass
class Runs:
    """Maximal runs of bytes: words or lines, in text order."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library than glibc
    _trim = None


_passed = 0
#: Bytes of text after which a worker gives free memory back; it also does at the end of a task.
GIVE_BACK_BYTES = 8 << 20


def give_back() -> None:
    """Free memory that the allocators of this worker hold on to goes back to the machine."""
    global _passed
    _passed = 0
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def texts_of(column: pa.Array, slice_bytes: int = SLICE_BYTES) -> Iterator[Texts]:
    """Slices of a string column, whole texts each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + slice_bytes, "right")) - 1
        to = min(max(to, at + 1), len(column))
        own = offsets[at:to + 1]
        yield Texts(at, data[own[0]:own[-1]], own - own[0])
        at = to
    global _passed
    _passed += len(data)
    if _passed > GIVE_BACK_BYTES:
        del column, buffers, offsets, data
        give_back()


def runs(texts: Texts, ends: np.ndarray, data: np.ndarray | None = None) -> Runs:
    """Runs of bytes that are not in the byte set `ends`; they never cross texts."""
    data = texts.data if data is None else data
    inside = ~ends[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[texts.offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Runs(start, end, np.searchsorted(texts.offsets, start, "right") - 1)


def run_hashes(data: np.ndarray, of: Runs) -> np.ndarray:
    """64-bit hashes of the bytes of each run; equal bytes give equal hashes in every process."""
    if not len(of.start):
        return np.zeros(0, dtype=_U)
    up, down = _powers(len(data))
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, dtype=_U)
        np.cumsum(_BYTE[data] * up[:len(data)], out=total[1:])
        # The sum of byte value times power, as if the run began at power 0.
        own = (total[of.end] - total[of.start]) * down[of.start]
        return mixed(own + (of.end - of.start).astype(_U) * _U(_STEP))


_PLACE = numbers(64, 2) | _U(1)


def shingle_hashes(words: np.ndarray, text: np.ndarray, n_texts: int, size: int = 5):
    """Hashes of all `size`-word windows and their texts; a shorter text is one window."""
    counts = np.bincount(text, minlength=n_texts)
    first = np.concatenate([[0], np.cumsum(counts)])
    with np.errstate(over="ignore"):
        total = np.zeros(max(len(words) - size + 1, 0), dtype=_U)
        for k in range(size):
            total += words[k:k + len(total)] * _PLACE[k]
        whole = text[:len(total)] == text[size - 1:] if len(total) else np.zeros(0, bool)
        hashes, owner = mixed(total[whole] + _U(size)), text[:len(total)][whole]
        short = np.flatnonzero((counts > 0) & (counts < size))
        own = np.zeros(len(short), dtype=_U)
        for k in range(size - 1):
            has = counts[short] > k
            own[has] += words[first[short[has]] + k] * _PLACE[k]
        own = mixed(own + counts[short].astype(_U))
    return np.concatenate([hashes, own]), np.concatenate([owner, short])
