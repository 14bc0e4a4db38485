"""Array helpers that run inside tasks: text buffers, rolling hashes, seeds."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_MULTIPLIERS = (6364136223846793005, 2862933555777941757)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit hash."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


@functools.lru_cache(4)
def _byte_values(stream: int) -> np.ndarray:
    return np.random.default_rng(41 + stream).integers(1, 2**63, 256, dtype=np.uint64)


_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(stream: int, inverse: bool, n: int) -> np.ndarray:
    """Powers of the odd multiplier (or of its inverse) modulo 2**64, kept from call to call."""
    have = _powers.get((stream, inverse), np.ones(1, np.uint64))
    if len(have) < n:
        base = _MULTIPLIERS[stream]
        base = pow(base, -1, 2**64) if inverse else base
        out = np.empty(1 << max(10, (n - 1).bit_length()), np.uint64)
        out[0], k = 1, 1
        while k < len(out):
            out[k : 2 * k] = out[:k] * _U(pow(base, k, 2**64))
            k *= 2
        have = _powers[stream, inverse] = out
    return have[:n]


class Hashes:
    """Hash of any span of a sequence of 64-bit values, independent of where the span lies."""

    def __init__(self, values: np.ndarray, stream: int = 0):
        n = len(values)
        self.stream, self.prefix = stream, np.zeros(n + 1, np.uint64)
        np.cumsum(values * _power(stream, False, n + 1)[:n], out=self.prefix[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * _power(self.stream, True, len(self.prefix))[start])

    def windows(self, k: int) -> np.ndarray:
        """Hash of the k values from each position on."""
        n = len(self.prefix) - k
        return mix((self.prefix[k:] - self.prefix[:n]) * _power(self.stream, True, len(self.prefix))[:n])


def byte_hashes(data: np.ndarray, stream: int = 0) -> Hashes:
    return Hashes(_byte_values(stream)[data], stream)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row bounds) of the words: runs without white space, within one row."""
    ink = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = ink.copy()
    first[1:] &= ~ink[:-1] | edge[1 : len(data)]
    last = ink.copy()
    last[:-1] &= ~ink[1:] | edge[1 : len(data)]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def word_values(data: np.ndarray, start: np.ndarray, end: np.ndarray, stream: int = 0) -> np.ndarray:
    """A 64-bit value for each word; words of unequal length differ by it too."""
    return byte_hashes(data, stream).spans(start, end) + mix((end - start).astype(np.uint64))


def seeds(hashes: Hashes, bounds: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Winnowed seeds: (position, hash, first, last window start) in order of position.

    Every window of `window` values within one row chooses its k-gram of least hash, the first of
    equals. Equal windows choose the same place, wherever they are, and each window belongs to one
    seed, whose windows are consecutive.
    """
    empty = np.zeros(0, np.int64)
    n = len(hashes.prefix) - 1
    if n < window:
        return empty, empty.astype(np.uint64), empty, empty
    grams = hashes.windows(k)
    span = window - k + 1  # k-grams in a window; their place fits in six bits
    key, width = grams & ~_U(63), 1
    while width * 2 <= span:
        key = np.minimum(key[:-width], key[width:] + _U(width))
        width *= 2
    if width < span:
        key = np.minimum(key[: len(key) - (span - width)], key[span - width :] + _U(span - width))
    inside = np.zeros(n + 1, np.int32)
    lengths = np.diff(bounds)
    whole = lengths >= window
    np.add.at(inside, bounds[:-1][whole], 1)
    np.add.at(inside, bounds[1:][whole] - window + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside)[: len(key)])
    chosen = starts + (key[starts] & _U(63)).astype(np.int64)
    head = np.ones(len(chosen), bool)
    head[1:] = chosen[1:] != chosen[:-1]
    heads = np.flatnonzero(head)
    tails = np.append(heads[1:], len(chosen)) - 1
    # Chosen hashes are small; mixed again they spread evenly.
    return chosen[heads], mix(grams[chosen[heads]] + _U(1)), starts[heads], starts[tails]


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... count[0] values, then those of the next."""
    total = int(count.sum())
    before = np.cumsum(count) - count
    return np.arange(total) - np.repeat(before, count) + np.repeat(start, count)
