"""NumPy kernels on Arrow text columns, used inside Arrow-batched tasks: words, word shingles and lines of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; larger only for a single unbroken word or line.
SEGMENT = 1 << 19
_ODD = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Multipliers of the words of a shingle; odd, fixed.
_SLOT = np.array([pow(0xD6E8FEB86659FD93, 2 * j + 3, 1 << 64) for j in range(16)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; changes h in place."""
    high = h >> np.uint64(33)
    h ^= high
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h *= np.uint64(factor)
        h ^= np.right_shift(h, np.uint64(33), out=high)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _ODD and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SEGMENT + 4096)
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (np.uint64(_ODD), np.uint64(pow(_ODD, -1, 1 << 64)))]
    return _POWERS[0][:n], _POWERS[1][:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def segments(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray, size: int = SEGMENT):
    """Ranges of about `size` bytes that end where a text ends or behind a byte that breaks."""
    at, end = 0, len(data)
    while at < end:
        to = min(at + size, end)
        if to < end:
            text_end = offsets[np.searchsorted(offsets, to)]
            while to < text_end:
                near = np.flatnonzero(breaks[data[to : min(to + 65536, text_end)]])
                if len(near):
                    to += near[0] + 1
                    break
                to = min(to + 65536, text_end)
        yield at, to
        at = to


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, A-Z lowered, and bounds: words of text t are bounds[t] to bounds[t + 1]."""
    hashes, places = [], []
    for a, b in segments(data, offsets, _SPACE):
        part = _LOWER[data[a:b]]
        n = len(part)
        inside = ~_SPACE[part]
        first = np.zeros(n + 1, bool)
        cuts = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, "right")] - a
        first[cuts] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | first[1:n]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | first[1:n]
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
        up, down = powers(n)
        total = part.astype(np.uint64)
        total += np.uint64(1)
        total *= up
        np.cumsum(total, out=total)
        h = total[ends]
        h[starts > 0] -= total[starts[starts > 0] - 1]
        h *= down[starts]
        hashes.append(mix(h))
        places.append(starts + a)
    h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    at = np.concatenate(places) if places else np.empty(0, np.int64)
    return h, np.searchsorted(at, offsets)


def shingle_sets(column: pa.Array, width: int):
    """Yields (row, sorted distinct 64-bit hashes) of the word shingles of each text.

    A text with fewer than `width` words has one shingle, the whole sequence; one without words has none.
    """
    data, offsets = text_buffer(column)
    # texts are taken in runs of about SEGMENT bytes, so that a batch of any size needs little memory
    row, n = 0, len(offsets) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SEGMENT, "right")) - 1)
        h, bounds = word_hashes(data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row])
        m = len(h) - width + 1
        s = np.zeros(max(m, 0), np.uint64)
        for j in range(width if m > 0 else 0):
            s += h[j : j + m] * _SLOT[j]
        mix(s)
        for i in range(to - row):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if b - a >= width:
                yield row + i, np.unique(s[a : b - width + 1])
            elif b > a:
                yield row + i, mix(np.array([(h[a:b] * _SLOT[: b - a]).sum() + np.uint64(b - a)], np.uint64))
            else:
                yield row + i, np.empty(0, np.uint64)
        row = to


def chunks(column: pa.Array, size: int = SEGMENT):
    """(first row, text bytes, offsets) of runs of whole texts of about `size` bytes."""
    data, offsets = text_buffer(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to
