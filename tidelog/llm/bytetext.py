"""Words of many texts at once, over the UTF-8 bytes of an Arrow column, in numpy.

Non-ASCII characters are word characters in every class used here, and so is each of their bytes; for that, classes of
bytes find the same words as classes of characters.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: ASCII lower case; other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: White space is [\x20\x09-\x0D].
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

#: Longer spans are hashed one by one.
LONG_SPAN = 4096

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_PRIME = 0x9E3779B97F4A7C15 | 1


def batches(column: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of pieces of a text column; a piece has limit bytes, or one text."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
    release()


def release() -> None:
    """Give freed memory back: workers live on after a task, and their heaps would keep what large batches took."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def word_spans(mask: np.ndarray, offsets: np.ndarray, kinds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, none across texts, and for each text the number of words before it.

    kinds: runs are also parted where a byte of kind 1 and one of kind 2 meet.
    """
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, mask[:-1]
    before[edge] = False
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, mask[1:]
    after[edge - 1] = False
    if kinds is not None:
        part = (kinds[1:] ^ kinds[:-1]) == 3
        before[1:] &= ~part
        after[:-1] &= ~part
    starts, ends = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: What the k-th eight bytes of a span are mixed with, and which of the last ones belong to it.
_PLACE = mix64(np.arange(1, LONG_SPAN // 8 + 1, dtype=np.uint64) * np.uint64(_PRIME))
_LAST = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def _sums(mixed: np.ndarray, first: np.ndarray, single: bool) -> np.ndarray:
    return mixed.copy() if single else np.add.reduceat(mixed, first)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, *, wide: bool = False) -> tuple[np.ndarray, ...]:
    """64 bits for each span of data (not empty), and with wide 64 more; equal bytes have equal hashes, wherever they stand.

    Each eight bytes are mixed with their place in the span, beyond any linear relation, before they are summed up.
    """
    length = ends - starts
    if not len(starts):
        return (np.zeros(0, np.uint64),) * (2 if wide else 1)
    long = np.flatnonzero(length > LONG_SPAN)
    # A long span's sums are replaced; its first eight bytes stand in for it.
    short = length if not len(long) else np.where(length > LONG_SPAN, 8, length)
    pieces = (short + 7) >> 3
    first = np.cumsum(pieces) - pieces
    single = len(starts) == first[-1] + pieces[-1]
    place = np.arange(first[-1] + pieces[-1]) - (first if single else np.repeat(first, pieces))
    at = starts if single else np.repeat(starts, pieces) + 8 * place
    rest = short if single else np.repeat(short, pieces) - 8 * place
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))[at]
    words &= _LAST[np.minimum(rest, 8)]
    mixed = mix64(words ^ _PLACE[place])
    out = [mix64(_sums(mixed, first, single) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))]
    if wide:
        out.append(mix64(_sums(mix64(mixed + np.uint64(0x5851F42D4C957F2D)), first, single)))
    for i in long.tolist():
        whole = xxhash.xxh3_128_intdigest(data[starts[i] : ends[i]].tobytes())
        for k, column in enumerate(out):
            column[i] = whole >> 64 * k & 0xFFFFFFFFFFFFFFFF
    return tuple(out)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first 64 bits of span_hashes."""
    return span_hashes(data, starts, ends)[0]


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every so many consecutive words; windows may cross texts, which the caller rules out."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out *= np.uint64(_PRIME)
        out += hashes[k : n + k]
    return mix64(out)
