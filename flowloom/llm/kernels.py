"""Vectorised text kernels on whole Arrow columns: words, hashes of ranges, windows.

Texts of a batch lie one after another in one byte array; hashes are of 64 bits.
``range_hash`` chains blocks of eight bytes through a mixing function, so no
arrangement of equal blocks cancels out; it names words, runs and windows.
``prefix_sums`` are polynomial, cheap at every place of a text, and weak on texts
made for it: they may choose where equal texts meet, but never say that texts are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Bytes of text that the kernels take at a time, so that their arrays stay in cache.
SLAB = 1 << 16
#: Bytes of a range from which it is hashed on its own.
LONG = 256
#: Keeps the first 0 to 8 bytes of a block.
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 2**64)
#: Odd factors of a window's blocks.
_FACTORS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) <= n:
        size = 1 << int(n + 1).bit_length()
        with np.errstate(over="ignore"):
            steps = np.full(size, _BASE, np.uint64)
            steps[0] = 1
            _powers = np.cumprod(steps, dtype=np.uint64)
            steps = np.full(size, _INVERSE, np.uint64)
            steps[0] = 1
            _inverses = np.cumprod(steps, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct numbers in order."""
    x = np.sort(x)
    if len(x) < 2:
        return x
    new = np.empty(len(x), bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which the polynomial of any range of ``data`` follows; see the module."""
    _grow(len(data))
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(_BYTE[data] * _powers[: len(data)], out=out[1:])
    return out


def range_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes in each [start, end); the length is part of the hash.

    Ranges of over ``LONG`` bytes are hashed one by one, all others a block at a time together.
    """
    if not len(start):
        return np.zeros(0, _U)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    blocks = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))  # the eight bytes from each place on
    size = (end - start).astype(np.int64)
    out = mix(size.astype(_U) * _U(0xD6E8FEB86659FD93) + _U(0x2545F4914F6CDD1D))
    long = np.flatnonzero(size > LONG)
    at = np.flatnonzero((size > 0) & (size <= LONG)) if len(long) else np.flatnonzero(size > 0)
    place, left, h = np.asarray(start)[at].astype(np.int64), size[at], out[at]
    while len(at):
        h = mix(h ^ (blocks[place] & _MASK[np.minimum(left, 8)]))
        out[at] = h
        more = left > 8
        at, place, left, h = at[more], place[more] + 8, left[more] - 8, h[more]
    for i in long.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def window_hash(data: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes, eight at least, from each start on; for starts that lie close together.

    Each place's eight bytes are mixed once for all windows that hold them; a window's blocks are
    then summed up, each by a factor of its own, so that their order counts.
    """
    if not len(start):
        return np.zeros(0, _U)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    mixed = mix(np.ndarray(len(data) + 1, "<u8", padded, 0, (1,)))
    out = np.zeros(len(start), _U)
    for factor, at in zip(_FACTORS, [*range(0, size - 8, 8), size - 8], strict=False):
        out += mixed[start + at] * factor
    return mix(out)


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all, or too large for one
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    kind = pa.large_binary()
    column = column.cast(pa.large_string()).cast(kind) if pa.types.is_string(column.type) else column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slabs(data: np.ndarray, offsets: np.ndarray, size: int = SLAB) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``size`` bytes: first, last + 1, their bytes and offsets."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def lower_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


LOWER = lower_table()
#: The bytes that part words: space and the five ASCII control characters from tab to return.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def words(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of words before each text."""
    n = len(data)
    inner = ~parts[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = inner[:-1]
    start = np.flatnonzero(inner & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inner[1:]
    end = np.flatnonzero(inner & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)
