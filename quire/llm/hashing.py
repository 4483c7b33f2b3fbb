"""Vectorised tokenising and hashing over UTF-8 bytes, shared by the window operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: White space of the word rule: bytes 32 and 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_TABLE = np.random.RandomState(7).randint(0, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (three xor-shift-multiply rounds)."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def pair(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """An order-sensitive hash of two hashes."""
    return mix(a * U64(0xA0761D6478BD642F) + (b ^ U64(0xE7037ED1A0B428DB + salt)) * U64(0x8EBC6AF09C88C6E3))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _BACK)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its offsets (one more than rows); a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def batches(off: np.ndarray, most: int = 1 << 17):
    """Runs of rows (first, end) of at most `most` bytes each, or one row; small enough for hashes to stay in a core's cache."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, b
        a = b


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the number of the first word of each row (one more than rows)."""
    solid = ~SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    inner = off[:-1][off[:-1] < len(data)]
    before[inner] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    after[inner[inner > 0] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    out = np.empty(len(starts), U64)
    for a in range(0, len(starts), 1 << 14):
        s, e = starts[a : a + (1 << 14)], ends[a : a + (1 << 14)]
        lo, hi = int(s[0]), int(e[-1])
        power, back = _pow(hi - lo + 1)
        total = np.zeros(hi - lo + 1, U64)
        np.cumsum(_TABLE[data[lo:hi]] * power[: hi - lo], out=total[1:])
        s, e = s - lo, e - lo
        out[a : a + len(s)] = mix((total[e] - total[s]) * back[s] + (e - s).astype(U64))
    return out


def runs_of(h: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """The hash of each run of `size` values that follow one another (len(h) - size + 1 of them), by doubling."""
    if len(h) < size:
        return np.zeros(0, U64)
    n, at, width, out, part = len(h) - size + 1, 0, 1, None, h
    while at < size:
        if (size >> (width.bit_length() - 1)) & 1:
            piece = part[at : at + n]
            out = piece if out is None else pair(out, piece, salt)
            at += width
        if at < size:
            part, width = pair(part[:-width], part[width:], salt), width * 2
    return mix(out + U64(size)) if out is not h else mix(h + U64(size))


def byte_windows(data: np.ndarray, size: int, anchor: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each `size`-byte string of the data (size >= 16), from overlapping power-of-two parts, and on the way that of each `anchor`-byte string (a power of two from 8, below size)."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, U64)
    part = mix(eights(data))
    width, short = 8, part[:0]
    while width * 2 <= size:
        short = part if width == anchor else short
        part, width = pair(part[:-width], part[width:]), width * 2
    short = part if width == anchor else short
    out, at = part[:n], width
    while at < size:  # the same width again, laid so that it ends where the string ends
        step = min(width, size - at)
        out, at = pair(out, part[at + step - width : at + step - width + n]), at + step
    return out, short


def eight_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each of these places as one integer that sorts as they do; eight bytes must follow the last."""
    return np.lib.stride_tricks.as_strided(data, (max(0, len(data) - 7), 8), (1, 1))[at].view(">u8").ravel().astype(U64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, as one integer."""
    return np.lib.stride_tricks.as_strided(np.frombuffer(data.tobytes(), np.uint8)[: len(data)], (len(data) - 7, 8), (1, 1)).copy().view("<u8").ravel()


def sliding_min(h: np.ndarray, size: int) -> np.ndarray:
    """The least of each run of `size` values."""
    n, width, least = len(h) - size + 1, 1, h
    if n <= 0:
        return h[:0]
    while width * 2 <= size:
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    return np.minimum(least[:n], least[size - width : size - width + n])
