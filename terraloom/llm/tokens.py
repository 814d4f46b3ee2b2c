"""Vectorised word kernel shared by the text operators.

Arrow string buffers are read in place as bytes; word boundaries, word
fingerprints and fingerprints of word windows are computed with numpy over
chunks of about half a megabyte, so no Python object is made per word and the
memory of a worker doesn't depend on the size of its partition.

A word is a maximal run of bytes other than ASCII white space. Fingerprints
are 64-bit polynomial hashes over randomised byte codes, finished by a mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK_BYTES = 1 << 19
_WS = np.zeros(256, dtype=bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[95] = True
_LETTER[128:] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_LOWER = _CODE.copy()
_LOWER[65:91] = _CODE[97:123]
np.seterr(over="ignore")  # products wrap on purpose
_BASE, _WBASE = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def _inverse(x: U) -> U:
    y = U(1)
    for _ in range(6):
        y = y * (U(2) - x * y)
    return y


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: U):
        self.base, self.n = base, 0
        self.up = self.down = np.zeros(0, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            for name, b in (("up", self.base), ("down", _inverse(self.base))):
                a = np.full(n, b, U)
                a[0] = 1
                setattr(self, name, np.cumprod(a))
            self.n = n
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_BASE), _Powers(_WBASE)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3, on unsigned 64-bit arrays."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets in bytes) for runs of rows of about size bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a, n = 0, len(column)
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of all rows, and the index of each row's first word (one more at the end)."""
    return _runs(~_WS[raw], offsets)


def letter_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for runs of letters, digits, underscores and bytes beyond ASCII."""
    return _runs(_LETTER[raw], offsets)


def _runs(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(solid)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    before = np.zeros(n + 1, bool)
    before[1:] = solid
    edge = before.copy()
    edge[offsets[:-1]] = False
    starts = np.flatnonzero(solid & ~edge[:n])
    after = np.zeros(n + 1, bool)
    after[:n] = solid
    after[offsets[1:]] = False
    ends = np.flatnonzero(solid & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit fingerprint for each word."""
    if not len(starts):
        return np.zeros(0, U)
    up, down = _BYTES.get(1 << max(19, int(len(raw)).bit_length()))
    c = np.zeros(len(raw) + 1, U)
    np.cumsum((_LOWER if lower else _CODE)[raw] * up[: len(raw)], out=c[1:])
    return mix((c[ends] - c[starts]) * down[starts])


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of all windows of k consecutive words, the rows not yet told apart."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    up, down = _WORDS.get(1 << max(17, int(len(words)).bit_length()))
    c = np.zeros(len(words) + 1, U)
    np.cumsum(words * up[: len(words)], out=c[1:])
    return mix((c[k:] - c[:n]) * down[:n] + U(k))


def row_of(first: np.ndarray) -> np.ndarray:
    """The row that each word belongs to, from the index of each row's first word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
