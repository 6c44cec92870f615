"""Vectorised tokenising: the words of many texts at once, as 64-bit hashes, straight from Arrow's UTF-8 buffer."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

_U = np.uint64
_RNG = np.random.default_rng(20240229)
#: Of each byte, a random 64-bit number; a word's hash is their sum times powers of _R, then mixed.
_CODE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_R = int(_RNG.integers(0, 2**62)) * 4 + 3
_R_INV = pow(_R, -1, 2**64)

#: Byte classes: what belongs to a word.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII letters and digits, and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** (0..n-1) modulo 2**64; kept, and grown by a quarter at least."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16, len(have) * 5 // 4 if have is not None else 0)
        out = np.full(size, base, _U)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        _powers[base] = have = out
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Words(NamedTuple):
    """Words of a batch in order: the row of each, byte bounds in the buffer, hash; first[i]:first[i + 1] are row i's."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    total: np.ndarray  # running sums, from which any substring's hash follows

    def prefixes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of the first n bytes of each word that is longer."""
        long = self.end - self.start > n
        start = self.start[long]
        h = (self.total[start + n] - self.total[start]) * _power(_R_INV, len(self.total))[start]
        return self.row[long], mix(h ^ _U(0x5851F42D4C957F2D * n % 2**64))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null is empty."""
    if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
        kind = np.int32
    elif pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        return utf8(col.cast(pa.large_string()))
    if col.null_count:
        col = pa.compute.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    n = len(col)
    _, offsets, data = col.buffers()
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def words(col: pa.Array, inside: np.ndarray = NOT_SPACE, fold: bool = True) -> Words:
    """The maximal runs of `inside` bytes of each text, hashed with A-Z as a-z if fold; no word spans two texts."""
    buf, off = utf8(col)
    n = len(buf)
    if not n:
        e = np.zeros(0, np.int64)
        return Words(e, e, e, e.astype(_U), np.zeros(len(off), np.int64), np.zeros(1, _U))
    w = inside[buf]
    begins = w.copy()
    begins[1:] &= ~w[:-1]
    edge = off[:-1][off[:-1] < n]
    begins[edge] = w[edge]
    ends = w.copy()
    ends[:-1] &= ~w[1:]
    last = off[1:][off[1:] > 0] - 1
    ends[last] = w[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    codes = _CODE[LOWER] if fold else _CODE
    total = np.zeros(n + 1, _U)
    np.cumsum(np.where(w, codes[buf], _U(0)) * _power(_R, n), out=total[1:])
    h = mix((total[end] - total[start]) * _power(_R_INV, n)[start])
    first = np.searchsorted(start, off)
    return Words(np.searchsorted(off, start, side="right") - 1, start, end, h, first, total)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings buf[start:end], case kept."""
    total = np.zeros(len(buf) + 1, _U)
    np.cumsum(_CODE[buf] * _power(_R, len(buf)), out=total[1:])
    return mix((total[end] - total[start]) * _power(_R_INV, len(buf))[start] ^ (end - start).astype(_U))


def gram_hashes(buf: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-byte strings of buf, by start."""
    total = np.zeros(len(buf) + 1, _U)
    np.cumsum(_CODE[buf] * _power(_R, len(buf)), out=total[1:])
    return mix((total[n:] - total[:-n]) * _power(_R_INV, len(buf) + 1)[: len(buf) + 1 - n])


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of a sequence of hashes, elementwise: of n-grams, from their words' hashes."""
    out = mix(parts[0] + _U(0x9E3779B97F4A7C15))
    for p in parts[1:]:
        out = mix(out * _U(0xD6E8FEB86659FD93) + p)
    return out


def crc_mod(ids: pa.Array, m: int) -> np.ndarray:
    """crc32 of each id as text modulo m; a null id counts as the empty text."""
    import zlib

    return np.fromiter((zlib.crc32(b"" if x is None else str(x).encode()) % m for x in ids.to_pylist()), np.int64, len(ids))
