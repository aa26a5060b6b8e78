"""Vectorised hashes over the bytes of whole Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

P = np.uint64(0x5851F42D4C957F2D)
P_INV = np.uint64(pow(0x5851F42D4C957F2D, -1, 2**64))
K1, K2, K3, K4, K5 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_powers: dict[str, np.ndarray] = {}


def _bytes_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, 256, dtype=np.uint64)


PLAIN = _bytes_table(11)
OTHER = _bytes_table(12)
FOLDED = PLAIN.copy()
FOLDED[65:91] = PLAIN[97:123]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64, for i < n; kept for the worker."""
    if "p" not in _powers or len(_powers["p"]) < n:
        for name, base in (("p", P), ("q", P_INV)):
            a = np.full(max(n, 1 << 16), base, np.uint64)
            a[0] = 1
            _powers[name] = np.cumprod(a)
    return _powers["p"][:n], _powers["q"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; nulls are empty. Both begin at 0."""
    col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def values(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent numbers for each token: a byte, or a word's hash."""
    return (PLAIN[tokens], OTHER[tokens]) if tokens.dtype == np.uint8 else (tokens, mix(tokens ^ K2))


def prefix(numbers: np.ndarray) -> np.ndarray:
    """Running sums: the polynomial of numbers[a:b] is (out[b] - out[a]) * P**-a."""
    out = np.zeros(len(numbers) + 1, np.uint64)
    np.cumsum(numbers * powers(len(numbers))[0], out=out[1:])
    return out


def places(i: np.ndarray) -> np.ndarray:
    """A random odd factor for each place in a word, so that no pattern of letters cancels out as it can with powers."""
    if "place" not in _powers:
        _powers["place"] = mix(np.arange(1, 257, dtype=np.uint64) * K2) | np.uint64(1)
    near = _powers["place"]
    if not len(i) or i.max() < len(near):
        return near[i]
    return mix((i + 1).astype(np.uint64) * K2) | np.uint64(1)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each document's first word, one more at the end). A-Z count as a-z."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = SPACE[raw]
    solid = ~space
    first, last = solid.copy(), solid.copy()
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    inside = offsets[:-1][np.diff(offsets) > 0]
    first[inside] = solid[inside]
    ends_at = offsets[1:][np.diff(offsets) > 0] - 1
    last[ends_at] = solid[ends_at]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(a):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    size = b - a
    letters = FOLDED[raw[solid]]  # of all words, one after the other
    starts = np.cumsum(size) - size
    at = np.arange(len(letters), dtype=np.int32 if len(letters) < 2**31 else np.int64)
    at -= np.repeat(starts.astype(at.dtype), size)
    letters *= places(at)
    return mix(np.add.reduceat(letters, starts) + size.astype(np.uint64) * K1), np.searchsorted(a, offsets)


def shingle_sets(col: pa.Array, size: int = 4) -> list[np.ndarray]:
    """Each document's distinct shingles as rising 64-bit hashes; with fewer words, the whole sequence as one."""
    w, at = words(*column_bytes(col))
    keys = (K1, K2, K3, K4, K5)
    m = max(0, len(w) - size + 1)
    s = np.zeros(m, np.uint64)
    for i in range(size):
        s = mix(s + w[i : i + m] * keys[i % 5])
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            x = np.sort(s[a : b - size + 1])
            new = x[1:] != x[:-1]
            out.append(x if new.all() else x[np.concatenate([[True], new])])
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for i in range(a, b):
                h = mix(h * K5 + w[i : i + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
