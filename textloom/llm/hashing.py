"""Vectorised fingerprints of words, shingles and byte strings (numpy, 64-bit wrap-around).

All functions are deterministic across processes and machines: the random tables come from a
fixed seed, so a task that is run again on another executor produces the same values.
"""

from __future__ import annotations

import numpy as np
import zstandard

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 2**64))
SHINGLE_BASE = U64(0xD6E8FEB86659FD93)
SHINGLE_BASE_2 = U64(0xA0761D6478BD642F)

#: bytes of [\x20\x09-\x0D]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing: digits, a-z, all of non-ASCII
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 1 << 16)
        _pow, _inv = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (_BASE, _BASE_INV))
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of the public splitmix64 generator; a bijection on 64 bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def spans(raw: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not separators."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~separator[raw]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each raw[start:end]."""
    power, inverse = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_CODE[raw] * power[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def blocks(texts: list[bytes], size: int = 1 << 18):
    """Slices of texts of about size bytes in all: (first, last + 1)."""
    first = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def words(texts: list[bytes], separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words of all texts, and for each the index of its text."""
    hashes, owner = [], []
    for lo, hi in blocks(texts):
        raw = np.frombuffer(b"\n".join(texts[lo:hi]), np.uint8)
        s, e = spans(raw, separator)
        hashes.append(span_hashes(raw, s, e))
        offsets = np.cumsum([len(t) + 1 for t in texts[lo:hi]])
        owner.append(np.searchsorted(offsets, s, side="right").astype(np.int64) + lo)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owner)


def windows(h: np.ndarray, n: int, base: np.uint64 = SHINGLE_BASE) -> np.ndarray:
    """Fingerprints of each n consecutive entries of h."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m].copy()
    for j in range(1, n):
        out *= base
        out += h[j : j + m]
    return mix(out)


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, ascending. (np.unique without counts goes by a hash table, some ten times as slow.)"""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def pack(x: np.ndarray) -> bytes:
    """A compact form of an array of ascending integers: byte planes of the differences."""
    d = np.diff(x.astype(np.uint64), prepend=U64(0))
    return zstandard.ZstdCompressor(level=1).compress(d.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).reshape(-1), dtype=np.uint64)


def pack_any(x: np.ndarray) -> bytes:
    """A compact form of any array of 8-byte integers."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_any(b: bytes, kind=np.int64) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(kind).reshape(-1)


def pack_repeated(x: np.ndarray) -> bytes:
    """A compact form of 8-byte integers of which each occurs many times: the distinct ones, and which."""
    values, at = np.unique(x.astype(np.uint64), return_inverse=True)
    first = pack(values)
    return len(first).to_bytes(8, "little") + first + pack_any(at.astype(np.uint64))


def unpack_repeated(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    return unpack(b[8 : 8 + n])[unpack_any(b[8 + n :])].view(np.int64)


def slice_edges(ascending: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal ranges of the 64-bit space begins in an ascending array; n + 1 entries."""
    bounds = np.array([(i << 64) // n for i in range(n)], np.uint64)
    return np.append(np.searchsorted(ascending, bounds), len(ascending))
