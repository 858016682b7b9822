"""Vectorised hash kernels over Arrow batches of text.

All hashes are 64 bits wide and only steer candidate search; every result that depends on them is
confirmed on the texts themselves. Work is cut into pieces of about PIECE bytes, so memory does not
follow the length of a text.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 20
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_WORD = np.zeros(256, dtype=bool)
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_":
    _WORD[_c] = True
_POWERS = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE**i modulo 2**64 for i < n, kept between calls."""
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 1024)
        grown = np.full(size, _BASE, dtype=np.uint64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * _STEP
    h = h ^ (h >> np.uint64(29))
    h = h * _BASE
    return h ^ (h >> np.uint64(32))


def _hash_piece(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words in one run of bytes."""
    inside = _WORD[codes]
    at = np.flatnonzero(inside)
    if not len(at):
        return at, np.zeros(0, dtype=np.uint64)
    first = np.empty(len(at), dtype=bool)
    first[0] = True
    np.not_equal(at[1:], at[:-1] + 1, out=first[1:])
    heads = np.flatnonzero(first)
    starts = at[heads]
    lengths = np.diff(np.append(heads, len(at)))
    relative = at - np.repeat(starts, lengths)
    values = _BYTE[codes[at]] * powers(int(lengths.max()))[relative]
    return starts, mix(np.add.reduceat(values, heads) + lengths.astype(np.uint64))


def _pieces(data: bytes):
    """Offsets that cut data into pieces which end outside a word."""
    start, n = 0, len(data)
    while start < n:
        end = min(n, start + PIECE)
        while end < n and _WORD[data[end]]:
            end += 1
        yield start, end
        start = end


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [A-Za-z0-9_]+ of all texts in order, and the offsets of each text's words."""
    encoded = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join(encoded)
    ends = np.cumsum([len(e) + 1 for e in encoded]) if encoded else np.zeros(0, dtype=np.int64)
    codes = np.frombuffer(data, dtype=np.uint8)
    starts, hashes = [], []
    for a, b in _pieces(data):
        s, h = _hash_piece(codes[a:b])
        starts.append(s + a)
        hashes.append(h)
    where = np.concatenate(starts) if starts else np.zeros(0, dtype=np.int64)
    words = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    offsets[1:] = np.searchsorted(where, ends)
    return words, offsets


def shingle_sets(texts: list, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the runs of k consecutive words of each text, with offsets."""
    words, offsets = word_hashes(texts)
    if len(words) < k:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    n = len(words) - k + 1
    h = words[:n].copy()
    for i in range(1, k):
        h *= _STEP
        h += words[i : i + n]
    h = mix(h)
    sets, out = [], np.zeros(len(texts) + 1, dtype=np.int64)
    for i in range(len(texts)):
        a, b = offsets[i], offsets[i + 1] - k + 1
        if b > a:
            s = np.sort(h[a:b])
            keep = np.empty(len(s), dtype=bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            s = s[keep]
            sets.append(s)
            out[i + 1] = len(s)
    return (np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)), np.cumsum(out)


def window_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the bytes codes[s:e] for the ascending starts and ends (Karp-Rabin over prefix sums, in pieces)."""
    out = np.empty(len(starts), dtype=np.uint64)
    a = 0
    while a < len(starts):
        base = int(starts[a])
        b = int(np.searchsorted(starts, base + PIECE))
        span = codes[base : int(ends[a:b].max())]
        n = len(span)
        p = powers(n + 1)
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[span] * p[:-1], out=prefix[1:])
        s, e = starts[a:b] - base, ends[a:b] - base
        # scaled to a common power, so equal windows agree wherever they stand in any text
        out[a:b] = mix((prefix[e] - prefix[s]) * p[n - s] * _down(n) + (e - s).astype(np.uint64))
        a = b
    return out


def _down(n: int) -> np.uint64:
    """BASE**-n modulo 2**64."""
    return np.uint64(pow(pow(int(_BASE), -1, 1 << 64), n, 1 << 64))
