"""Vectorised byte and word kernels, run inside Arrow batches.

A polynomial hash over Z/2^64 with an odd base lets one prefix sum give the hash of any byte range:
``H(s, e) = (P[e] - P[s]) * base**-s``; a bijective mixer then spreads its bits. Such hashes serve ranges of a few hundred
bytes: strings that collide under every base (Thue-Morse words) have 1,024 bytes at least. Words and longer ranges are
hashed block by block with the mixer in between, or by BLAKE2.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        base = BASES[which]

        def run(b: int) -> np.ndarray:
            out = np.full(size, b, U)
            out[0] = 1
            return np.cumprod(out, dtype=U)

        have = (run(base), run(pow(base, -1, 1 << 64)))
        if size <= 1 << 21:  # tables for very long texts are not kept
            _powers[which] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits look random."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix(data: np.ndarray, which: int = 0) -> np.ndarray:
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(len(data), which)[0], out=out[1:])
    return out


def range_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Mixed hash of the ranges [start, end); the length is part of it."""
    inv = powers(len(pre), which)[1]
    return mix((pre[end] - pre[start]) * inv[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i+w]) for each i, in three passes whatever w is."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    if w == 1:
        return x
    pad = -len(x) % w
    full = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(full, axis=1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


_HEADS = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)


def word_hash(d: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [start, end), eight bytes a step; what is longer than 64 bytes goes by BLAKE2."""
    out = mix((end - start).astype(U) + U(0x9E3779B97F4A7C15))
    if not len(start):
        return out
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate([d, np.zeros(8, np.uint8)]), 8)
    live, at = np.arange(len(start)), start
    for _ in range(8):
        left = end[live] - at
        out[live] = mix(out[live] * U(0xD6E8FEB86659FD93) ^ (eights[at].view("<u8").ravel() & _HEADS[np.minimum(left, 8)]))
        more = left > 8
        live, at = live[more], at[more] + 8
        if not len(live):
            return out
    for i in live.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(d[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def words(data: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, the n+1 offsets of each row's words, and each word's first byte."""
    if len(data) == 0:
        return np.zeros(0, U), np.zeros(len(off), np.int64), np.zeros(0, np.int64)
    d = LOWER[data] if lower else data
    solid = ~SPACE[d]
    edge = np.zeros(len(d) + 1, bool)
    edge[off] = True
    before = np.empty(len(d), bool)
    before[0] = False
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(d), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    h = word_hash(d, start, end)
    return h, np.searchsorted(start, off), start


def shingles(h: np.ndarray, off: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the q-word shingles of each row in order, and their offsets. A row with 1 to q-1 words has one
    shingle, its whole sequence; a row without words has none."""
    n = np.diff(off)
    many = np.where(n >= q, n - q + 1, np.minimum(n, 1))
    out_off = np.concatenate([[0], np.cumsum(many)])
    first = np.repeat(off[:-1] - out_off[:-1], many) + np.arange(out_off[-1])
    last = np.repeat(off[1:], many)
    acc = np.zeros(len(first), U)
    for j in range(q):
        at = first + j
        ok = at < last
        acc = acc * U(0x9E3779B97F4A7C15) + np.where(ok, h[np.where(ok, at, 0)] if len(h) else U(0), U(j + 1))
    return mix(acc), out_off
