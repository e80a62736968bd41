"""XXH64 of many byte ranges of one buffer at once, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
#: Longer ranges go through the library one by one.
LONG = 512
#: The five primes of the published algorithm.
P1, P2, P3, P4, P5 = (U(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * P2, 31) * P1


def _words(data: np.ndarray, dtype: str) -> np.ndarray:
    """The little-endian number that starts at each byte; ``data`` has eight bytes to spare."""
    return np.ndarray(len(data) - 7, dtype, data, 0, (1,))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as a number, the first one lowest."""
    return _words(data, "<u8")


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[start:end] for each range; ``data`` (uint8) must go on for eight bytes behind the last range."""
    size = ends - starts
    if size.max(initial=0) > LONG:
        huge = size > LONG
        out = np.zeros(len(starts), U)
        out[huge] = [xxhash.xxh64_intdigest(data[a:b].data, seed) for a, b in zip(starts[huge], ends[huge])]
        out[~huge] = hashes(data, starts[~huge], ends[~huge], seed)
        return out
    eight, four = _words(data, "<u8"), _words(data, "<u4")
    h = np.full(len(starts), np.array([seed], U) + P5, U)
    at = starts.copy()
    long_ones = np.flatnonzero(size >= 32)
    if len(long_ones):
        first = np.array([seed], U)
        acc = [np.repeat(v, len(long_ones)) for v in (first + P1 + P2, first + P2, first, first - P1)]
        stripes, pos, done = size[long_ones] >> 5, at[long_ones], 0
        live = np.arange(len(long_ones))
        while len(live):
            where = pos[live] + 32 * done
            for k in range(4):
                acc[k][live] = _round(acc[k][live], eight[where + 8 * k])
            done += 1
            live = live[stripes[live] > done]
        out = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
        for v in acc:
            out = (out ^ _round(np.zeros_like(v), v)) * P1 + P4
        h[long_ones] = out
        at[long_ones] += 32 * stripes
    h += size.astype(U)
    left = ends - at
    for k in range(3):  # at most three eights, one four and three single bytes are left
        go = np.flatnonzero(left >= 8 * (k + 1))
        h[go] = _turn(h[go] ^ _round(np.zeros(len(go), U), eight[at[go] + 8 * k]), 27) * P1 + P4
    at += left & ~7
    go = np.flatnonzero(left & 4)
    h[go] = _turn(h[go] ^ (four[at[go]].astype(U) * P1), 23) * P2 + P3
    at += left & 4
    for k in range(3):
        go = np.flatnonzero((left & 3) > k)
        h[go] = _turn(h[go] ^ (data[at[go] + k].astype(U) * P5), 11) * P1
    h ^= h >> U(33)
    h *= P2
    h ^= h >> U(29)
    h *= P3
    return h ^ (h >> U(32))
