"""Vectorised word and shingle hashing over Arrow string columns.

A word is hashed by XXH64, of all words of a segment at once. Texts are cut into segments at white space, so that memory is bounded whatever the length
of a text, but for one longer word.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from lakeproof.llm import _xxh64

SEGMENT = 1 << 18
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits (splitmix64), in a new array."""
    x = x + U(0x9E3779B97F4A7C15)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    white = np.zeros(256, bool)
    white[[32, 9, 10, 11, 12, 13]] = True
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = letter[128:] = True
    return lower, ~white, letter


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes, without those of nulls, and n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(column):
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, name: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a few MB of text each, or a single longer text."""
    offsets = text_bytes(batch.column(name))[1]
    at = 0
    while at < len(batch):
        end = int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1
        end = min(max(end, at + 1), len(batch))
        yield batch.slice(at, end - at)
        at = end


def spans(column: pa.Array, segment: int, letters: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The words of all rows in order, some ``segment`` bytes of text at a time: bytes with A-Z lower-cased, and each word's row, start and end in these.

    Words are runs without white space, or with ``letters`` runs of ASCII letters and non-ASCII bytes. Eight bytes follow the text.
    """
    lower, solid, letter = _tables()
    solid = letter if letters else solid
    data, offsets = text_bytes(column)
    n, at = len(data), 0
    while at < n:
        end = min(n, at + segment)
        if end < n and (k := np.searchsorted(offsets, end, "right") - 1) and offsets[k] > at:
            end = int(offsets[k])
        else:  # a text longer than a segment is cut behind a character that is in no word
            limit = min(n, int(offsets[np.searchsorted(offsets, at, "right")]))
            end = min(limit, end)
            while end < limit:
                gaps = np.flatnonzero(~solid[data[end : end + 65536]])
                if len(gaps):
                    end = min(limit, end + int(gaps[0]) + 1)
                    break
                end = min(limit, end + 65536)
        part = np.zeros(end - at + 8, np.uint8)
        np.take(lower, data[at:end], out=part[:-8])
        word = solid[data[at:end]]
        edge = np.zeros(end - at + 1, bool)
        edge[0] = edge[-1] = True
        edge[offsets[np.searchsorted(offsets, at, "left") : np.searchsorted(offsets, end, "right")] - at] = True
        starts = np.flatnonzero(word & (edge[:-1] | np.concatenate(([True], ~word[:-1]))))
        ends = np.flatnonzero(word & (edge[1:] | np.concatenate((~word[1:], [True])))) + 1
        yield part, np.searchsorted(offsets, starts + at, "right") - 1, starts, ends
        at = end


def word_hashes(column: pa.Array, letters: bool = False, prefixes: tuple[int, ...] = ()) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of all words of all rows, as :func:`spans` tells them, and n + 1 offsets of the rows into them.

    For each of ``prefixes`` another array holds the hash of each longer word's first so many bytes, 0 for the others.
    """
    parts, counts = [], np.zeros(len(column), np.int64)
    for data, rows, starts, ends in spans(column, SEGMENT, letters):
        hashes = [_xxh64.hashes(data, starts, ends)]
        for p in prefixes:
            longer = np.flatnonzero(ends - starts > p)
            some = np.zeros(len(starts), U)
            if p < 8:  # these bytes and their number are one number, so no two beginnings share a hash
                some[longer] = mix(_xxh64.eights(data)[starts[longer]] & U((1 << 8 * p) - 1) | U(p << 56))
            else:
                some[longer] = _xxh64.hashes(data, starts[longer], starts[longer] + p, seed=p)
            hashes.append(some)
        counts += np.bincount(rows, minlength=len(counts))
        parts.append(hashes)
    hashes = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, U)] * (1 + len(prefixes))
    return hashes, np.concatenate(([0], np.cumsum(counts)))


def shingle_sets(column: pa.Array, width: int = 5):
    """For each row its distinct shingles as sorted 64-bit hashes.

    A shingle is ``width`` words in a row; fewer words are one shingle as a whole; without words there is none.
    """
    (words,), offsets = word_hashes(column)
    factors = mix(np.arange(7, 7 + width, dtype=U)) | U(1)
    n = len(words)
    whole = np.zeros(max(n - width + 1, 0), dtype=U)
    for i, f in enumerate(factors):
        whole += words[i : i + len(whole)] * f
    whole = mix(whole)
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a >= width:
            s = np.sort(whole[a : b - width + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            yield mix(np.sum(words[a:b] * factors[: b - a], keepdims=True, dtype=U) + U((b - a) << 32))
        else:
            yield whole[:0]
