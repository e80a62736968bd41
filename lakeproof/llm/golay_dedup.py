"""SimHash near-dedup by Golay-code fuzzy hashing.

1. A text's fingerprint has the bits that more than half of its shingles' hashes have. Equal fingerprints are one node, whatever their number.
2. A fingerprint is cut into segments of 22, 21 and 21 bits. Of two fingerprints that differ in two bits at most, some segment is the same in both, and
   the segment after it (the first after the last) differs in one bit at most: errors 2, 0, 0 and 1, 1, 0 in any order leave one such place.
3. Every 23-bit word is within three bits of exactly one word of the Golay code. A segment's fuzzy keys are the 12-bit indices of the code words within four bits:
   one, or six where the nearest is three bits away. Words one bit apart share such an index (the one that decodes either of them), so a node has 3
   keys of (place, segment, index), or up to 18.
4. Nodes that share a key are verified bit by bit in that bucket, which gives a forest of links, never pairs. Nodes of a bucket with more than ``CROWD`` of them go
   another, exact way: each node names the 65 words within one bit of it, and two nodes within two bits name one in common. No word is named
   by more than 65 nodes, and all of these are linked, so it's a star.
5. Connected components of the links are the groups; a group's label is the smallest doc_id of its rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeproof.llm import _words, _xxh64
from lakeproof.llm._common import col, join_classes, near_if_small, stage_table
from lakeproof.llm._graph import components
from lakeproof.llm.near_dedup import forest, runs

U = np.uint64
#: Fixed value: the generator polynomial of the binary Golay code of length 23, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Where the segments begin, from the lowest bit, and how many bits they have.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Nodes in a bucket that are still compared with one another.
CROWD = 256
#: Bytes of text that are hashed at a time.
SEGMENT = 1 << 20


def _remainders(words: np.ndarray) -> np.ndarray:
    """Of 23-bit words as polynomials, the remainder by the generator: 0 for code words, one of 2,048 for each error of up to three bits."""
    out = words.astype(np.int64)
    for bit in range(22, 10, -1):
        out = np.where(out >> bit & 1, out ^ GENERATOR << bit - 11, out)
    return out


def _patterns() -> np.ndarray:
    """For each remainder the errors of up to four bits that leave it, padded with the first: array 2048 x 6."""
    found: list[list[int]] = [[] for _ in range(2048)]
    errors = [sum(1 << b for b in bits) for weight in range(5) for bits in itertools.combinations(range(23), weight)]
    for error, rest in zip(errors, _remainders(np.array(errors)).tolist()):
        found[rest].append(error)
    return np.array([e + [e[0]] * (6 - len(e)) for e in found])


PATTERNS = _patterns()


def golay_indices(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word the indices, 12 bits, of the code words within four bits: array n x 6, the nearest first and instead of missing ones."""
    return (words[:, None] ^ PATTERNS[_remainders(words)]) >> 11


def fuzzy_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each fingerprint's distinct keys: place, segment and fuzzy index of the segment after it."""
    cut = [(fingerprints >> U(at) & U((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    rows, keys = [], []
    for place, segment in enumerate(cut):
        index = golay_indices(cut[(place + 1) % len(cut)])
        new = np.concatenate((np.ones((len(index), 1), bool), index[:, 1:] != index[:, :1]), axis=1)
        row, at = np.nonzero(new)
        rows.append(row)
        keys.append((place << 34 | segment[row] << 12) | index[row, at])
    return np.concatenate(rows), np.concatenate(keys)


#: For each byte eight counters of eight bits, one for each of its bits.
_SPREAD = sum((np.arange(256, dtype=U) >> U(k) & U(1)) << U(8 * k) for k in range(8))


def _one_bits(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For runs of hashes that begin at ``edges`` how many have each bit: array n x 64, the lowest bit first."""
    sizes = np.diff([*edges, len(hashes)])
    parts = (sizes + 254) // 255  # of which no counter runs over
    first = np.cumsum(parts) - parts
    within = np.repeat(edges, parts) + 255 * (np.arange(int(parts.sum())) - np.repeat(first, parts))
    counts = np.add.reduceat(_SPREAD[hashes.astype("<u8").view(np.uint8).reshape(-1, 8)], within, axis=0)
    return np.add.reduceat(counts.astype("<u8").view(np.uint8).reshape(-1, 64), first, axis=0, dtype=np.int64)


class _Counter:
    """Bit counts of all shingles of each row, from its words segment by segment."""

    def __init__(self, rows: int, width: int):
        self.width = width
        self.bits, self.shingles = np.zeros((rows, 64), np.int64), np.zeros(rows, np.int64)
        self.row, self.held = -1, []  # the row that may go on, and the last words of it that further shingles begin with

    def add(self, data: np.ndarray, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """More words in the order of the texts: data[start:end] is a word of ``row``."""
        if not len(starts):
            return
        if rows[0] != self.row:
            self._over()
        sizes = np.concatenate(([len(w) for w in self.held], ends - starts)).astype(np.int64)
        rows = np.concatenate((np.full(len(self.held), self.row), rows))
        # all words again, each behind a single space, so that a shingle is one range
        at = np.cumsum(sizes + 1) - sizes
        flat = np.full(int(at[-1] + sizes[-1]) + 8, 32, np.uint8)
        held = np.frombuffer(b" ".join([b"", *self.held]), np.uint8)
        flat[: len(held)] = held
        size, to = sizes[len(self.held) :], at[len(self.held) :]
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        flat[inside + np.repeat(to, size)] = data[inside + np.repeat(starts, size)]
        last = np.arange(self.width - 1, len(rows))
        last = last[rows[last] == rows[last - self.width + 1]]
        self._tally(_xxh64.hashes(flat, at[last - self.width + 1], at[last] + sizes[last]), rows[last])
        edge = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1], [True])))
        few = np.flatnonzero((np.diff(edge) < self.width) & (rows[edge[:-1]] != rows[-1]) & (self.shingles[rows[edge[:-1]]] == 0))
        self._tally(_xxh64.hashes(flat, at[edge[few]], at[edge[few + 1] - 1] + sizes[edge[few + 1] - 1]), rows[edge[few]])
        self.row = int(rows[-1])
        self.held = [flat[at[k] : at[k] + sizes[k]].tobytes() for k in range(max(int(edge[-2]), len(rows) - self.width + 1), len(rows))]

    def _tally(self, hashes: np.ndarray, rows: np.ndarray) -> None:
        if len(rows):
            edges = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
            self.bits[rows[edges]] += _one_bits(hashes, edges)
            self.shingles[rows[edges]] += np.diff([*edges, len(rows)])

    def _over(self) -> None:
        """The last row is over; if it made no shingle, its words are one."""
        if self.held and not self.shingles[self.row]:
            whole = np.frombuffer(b" ".join(self.held) + bytes(8), np.uint8)
            self._tally(_xxh64.hashes(whole, np.array([0]), np.array([len(whole) - 8])), np.array([self.row]))
        self.held = []

    def fingerprints(self) -> np.ndarray:
        self._over()
        return np.packbits(2 * self.bits > self.shingles[:, None], axis=1, bitorder="little").view("<u8").reshape(-1).astype(U)


def fingerprints(column: pa.Array, width: int = 3) -> np.ndarray:
    """The 64-bit SimHash of each text: A-Z lower-cased, words between white space, each ``width`` words in a row as often as they come."""
    counter = _Counter(len(column), width)
    for words in _words.spans(column, SEGMENT):
        counter.add(*words)
    return counter.fingerprints()


def _sketcher(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _words.slices(whole, "text", SEGMENT):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints(batch.column("text"), width).view(np.int64))], ["doc_id", "node"])

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes = batch.column("node").to_numpy()
        for at in range(0, len(nodes), 65536):
            part = nodes[at : at + 65536]
            rows, keys = fuzzy_keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], ["key", "node"])


def _verified(distance: int):
    """Forests of the links in each bucket, of a stream that is sorted by key; a bucket has at most CROWD nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in runs(batches, ["key"]):
            nodes = np.unique(bucket.column("node").to_numpy())
            links = np.bitwise_count((nodes[:, None] ^ nodes[None, :]).view(np.uint64)) <= distance
            a, b = forest(nodes, links)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node with the 65 words within one bit of it."""
    flips = np.concatenate(([0], U(1) << np.arange(64, dtype=U))).astype(U).view(np.int64)
    for batch in batches:
        nodes = batch.column("node").to_numpy()
        for at in range(0, len(nodes), 4096):
            part = nodes[at : at + 4096]
            yield pa.RecordBatch.from_arrays([pa.array((part[:, None] ^ flips[None, :]).reshape(-1)), pa.array(np.repeat(part, len(flips)))], ["word", "node"])


def links(nodes: DataFrame) -> DataFrame:
    """(a, b), a > b: enough of the pairs of distinct nodes (long) that differ in two bits at most to connect them as all such pairs would."""
    keys = stage_table(nodes.mapInArrow(_keyed, "key long, node long"), "golay_keys")
    buckets = stage_table(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "golay_buckets")
    few = near_if_small(buckets.where(F.col("n") <= CROWD).select("key"))
    compared = keys.join(few, "key", "left_semi").repartition("key").sortWithinPartitions("key").mapInArrow(_verified(2), "a long, b long")
    crowded = stage_table(keys.join(near_if_small(buckets.where(F.col("n") > CROWD).select("key")), "key", "left_semi").select("node").distinct(), "crowded")
    stars = crowded.mapInArrow(_neighbours, "word long, node long").groupBy("word").agg(F.collect_list("node").alias("all")).where("size(all) > 1")  # of 65 at most
    stars = stars.select(F.explode("all").alias("a"), F.array_min("all").alias("b")).where("a > b")
    return compared.union(stars).distinct()


def simhash_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id.

    Documents whose fingerprints differ in two bits at most are linked; component_id is the smallest doc_id in reach. Null and empty texts, and those of
    white space alone, have the fingerprint zero, which links as any other does. With fewer words than ``width`` the whole sequence is the only shingle. A row
    without doc_id links too, but gives no label: a group of such rows alone has a null component_id. Repeated rows fare alike. Texts are read whole, however
    long. An empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(col(docs, "doc_id").cast("long").alias("doc_id"), col(docs, "text").alias("text"))
    sketches = stage_table(docs.mapInArrow(_sketcher(width), "doc_id long, node long"), "fingerprints")
    nodes = stage_table(sketches.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    found = near_if_small(components(links(nodes.select("node"))).select(F.col("a").alias("node"), F.col("b").alias("root")))
    rooted = stage_table(nodes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stage_table(rooted.join(groups, "root").select("node", "n", "component_id"), "named")
    out = join_classes(sketches, named, ["node"])
    return out.select("doc_id", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")
