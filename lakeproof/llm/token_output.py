"""Token-ID output: a static range asymmetric numeral system over interleaved blocks.

File layout, little-endian (one file is one row of the written table, in ascending doc_id order of its documents):

    "LPT1", u32 documents, u32 blocks, u32 checkpoint steps, u64 ids, u64 table bytes
    table: zlib of u16 frequency - 1 ... per symbol as (u32 symbol, u32 frequency) pairs, delta-coded; shared by the file's blocks
    documents: u32 ids each
    blocks: u32 ids, u32 lanes, u32 words, u32 CRC-32 of the ids as u32, u32 checkpoints; checkpoints: u32 word, u64 state per lane; u32 words

A block's ids lie row by row over its lanes. All lanes take their words from one stream, in lane order, so a step of the decoder is a few array
operations. A checkpoint holds the lanes' states and the place in the stream before its step, so decoding can begin there; blocks are independent.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeproof.llm._common import col, stage_table
from lakeproof.llm._tokens import default_tokenizer, encoder
from lakeproof.llm._words import slices

SCALE = 20
LOW = 1 << 31
LANES, BLOCK, CHECKPOINT_STEPS = 2048, 1 << 19, 128
#: Ids after which a file is closed, at the end of a document.
FILE_IDS = 1 << 22
#: Bytes of text that are encoded at a time. Each distinct part costs the library once in them, so more of them cost it less.
LOT = 16 << 20
_HEAD, _BLOCK = struct.Struct("<4sIIIQQ"), struct.Struct("<IIIII")
U = np.uint64


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to 2**SCALE, at least 1 where the count isn't 0."""
    total, size = int(counts.sum()), 1 << SCALE
    if not total:
        return np.zeros(len(counts), np.int64)
    out = np.where(counts > 0, np.maximum(1, counts * size // total), 0).astype(np.int64)
    order = np.argsort(-out, kind="stable")
    left = size - int(out.sum())
    if left > 0:
        out[order[0]] += left
    at = 0
    while left < 0:  # the ones that were rounded up to 1 are paid for by the most frequent
        give = min(-left, int(out[order[at]]) // 2)
        out[order[at]] -= give
        left += give
        at = (at + 1) % int((out > 1).sum() or 1)
    return out


def _encode_block(ids: np.ndarray, freq: np.ndarray, start: np.ndarray) -> bytes:
    lanes = max(1, min(LANES, len(ids) // 64))
    steps = -(-len(ids) // lanes)
    state = np.full(lanes, LOW, dtype=U)
    chunks: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    written = 0
    for step in range(steps - 1, -1, -1):
        row = ids[step * lanes : (step + 1) * lanes]
        f, c = freq[row], start[row]
        x = state[: len(row)]
        full = x >= f << U(63 - SCALE)
        if full.any():
            chunks.append((x[full] & U(0xFFFFFFFF)).astype("<u4"))
            written += len(chunks[-1])
            x = np.where(full, x >> U(32), x)
        q = x // f
        state[: len(row)] = (q << U(SCALE)) + (x - q * f) + c
        if step % CHECKPOINT_STEPS == 0:
            marks.append((written, state.copy()))
    words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, "<u4")
    out = [_BLOCK.pack(len(ids), lanes, len(words), zlib.crc32(ids.astype("<u4").tobytes()), len(marks))]
    for at, states in marks[::-1]:
        out += [struct.pack("<I", len(words) - at), states.astype("<u8").tobytes()]
    return b"".join([*out, words.tobytes()])


def encode_file(documents: list[np.ndarray]) -> bytes:
    """The file of these documents' ids."""
    ids = np.concatenate(documents).astype(np.int64) if documents else np.zeros(0, np.int64)
    counts = np.bincount(ids)
    freq = frequencies(counts)
    start = np.concatenate(([0], np.cumsum(freq)[:-1])) if len(freq) else freq
    symbols = np.flatnonzero(freq)
    table = zlib.compress(np.diff(symbols, prepend=0).astype("<u4").tobytes() + freq[symbols].astype("<u4").tobytes())
    f, c = freq.astype(U), start.astype(U)
    blocks = [_encode_block(ids[i : i + BLOCK], f, c) for i in range(0, len(ids), BLOCK)]
    lengths = np.array([len(d) for d in documents], dtype="<u4")
    return b"".join([_HEAD.pack(b"LPT1", len(documents), len(blocks), CHECKPOINT_STEPS, len(ids), len(table)), table, lengths.tobytes(), *blocks])


class TokenFile:
    """A reader over a file's bytes: document lengths, and each block by itself."""

    def __init__(self, data: bytes):
        self.data = data
        magic, docs, n_blocks, self.every, self.ids, size = _HEAD.unpack_from(data)
        if magic != b"LPT1":
            raise ValueError("not a token file")
        at = _HEAD.size
        raw = np.frombuffer(zlib.decompress(data[at : at + size]), dtype="<u4").reshape(2, -1)
        self.symbols, self.freq = np.cumsum(raw[0], dtype=np.int64), raw[1].astype(U)
        self.start = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(U) if len(self.freq) else self.freq
        self.slots = np.repeat(np.arange(len(self.symbols)), self.freq.astype(np.int64))
        at += size
        self.lengths = np.frombuffer(data, dtype="<u4", count=docs, offset=at).astype(np.int64)
        at += 4 * docs
        self.blocks: list[tuple] = []
        for _ in range(n_blocks):
            n, lanes, words, crc, marks = _BLOCK.unpack_from(data, at)
            at += _BLOCK.size
            self.blocks.append((n, lanes, words, crc, marks, at))
            at += marks * (4 + 8 * lanes) + 4 * words

    def decode_block(self, block: int, checkpoint: int = 0, steps: int | None = None) -> np.ndarray:
        """The block's ids from a checkpoint on, of so many steps or up to its end; a whole block is held against its checksum."""
        n, lanes, n_words, crc, marks, at = self.blocks[block]
        mark = at + checkpoint * (4 + 8 * lanes)
        pos = struct.unpack_from("<I", self.data, mark)[0]
        state = np.frombuffer(self.data, dtype="<u8", count=lanes, offset=mark + 4).astype(U)
        words = np.frombuffer(self.data, dtype="<u4", count=n_words, offset=at + marks * (4 + 8 * lanes))
        first = checkpoint * self.every
        last = -(-n // lanes) if steps is None else min(-(-n // lanes), first + steps)
        out = np.empty(min(n, last * lanes) - first * lanes, dtype=np.int64)
        low = U((1 << SCALE) - 1)
        for step in range(first, last):
            size = min(lanes, n - step * lanes)
            x = state[:size]
            slot = x & low
            k = self.slots[slot.astype(np.int64)]
            out[(step - first) * lanes : (step - first) * lanes + size] = self.symbols[k]
            x = self.freq[k] * (x >> U(SCALE)) + slot - self.start[k]
            need = x < U(LOW)
            count = int(need.sum())
            if count:
                x[need] = (x[need] << U(32)) | words[pos : pos + count]
                pos += count
            state[:size] = x
        if not checkpoint and steps is None and zlib.crc32(out.astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {block} is damaged")
        return out

    def documents(self) -> Iterator[np.ndarray]:
        """Each document's ids, a few blocks in memory at a time."""
        held, block = np.zeros(0, np.int64), 0
        for n in self.lengths:
            parts, have = [held], len(held)
            while have < n:
                parts.append(self.decode_block(block))
                have += len(parts[-1])
                block += 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield held[:n]
            held = held[n:]


def _writer(path: str | None, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        known = encoder(path or default_tokenizer())
        wide = np.dtype("<u2" if known.dtype.itemsize == 2 and end_id < 1 << 16 else "<u4")
        end = np.array([end_id], dtype=wide)
        names: list = []
        held: list[np.ndarray] = []
        size = 0

        def close():
            nonlocal number, size
            file = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([size], pa.int64()), pa.array([list(names)], pa.list_(pa.int64())), pa.array([encode_file(held)], pa.binary())],
                ["part", "number", "n_ids", "doc_ids", "file"],
            )
            names.clear()
            held.clear()
            number, size = number + 1, 0
            return file

        for batch in batches:
            for part_ in slices(batch, "text", LOT):
                for doc_id, got in zip(part_.column("doc_id").to_pylist(), known.encode(part_.column("text"), LOT)):
                    names.append(doc_id)
                    held.append(np.concatenate([got.astype(wide, copy=False), end]))
                    size += len(held[-1])
                    if size >= FILE_IDS:
                        yield close()
        if held:
            yield close()

    return run


def write_tokens(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Encode every whole text, write the files in ascending doc_id order, and give the table of written files.

    Columns: part, number (both ascending with doc_id), n_ids, doc_ids, file. The table is written Parquet in the shared folder, so Spark's commit
    protocol keeps exactly one copy of each file whatever executors are lost. Null texts count as empty; null doc_ids come first; equal doc_ids are
    ordered by text, and repeated rows are documents of their own. Texts are read whole, however long; a file ends with the document that fills it. An empty table
    gives no file; other columns are ignored.
    """
    docs = docs.select(col(docs, "doc_id").cast("long").alias("doc_id"), F.coalesce(col(docs, "text"), F.lit("")).alias("text"))
    ordered = docs.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return stage_table(ordered.mapInArrow(_writer(tokenizer, end_id), "part int, number int, n_ids long, doc_ids array<long>, file binary"), "tokens")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(len(batch)):
            one = batch.slice(row, 1)
            file = TokenFile(one.column("file")[0].as_buffer().to_pybytes())
            crcs = [zlib.crc32(d.astype("<u4").tobytes()) for d in file.documents()]
            n = len(crcs)
            starts = np.cumsum(file.lengths) - file.lengths
            part, number = (np.full(n, one.column(c)[0].as_py(), dtype=np.int32) for c in ("part", "number"))
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(number), one.column("doc_ids").flatten(), pa.array(starts), pa.array(file.lengths), pa.array(crcs, pa.int64())], ["part", "number", "doc_id", "within", "n_tokens", "ids_crc32"])


def read_tokens(files: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32.

    Files are decoded where they are read; only what is known of a document then meets the place of its file. Without files there is no row.
    """
    sizes = files.select("part", "number", "n_ids")
    by_part = stage_table(sizes.groupBy("part").agg(F.sum("n_ids").alias("ids")), "parts")
    parts = by_part.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("base"))  # a row per written partition
    inside = Window.partitionBy("part").orderBy("number")
    before = sizes.select("part", "number", (F.sum("n_ids").over(inside) - F.col("n_ids")).alias("earlier")).join(parts, "part").select("part", "number", (F.col("base") + F.col("earlier")).alias("before"))
    told = files.select("part", "number", "doc_ids", "file").mapInArrow(_reader, "part int, number int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return told.join(before, ["part", "number"]).select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
