"""Cost-balanced packing of token sequences.

Each task packs its own documents in bounded lots, without a shuffle. A lot's ids fill a whole number of full sequences and one
sequence for each power of two in what is left over, so no padding is needed. Documents of a full sequence or more give full pieces first; what is
left of them is ordered by descending cost and goes each to the lowest-cost sequence with remaining capacity, being cut where that ends. A piece of
n tokens costs ``linear`` * n + ``quadratic`` * n**2, as attention within the piece does.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeproof.llm._common import col
from lakeproof.llm._tokens import SLICE, default_tokenizer, encoder
from lakeproof.llm._words import slices

CAPACITY = 1024
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Ids of a lot, which a task holds at a time.
LOT = 1 << 22


def balance(sizes: list[int], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these sizes; sequences are numbered from 0.

    Every token lies in exactly one piece; every sequence is full or as long as a power of two.
    """
    pieces, sequence, rest = [], 0, []
    for d, size in enumerate(sizes):
        at = 0
        while size - at >= capacity:
            pieces.append((d, at, capacity, sequence, 0))
            at += capacity
            sequence += 1
        if size > at:
            rest.append((size - at, d, at))
    left = sum(r[0] for r in rest)
    rooms = [capacity] * (left // capacity)
    tail = left % capacity
    rooms += [1 << b for b in range(tail.bit_length() - 1, -1, -1) if tail >> b & 1]
    heap = [(0.0, sequence + i, 0, room) for i, room in enumerate(rooms)]
    rest.sort(key=lambda r: (-(linear * r[0] + quadratic * r[0] * r[0]), r[1]))
    for size, d, at in rest:
        while size:
            cost, s, used, room = heapq.heappop(heap)
            take = min(size, room - used)
            pieces.append((d, at, take, s, used))
            if used + take < room:
                heapq.heappush(heap, (cost + linear * take + quadratic * take * take, s, used + take, room))
            at, size = at + take, size - take
    return pieces


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, occurrence long"


def _packer(path: str | None, end_id: int, capacity: int, linear: float, quadratic: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        next_id = next_document = TaskContext.get().partitionId() << 33
        known = encoder(path or default_tokenizer())
        names: list = []
        held: list[np.ndarray] = []

        def pack(lot):
            nonlocal next_id, next_document
            pieces = balance([len(d) for d in held], capacity, linear, quadratic)
            d, start, length, sequence, offset = (np.array(x, dtype=np.int64) for x in zip(*pieces))
            crcs = [zlib.crc32(held[i][s : s + n].astype("<u4").tobytes()) for i, s, n, _, _ in pieces]
            totals = np.array([len(x) for x in held], dtype=np.int64)
            arrays = [pa.array(names, pa.int64()).take(pa.array(d)), pa.array(start), pa.array(length), pa.array(crcs, pa.int64()), pa.array(totals[d]), pa.array(sequence + next_id), pa.array(offset), pa.array(d + next_document)]
            next_id += int(sequence.max()) + 1
            next_document += len(held)
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "occurrence"])

        size = 0
        for batch in batches:
            for part_ in slices(batch, "text", SLICE):
                for doc_id, got in zip(part_.column("doc_id").to_pylist(), known.encode(part_.column("text"))):
                    names.append(doc_id)
                    held.append(np.concatenate([got, np.array([end_id], dtype=got.dtype)]))
                    size += len(held[-1])
                    if size >= LOT:
                        yield pack(held)
                        size = 0
                        names, held = [], []
        if held:
            yield pack(held)

    return run


def pack_sequences(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, occurrence.

    Null texts count as empty and give the end id alone. Null doc_ids stay null. Repeated rows are documents of their own, with equal doc_ids and each with its
    own occurrence. Texts are read whole, however long. An empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(col(docs, "doc_id").cast("long").alias("doc_id"), F.coalesce(col(docs, "text"), F.lit("")).alias("text"))
    return docs.mapInArrow(_packer(tokenizer, end_id, capacity, linear, quadratic), SCHEMA)
