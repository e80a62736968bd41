"""Exact dedup with a heavy-hitter split.

Misra-Gries summaries of the digests, one per partition and added up by digest, name every digest with more than a share ``heavy`` of
the rows, or with more than ``HEAVY_ROWS`` rows, whichever is less. Those few are counted exactly and their winners broadcast, so that their rows,
however many, are settled where they lie. All other digests are grouped by an ordinary shuffle, in which no group is large.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeproof.llm._common import col, fresh, near_if_small, squeezed, stage_table


#: A group of more rows is never left to a single task. A summary's counters grow with the rows from 1 / heavy times this number on.
HEAVY_ROWS = 1_000_000


class MisraGries:
    """Counts too low by at most rows / (size + 1), for at most ``size`` keys."""

    def __init__(self, size: int):
        self.size, self.counts = size, Counter()

    def add(self, counts: dict) -> None:
        self.counts.update(counts)
        if len(self.counts) > self.size:
            cut = sorted(self.counts.values(), reverse=True)[self.size]
            self.counts = Counter({k: v - cut for k, v in self.counts.items() if v > cut})


def _summaries(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = MisraGries(size)
        for batch in batches:
            seen = batch.column(0).value_counts()
            summary.add(dict(zip(seen.field(0).to_pylist(), seen.field(1).to_pylist())))
        yield pa.RecordBatch.from_arrays([pa.array(list(summary.counts), pa.binary()), pa.array(list(summary.counts.values()), pa.int64())], ["digest", "n"])

    return run


def heavy_digests(keys: DataFrame, heavy: float, total: int) -> DataFrame:
    """A superset of the digests with more than ``heavy`` of the rows, at most 3 / heavy of them.

    With 4 / heavy counters a summary misses a quarter of the threshold at most, so such a digest shows three quarters of it; and
    the counts shown never add up to more than the rows.
    """
    size = int(4 / heavy)
    shown = keys.select("digest").mapInArrow(_summaries(size), "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    return shown.where(F.col("n") >= max(2, int(0.75 * heavy * total) - 1)).select("digest").orderBy(F.desc("n"), "digest").limit(int(3 / heavy))


def exact_duplicates(docs: DataFrame, heavy: float = 0.0005) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are without white space; null counts as empty, and empty texts are equal to one another. The row with
    the most code points in its own text stays, then the smallest doc_id (null last). Of wholly equal rows with one doc_id,
    exactly one has kept true. Texts are read whole, however long. An empty table gives an empty result; other columns are ignored.
    """
    text = col(docs, "text")
    keys = stage_table(
        docs.select(col(docs, "doc_id").cast("long").alias("doc_id"), F.coalesce(F.char_length(text), F.lit(0)).alias("chars"), F.unhex(F.sha2(F.encode(squeezed(text), "utf-8"), 256)).alias("digest"), F.monotonically_increasing_id().alias("row")),
        "digests",
    )
    total = keys.count()
    heavy = min(heavy, HEAVY_ROWS / max(1, total))
    order = F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("row").alias("r"))
    named = stage_table(heavy_digests(keys, heavy, total), "heavy")
    winners = stage_table(keys.join(near_if_small(named), "digest", "left_semi").groupBy("digest").agg(F.min(order).alias("best"), F.count("*").alias("group_size")), "winners")
    settled = near_if_small(winners)  # at most 3 / heavy rows
    out = ["doc_id", "best", "group_size", "row", "digest"]
    massed = keys.join(settled, "digest").select(*out)
    group = Window.partitionBy("digest")
    rest = keys.join(settled, "digest", "left_anti").withColumn("best", F.min(order).over(group)).withColumn("group_size", F.count("*").over(group)).select(*out)
    return massed.union(rest).select("doc_id", F.col("best.d").alias("keep_id"), "group_size", (F.col("row") == F.col("best.r")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`exact_duplicates` keeps.

    Null texts count as empty, and of all empty texts one row stays; texts are compared whole, however long. Of rows that repeat a doc_id together with its text
    one stays, with the columns of one of them; a null doc_id is an id like any other here. An empty table stays empty.
    """
    d, s, n = fresh(docs, "doc_key", "sha_key", "place_key")
    marked = docs.withColumn(d, col(docs, "doc_id").cast("long")).withColumn(s, F.sha2(F.encode(squeezed(col(docs, "text")), "utf-8"), 256))
    fate = exact_duplicates(docs, **options).groupBy(F.col("doc_id").alias("fd"), F.col("text_sha256").alias("fs")).agg(F.max("kept").alias("stays"), F.count("*").alias("rows"))
    fate = stage_table(fate.where("not stays or rows > 1"), "fate")
    same = lambda right: marked[d].eqNullSafe(right["fd"]) & (marked[s] == right["fs"])
    gone, again = near_if_small(fate.select("fd", "fs")), near_if_small(fate.where("stays"))  # the latter: rows that repeat a doc_id together with its text
    clean = marked.join(gone, same(gone), "left_anti")
    if again.isEmpty():
        return clean.select(*[col(clean, c) for c in docs.columns])
    longest = F.max_by(F.struct(*[col(marked, c).alias(f"c{i}") for i, c in enumerate(docs.columns)]), F.char_length(col(marked, "text"))).alias(n)
    one = marked.join(again, same(again), "left_semi").groupBy(d, s).agg(longest)  # combined before the shuffle
    one = one.select(*[F.col(f"{n}.c{i}").alias(c) for i, c in enumerate(docs.columns)])
    clean = clean.select(*[col(clean, c) for c in docs.columns])
    return clean.union(one)
