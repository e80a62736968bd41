"""Sharding by sampled splitters.

Records are ranged by a 64-bit hash of their text, so equal texts lie together. A size-weighted sample of these keys gives
quantile boundaries of many narrow ranges, in which a key that fills a range has one of its own; all records are then counted by range, ranges
that turn out overfull are subdivided, by key or, if they are one key's, by row, and the exact sizes of the pieces are cut into shards of near equal bytes. A piece is numbered in lots of bounded
rows, each from the count of the rows before it, so that no task ever holds a shard, a piece or a group of copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeproof.llm._common import col, near_if_small, stage_table

PER_ROW = 16
#: Rows that one task numbers, on average. The number of lots grows with the rows, a row on the driver for each.
NUMBERED = 1 << 21
#: Ranges and sampled keys per shard. The driver holds shards * SAMPLED keys and a row per lot.
RANGES, SAMPLED = 32, 2000  # of the sampled keys, a range has 62 on average, so a key that fills one is among them


def _splitters(records: DataFrame, total: int, ranges: int, sampled: int) -> list[int]:
    """Quantile boundaries from keys drawn with a chance in proportion to size, so many on average; a draw depends on the row alone."""
    if not total:
        return []
    u = (F.pmod(F.xxhash64(F.lit(11), "key", "doc_id", "row"), F.lit(1 << 30)) + 1) / float(1 << 30)
    draws = F.col("size") * (sampled / total)
    whole = F.floor(draws) + F.when(u <= draws - F.floor(draws), 1).otherwise(0)
    drawn = sorted((r["key"], r["w"]) for r in records.select("key", whole.alias("w")).where("w > 0").groupBy("key").agg(F.sum("w").alias("w")).collect())
    out, seen, weight = set(), 0, sum(w for _, w in drawn)
    for key, w in drawn:
        if seen * ranges // weight < (seen + w) * ranges // weight < ranges:
            out.add(key)
        if w * ranges >= weight:  # a hot key: a range ends before it and another begins behind it
            out |= {key, key + 1}
        seen += w
    return sorted(k for k in out if k < 1 << 63)


def assign_shards(docs: DataFrame, shards: int = 40, ranges: int = RANGES, sampled: int = SAMPLED, numbered: int = NUMBERED) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Size is the text's UTF-8 bytes plus 16, null counting as empty. Shards' sizes are near equal: they differ by the size of a piece,
    about 1 / ``ranges`` of a shard, or of a single longer record. Equal texts share a shard unless they alone fill more than a range. Slots
    are gapless from 0 in each shard. Null doc_ids are records as well, repeated rows are records of their own; texts are measured whole, however long.
    An empty table gives an empty result.
    """
    text = F.coalesce(col(docs, "text"), F.lit(""))
    records = stage_table(
        docs.select(
            col(docs, "doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + PER_ROW).alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
            F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("row"),
        ),
        "records",
    )
    n_rows, total = records.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    wide = shards * ranges
    splitters = _splitters(records, total, wide, shards * sampled)
    single = [i + 1 for i, (a, b) in enumerate(zip(splitters, [*splitters[1:], None])) if b == a + 1 or a == (1 << 63) - 1]
    ranged = records.withColumn("range", _rank(splitters))
    counts = {r["range"]: (r["n"], r["b"]) for r in ranged.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()}
    most_rows, most_bytes = max(1.0, 2 * n_rows / wide), max(1.0, 2 * total / wide)
    parts = {k: p for k, (n, b) in counts.items() if (p := min(n, int(max(n / most_rows, b / most_bytes) + 0.999))) > 1}
    by = F.xxhash64(F.lit(5), "key")
    if single:
        by = F.when(F.col("range").isin(single), F.xxhash64(F.lit(5), "doc_id", "row")).otherwise(by)
    lots = {k: -(-n // (numbered * (parts.get(k, 1) if k in single else 1))) for k, (n, _) in counts.items()}  # a part by key may hold nearly all of its range
    pieces = ranged.withColumn("part", F.pmod(by, _looked_up(parts).cast("long")).cast("int"))
    pieces = pieces.withColumn("lot", F.pmod(F.xxhash64(F.lit(7), "doc_id", "row"), _looked_up(lots).cast("long")).cast("int"))
    exact = sorted(tuple(r) for r in pieces.groupBy("range", "part", "lot").agg(F.count("*"), F.sum("size")).collect())
    sizes: dict[tuple[int, int], int] = {}
    for k, part, _, _, size in exact:
        sizes[k, part] = sizes.get((k, part), 0) + size
    homes, before, shard = {}, 0, 0
    for piece, size in sizes.items():
        middle = before + size / 2
        shard = homes[piece] = max(shard, min(shards - 1, int(middle * shards / total)))
        before += size
    plan, fill = [], [0] * shards
    for k, part, lot, n, _ in exact:
        shard = homes[k, part]
        plan.append((k, part, lot, shard, fill[shard]))
        fill[shard] += n
    placed = near_if_small(docs.sparkSession.createDataFrame(plan, "range int, part int, lot int, shard int, base long"))
    in_lot = Window.partitionBy("range", "part", "lot").orderBy("key", "doc_id", "row")
    rows = pieces.withColumn("place", F.row_number().over(in_lot).cast("long") - 1)
    slot = (F.col("base") + F.col("place")).alias("slot")
    return rows.join(placed, ["range", "part", "lot"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot, F.lit(None).cast("int").alias("grown_shard"))


def _looked_up(numbers: dict[int, int]):
    """The range's number, 1 where none above it is given."""
    more = [f"{k},{v}" for k, v in numbers.items() if v > 1]
    return F.coalesce(F.try_element_at(F.expr(f"map({','.join(more)})"), F.col("range")), F.lit(1)) if more else F.lit(1)


def _rank(splitters: list[int]):
    """Number of splitters at or below the key, by bisection in a literal array."""
    if not splitters:
        return F.lit(0)
    edges = F.expr("array(" + ",".join(f"{k}L" if k > -(1 << 63) else "-9223372036854775807L - 1L" for k in splitters) + ")")
    steps = F.array(*[F.lit(1 << i) for i in range(len(splitters).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(edges, at + step - 1) <= F.col("key"), at + step).otherwise(at))
