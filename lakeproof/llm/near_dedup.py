"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

1. One pass makes each row's set of word shingles, its 128-bit set digest and its band keys, and numbers the rows.
2. Equal sets are one class, known by its smallest row number; only classes go on, so copies never meet in pairs.
3. Classes that share a band key are a bucket. Each bucket has an anchor, the member that shares the most keys with others, and every
   member's full set is held against its anchors' sets; an anchor's members are dealt out in lots of bounded bytes, so no bucket has to lie in one task.
4. A bucket whose members are then all in one component is settled. In the others, what the anchor's component doesn't hold is verified against
   all members of another component, in blocks of bounded bytes that yield forests, never pairs. So every pair of a bucket is either verified or
   already in one component.
5. The components of all links are the groups; a group's label is the smallest doc_id of its rows.

Bands of 5 slots, 40 of them, miss a pair at similarity 0.75 with a chance of 2e-5 and one at 0.8 with 1e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeproof.llm import _superminhash, _words
from lakeproof.llm._common import col, fresh, join_classes, near_if_small, stage_table
from lakeproof.llm._graph import components

BANDS, WIDTH = 40, 5
#: Members and bytes of full sets in a lot of an anchor, or on either side of a block.
LOT_ROWS, LOT_BYTES = 512, 8 << 20
_SIDE = 4096
_TABLE = "doc_id long, row long, h1 long, h2 long, n_shingles long, set_a long, set_b long, keys array<long>"


def sketcher(shingle: int, n_bands: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _words.slices(whole, "text"):
                sets = list(_words.shingle_sets(batch.column("text"), shingle))
                keys = _superminhash.bands(_superminhash.signatures(sets, n_bands * width), n_bands, width).view(np.int64)
                full = np.array([len(s) for s in sets], dtype=np.int64)
                digests = np.zeros((2, len(sets)), np.uint64)
                for i, s in enumerate(sets):
                    if len(s):
                        m = _words.mix(s)
                        digests[:, i] = np.sum(m, dtype=np.uint64), np.sum(_words.mix(m ^ _words.U(0xA5A5)), dtype=np.uint64)
                offsets = pa.array(np.concatenate(([0], np.cumsum((full > 0) * n_bands))), pa.int32())
                known = [batch.column(c) for c in ("doc_id", "row", "h1", "h2")]
                sketch = [pa.array(full), pa.array(digests[0].view(np.int64)), pa.array(digests[1].view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(keys[full > 0].reshape(-1)))]
                yield pa.RecordBatch.from_arrays(known + sketch, ["doc_id", "row", "h1", "h2", "n_shingles", "set_a", "set_b", "keys"])

    return run


def _setter(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _words.slices(whole, "text"):
                sets = [s.tobytes() for s in _words.shingle_sets(batch.column("text"), shingle)]
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "elements"])

    return run


def runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The groups of a stream that is sorted by ``key``, each as a table, one in memory at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        values = [batch.column(k).to_numpy(zero_copy_only=False) for k in key]
        cut = np.concatenate(([0], np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1, [len(batch)]))
        for a, b in zip(cut[:-1], cut[1:]):
            now = tuple(v[a] for v in values)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Square boolean array: 100 * intersection >= percent * union, from the full sets."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if n <= 6:
        common = np.zeros((n, n), np.int64)
        for i in range(n):
            for j in range(i):
                if 100 * min(sizes[i], sizes[j]) >= percent * max(sizes[i], sizes[j]):
                    common[i, j] = common[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        elements, rows = np.concatenate(sets), np.repeat(np.arange(n), sizes)
        values, where, counts = np.unique(elements, return_inverse=True, return_counts=True)
        rank = np.cumsum(counts > 1) - 1
        shared = counts[where] > 1
        where, rows = rank[where[shared]], rows[shared]
        common = np.zeros((n, n), np.float64)
        for lo in range(0, int((counts > 1).sum()), _SIDE):  # counts stay below 2**24, exact in single precision, in each slab
            part = (where >= lo) & (where < lo + _SIDE)
            slab = np.zeros((n, _SIDE), np.float32)
            slab[rows[part], where[part] - lo] = 1
            common += slab @ slab.T
        common = common.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    out = (100 * common >= percent * union) & (common > 0)
    np.fill_diagonal(out, False)
    return out


def forest(ids: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each linked row with a smaller id in its component: its id and the component's smallest."""
    label = ids.copy()
    top = np.iinfo(np.int64).max
    while True:
        new = np.minimum(label, np.where(links, label[None, :], top).min(axis=1))
        if (new == label).all():
            break
        label = new
    below = label < ids
    return ids[below], label[below]


def beside(anchor: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set whether it is linked with the anchor's, from the full sets."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    elements = np.concatenate(sets)
    at = np.searchsorted(anchor, elements)
    at[at == len(anchor)] = 0
    common = np.add.reduceat((anchor[at] == elements).astype(np.int64), np.cumsum(sizes) - sizes)  # no set is empty
    return 100 * common >= percent * (sizes + len(anchor) - common)


def _sets(batch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in batch.column("elements")]


def _around(percent: int):
    """Links of anchors, of a stream sorted by anchor and lot with the anchor's own set first: one set and a batch in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, middle = None, np.zeros(0, np.uint64)
        for whole in batches:
            for batch in (whole.slice(i, 64) for i in range(0, len(whole), 64)):
                anchors, nodes, sets = batch.column("anchor").to_numpy(), batch.column("node").to_numpy(), _sets(batch)
                a, b = [], []
                for anchor in dict.fromkeys(anchors.tolist()):
                    at = np.flatnonzero(anchors == anchor)
                    if nodes[at[0]] == anchor:
                        now, middle = anchor, sets[at[0]].copy()
                    others = at[nodes[at] != anchor]
                    if now != anchor:
                        raise RuntimeError("an anchor's set is missing")
                    if len(others):
                        hit = nodes[others[beside(middle, [sets[k] for k in others], percent)]]
                        a.append(hit)
                        b.append(np.full(len(hit), anchor, np.int64))
                if a:
                    a, b = np.concatenate(a), np.concatenate(b)
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    return run


def _blocks(percent: int):
    """Forests of the links between different components in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["key", "i", "j"]):
            ids, first = np.unique(group.column("node").to_numpy(), return_index=True)
            group = group.take(pa.array(first))
            root = group.column("root").to_numpy()
            links = linked(_sets(group), percent) & (root[:, None] != root[None, :])
            a, b = forest(ids, links)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _lots(rows, size):
    """Number of lots for so many rows of so many bytes."""
    return F.greatest(F.lit(1), F.ceil(rows / LOT_ROWS), F.ceil(size / LOT_BYTES)).cast("int")


def _each(n):
    return F.explode(F.sequence(F.lit(0), n - 1))


def _links(docs: DataFrame, heads: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b): for every class that isn't the smallest of its component, that one. ``heads``: node, doc_id, h1, h2, n_shingles, keys."""
    rows = heads.select(F.explode("keys").alias("key"), "node", "n_shingles")
    buckets = near_if_small(stage_table(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets"))
    members = stage_table(rows.join(buckets, "key"), "members")
    # the anchor of a bucket: of its members, the one that meets the most others over all its buckets
    meets = members.groupBy("node").agg(F.sum("n").alias("meets"))
    order = F.max(F.struct("meets", (-F.col("node")).alias("first")))
    anchors = members.join(meets, "node").groupBy("key").agg(order.alias("best")).select("key", (-F.col("best.first")).alias("anchor"))
    members = stage_table(members.join(anchors, "key"), "anchored")

    wanted = near_if_small(stage_table(heads.select("node", "doc_id", "h1", "h2").join(members.select("node").distinct(), "node", "left_semi"), "wanted"))
    texts = docs.join(wanted, ["doc_id", "h1", "h2"]).select("node", "text")
    sets = texts.mapInArrow(_setter(shingle), "node long, elements binary").repartition("node").groupBy("node").agg(F.first("elements").alias("elements"))

    # every member against its anchors
    size = F.col("n_shingles") * 8
    pairs = members.where("node <> anchor").groupBy("anchor", "node").agg(F.first(size).alias("size"))
    lots = stage_table(pairs.groupBy("anchor").agg(_lots(F.count("*"), F.sum("size")).alias("lots")), "lots")
    dealt = pairs.join(lots, "anchor").select("anchor", "node", F.pmod(F.xxhash64("node"), "lots").cast("int").alias("lot"))
    middles = lots.select("anchor", F.col("anchor").alias("node"), _each(F.col("lots")).alias("lot"))
    laid = dealt.union(middles).join(sets, "node").repartition("anchor", "lot").sortWithinPartitions("anchor", "lot", (F.col("node") != F.col("anchor")))
    star = stage_table(laid.mapInArrow(_around(percent), "a long, b long"), "stars")
    found = components(star)

    # what is open yet: members of buckets that hold more than one component
    rooted = members.join(near_if_small(found.select(F.col("a").alias("node"), F.col("b").alias("root"))), "node", "left").select("key", "node", "anchor", "n_shingles", F.coalesce("root", "node").alias("root"))
    state = rooted.groupBy("key", "anchor").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(F.when(F.col("node") == F.col("anchor"), F.col("root"))).alias("main"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("which"), F.min("node").alias("least"))
    open_ = state.where("lo < hi").groupBy("n", "which", "least").agg(F.min(F.struct("key", "main")).alias("k")).select("k.*")  # buckets of the same members count once
    open_ = stage_table(open_, "open")
    if open_.isEmpty():
        return found
    rooted = stage_table(rooted.join(near_if_small(open_), "key").select("key", "node", "root", (F.col("root") != F.col("main")).alias("outside"), size.alias("size")), "rooted")
    outside = F.col("outside")
    sums = rooted.groupBy("key").agg(_lots(F.count("*"), F.sum("size")).alias("across"), _lots(F.count_if(outside), F.coalesce(F.sum(F.when(outside, F.col("size"))), F.lit(0))).alias("down"))
    placed = rooted.join(sums, "key")
    left = placed.where("outside").select("key", "node", "root", F.pmod(F.xxhash64("node"), "down").cast("int").alias("i"), _each(F.col("across")).alias("j"))
    right = placed.select("key", "node", "root", _each(F.col("down")).alias("i"), F.pmod(F.xxhash64("node"), "across").cast("int").alias("j"))
    blocks = left.union(right).join(sets, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return components(found.union(blocks.mapInArrow(_blocks(percent), "a long, b long")))


def _judged(docs: DataFrame, shingle: int, percent: int, n_bands: int, width: int) -> DataFrame:
    """One row per row: doc_id, row, h1, h2, n_shingles, root (a number of its component, null for rows that stand alone), component_id."""
    text = col(docs, "text")
    docs = docs.select(col(docs, "doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))
    sketches = stage_table(docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(sketcher(shingle, n_bands, width), _TABLE), "sketches")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    full = sketches.where(~alone)
    classes = stage_table(full.groupBy("set_a", "set_b").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    heads = full.join(classes.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node").drop("set_a", "set_b")
    found = _links(docs, heads, shingle, percent)
    found = near_if_small(found.select(F.col("a").alias("node"), F.col("b").alias("root")))
    rooted = stage_table(classes.join(found, "node", "left").select("set_a", "set_b", "n", "least", F.coalesce("root", "node").alias("root")), "rooted")
    labels = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("k")).where("k > 1").drop("k")
    named = rooted.join(labels, "root", "left").select("set_a", "set_b", "n", "root", F.coalesce("component_id", "least").alias("component_id"))
    named = stage_table(named, "named")
    base = sketches.select("doc_id", "row", "h1", "h2", "n_shingles", "set_a", "set_b")
    out = ["doc_id", "row", "h1", "h2", "n_shingles", "root", "component_id"]
    told = join_classes(base.where(~alone), named, ["set_a", "set_b"]).select(*out)
    return told.union(base.where(alone).select(*out[:5], F.lit(None).cast("long"), F.col("doc_id")))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 75, n_bands: int = BANDS, width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents with at least ``percent`` per cent of their shingles in common are linked; component_id is the smallest doc_id in
    reach. Empty and null texts have no shingles and stand alone, as do rows without doc_id (component_id null, kept true).
    Rows that repeat a doc_id are judged each by its own text; wholly equal rows fare alike. Texts are read whole, however long. An empty table gives
    an empty result; other columns are ignored.
    """
    judged = _judged(docs, shingle, percent, n_bands, width)
    return judged.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 75, n_bands: int = BANDS, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each group: of its rows with the smallest doc_id, the first that was read.

    Rows go by doc_id and text, so a row that shares a doc_id with a removed one stays unless its own text is in a group.
    """
    judged = stage_table(_judged(docs, shingle, percent, n_bands, width), "judged")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    stays = judged.where(kept & F.col("root").isNotNull()).groupBy("root").agg(F.min("row").alias("stays"), F.count("*").alias("k"))
    again = near_if_small(stage_table(stays.where("k > 1"), "again"))  # groups of which several rows have the smallest doc_id
    d, a, b = fresh(docs, "gone_id", "text_a", "text_b")
    names = [F.col("doc_id").alias(d), F.col("h1").alias(a), F.col("h2").alias(b)]
    last = judged.join(again, "root")
    one = stage_table(last.where("row = stays").select(*names), "one")
    gone = judged.where(~kept).select(*names).union(last.where(kept).select(*names)).distinct()
    gone = near_if_small(stage_table(gone, "gone"))
    text = col(docs, "text")
    marked = docs.withColumns({a: F.xxhash64(text), b: F.xxhash64(F.lit(1), text)})
    same = lambda right: (col(docs, "doc_id") == right[d]) & (marked[a] == right[a]) & (marked[b] == right[b])
    out = marked.join(gone, same(gone), "left_anti")
    if not one.isEmpty():
        out = out.unionByName(marked.join(one, same(one), "left_semi").dropDuplicates([a, b]))
    return out.drop(a, b)
