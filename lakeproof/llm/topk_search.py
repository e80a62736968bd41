"""Exact top-k by inner product with multi-resolution segment statistics.

For a segment of n components with means m and deviations d, a product's part is at most n * (m * m' + d * d'). The sum of these over the
segments bounds the score from above, that is |q|^2 + |x|^2 minus twice it bounds the squared distance from below. Coarse segments come first; pairs whose bound
stays under the query's k-th score so far are gone, the others meet finer segments, and what survives the finest the exact product.

1. A bounded sample gives each vector length a basis in which energy is concentrated (products are the same in it), segments of equal energy, pivots, and scouts.
2. Vectors are laid out by their nearest pivot and packed into blocks; queries are held against the scouts, which gives a first k-th score.
3. Groups of blocks know the range of their segments' means and the largest deviations. Pairs of groups whose bound stays under the queries' first
   k-th scores are never shuffled; the others are cells, each a task's work of bounded bytes, which gives k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeproof.llm._common import col, near_if_small, stage_table

#: Rows and bytes of a block of queries and of one of vectors; blocks of a cell.
QUERY_BLOCK, DATA_BLOCK = (512, 256 << 10), (4096, 1 << 20)
CELL_QUERIES, CELL_DATA = 16, 32
#: Segments of each level, and the level by which groups are told apart.
LEVELS, GROUP_LEVEL = (4, 16, 32), 1
#: The sample: rows and bytes. A length of which it holds as many vectors as they have components gets a basis, so bases take twice these bytes at most.
SAMPLE_ROWS, SAMPLE_BYTES = 4096, 4 << 20
#: Pivots at most, and vectors for each of them at least.
PIVOTS, PER_PIVOT = 256, 1024
#: Query groups that are compared at a time: 20 MB.
GROUPS = 50_000
_EXACT, _LONG = float(1 << 53), float(1 << 63)
#: Share of |q| * |x| by which a rounded bound may be too low.
SLACK = 1e-6
#: A level that leaves more than this share is idle.
IDLE = 0.95


@dataclass
class Basis:
    """What the sample says of vectors of one length."""

    dim: int
    rotation: np.ndarray | None = None
    edges: list[np.ndarray] = field(default_factory=list)
    pivots: np.ndarray | None = None
    scout_ids: np.ndarray | None = None
    scouts: np.ndarray | None = None

    def turned(self, x: np.ndarray) -> np.ndarray:
        return x if self.rotation is None else x @ self.rotation


def segment_edges(energy: np.ndarray, segments: int) -> np.ndarray:
    """First components of at most so many segments of near equal energy."""
    share = np.cumsum(energy) / max(energy.sum(), 1e-300)
    return np.unique(np.concatenate(([0], np.searchsorted(share, np.arange(1, segments) / segments, "left") + 1)).clip(0, len(energy) - 1))


def chained(x: np.ndarray) -> np.ndarray:
    """The rows in an order in which each is followed by the nearest of those left, so that neighbours in it share groups."""
    norms = (x * x).sum(axis=1)
    far = norms[:, None] + norms[None, :] - 2 * x @ x.T
    order, left = [0], np.ones(len(x), bool)
    left[0] = False
    while left.any():
        order.append(int(np.where(left, far[order[-1]], np.inf).argmin()))
        left[order[-1]] = False
    return x[order]


def basis(dim: int, ids: np.ndarray | None = None, sample: np.ndarray | None = None, n_pivots: int = 1) -> Basis:
    energy, out = np.ones(dim), Basis(dim)
    if sample is not None and len(sample):
        if 1 < dim <= len(sample):
            values, vectors = np.linalg.eigh(sample.T @ sample)
            energy, out.rotation = np.maximum(values[::-1], 0) + 1e-12 * abs(values).max(), vectors[:, ::-1]
        out.scout_ids, out.scouts, out.pivots = ids, sample, chained(sample[: max(1, n_pivots)])
    out.edges = [segment_edges(energy, s) for s in LEVELS if s < dim] if dim else []
    return out


def segment_statistics(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Per row sqrt(n) * mean of each segment, then sqrt(n) * deviation; the inner product of two such rows is the bound."""
    n = np.diff(np.append(edges, x.shape[1]))
    sums = np.add.reduceat(x, edges, axis=1)
    spread = np.add.reduceat(x * x, edges, axis=1) - sums * sums / n
    return np.concatenate([sums / np.sqrt(n), np.sqrt(np.maximum(spread, 0))], axis=1)


def summary(stats: np.ndarray) -> np.ndarray:
    """Of rows of statistics: the least and the largest means, and the largest deviations."""
    half = stats.shape[1] // 2
    return np.concatenate([stats[:, :half].min(axis=0), stats[:, :half].max(axis=0), stats[:, half:].max(axis=0)])


def merged(summaries: list[np.ndarray]) -> np.ndarray:
    lo, hi, dev = np.split(np.stack(summaries), 3, axis=1)
    return np.concatenate([lo.min(axis=0), hi.max(axis=0), dev.max(axis=0)])


def summary_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The most that rows of a summary can score with rows of others: ``a`` is one summary, ``b`` has one per row."""
    lo, hi, dev = np.split(a, 3)
    los, his, devs = np.split(b, 3, axis=1)
    return (np.maximum(np.maximum(lo * los, lo * his), np.maximum(hi * los, hi * his)) + dev * devs).sum(axis=1)


def _fits(sizes: np.ndarray) -> None:
    """An error where sizes reach 2**63, in place of whole numbers that wrap."""
    if sizes.max(initial=0) >= _LONG:
        raise OverflowError("vectors are so large that a score may leave 64 bits")


def _exact(q: np.ndarray, x: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], big: bool) -> np.ndarray:
    """Products of these pairs."""
    out = np.empty(len(pairs[0]), np.int64)
    for i in range(0, len(out), 65536):
        a, b = q[pairs[0][i : i + 65536]], x[pairs[1][i : i + 65536]]
        if big:
            _fits(np.einsum("ij,ij->i", np.abs(a), np.abs(b)))
        out[i : i + 65536] = np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64)) if big else np.einsum("ij,ij->i", a, b).astype(np.int64)
    return out


class Alive:
    """The pairs of a block that are left: a mask while they are many, their places when they are few."""

    def __init__(self, shape: tuple[int, int]):
        self.shape, self.mask, self.pairs = shape, None, None

    def __len__(self) -> int:
        return len(self.pairs[0]) if self.pairs is not None else int(self.mask.sum()) if self.mask is not None else self.shape[0] * self.shape[1]

    def keep(self, q: np.ndarray, x: np.ndarray, least: np.ndarray) -> None:
        """Only those whose product of rows of ``q`` and ``x`` reaches ``least``."""
        if self.pairs is not None:
            a, b = self.pairs
            bound = np.concatenate([np.einsum("ij,ij->i", q[a[i : i + 65536]], x[b[i : i + 65536]]) for i in range(0, len(a), 65536)] or [np.zeros(0)])
            over = bound >= least[a]
            self.pairs = a[over], b[over]
            return
        over = q @ x.T >= least[:, None]
        self.mask = over if self.mask is None else self.mask & over
        if len(self) * 16 < self.mask.size:
            self.pairs = np.nonzero(self.mask)

    def scores(self, q: np.ndarray, x: np.ndarray, least: np.ndarray, own: np.ndarray, big: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, exact product) of those left that reach ``least`` and aren't the query itself; ``own`` has a 1 where ids are equal."""
        if self.pairs is None:
            whole = q.astype(np.int64) @ x.astype(np.int64).T if big else q @ x.T
            left = ~own if self.mask is None else self.mask & ~own
            if big:
                _fits((np.abs(q) @ np.abs(x).T)[left])
            over = (whole >= least[:, None]) & left
            a, b = np.nonzero(over)
            return a, b, whole[a, b].astype(np.int64)
        a, b = self.pairs
        other = ~own[a, b]
        a, b = a[other], b[other]
        return a, b, _exact(q, x, (a, b), big)


class Best:
    """The k best of each query so far: highest score, then smallest id. ``least`` is what a row has to reach; it begins at ``floors``."""

    def __init__(self, n: int, k: int, floors: np.ndarray | None = None):
        self.k, self.q, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.floors = np.full(n, -np.inf) if floors is None else floors
        self.least = self.floors

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        keep = score >= self.least[q]
        q, score, ids = (np.concatenate([a, b[keep]]) for a, b in ((self.q, q), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, q))
        q = q[order]
        first = np.searchsorted(q, q, "left")
        keep = np.arange(len(q)) - first < self.k
        self.q, self.score, self.id = q[keep], score[order][keep], ids[order][keep]
        full = np.bincount(self.q, minlength=len(self.floors)) >= self.k
        worst = np.full(len(self.floors), np.inf)
        np.minimum.at(worst, self.q, self.score.astype(np.float64))
        self.least = np.where(full, np.maximum(worst, self.floors), self.floors)


def search(query_ids: np.ndarray, queries: np.ndarray, blocks: Iterator[tuple[np.ndarray, np.ndarray]], k: int, base: Basis, floors: np.ndarray | None = None, counts: np.ndarray | None = None) -> Best:
    """The k best of each query over the blocks (ids, vectors), rows with the query's own id left out.

    ``counts`` gets added: all pairs, those left behind each level.
    """
    best = Best(len(queries), k, floors)
    turned = base.turned(queries)
    coarse = [segment_statistics(turned, e) for e in base.edges]
    most = np.abs(queries).max(initial=0)
    norms = np.sqrt((queries * queries).sum(axis=1))
    counts = np.zeros(1 + len(LEVELS), np.int64) if counts is None else counts
    seen = np.zeros((len(coarse), 2))
    for turn, (ids, x) in enumerate(blocks):
        big = most * np.abs(x).max(initial=0) * max(1, x.shape[1]) >= _EXACT
        counts[0] += len(queries) * len(x)
        alive = Alive((len(queries), len(x)))
        least = best.least - SLACK * norms * np.sqrt((x * x).sum(axis=1).max(initial=0)) - 1e-6
        around = base.turned(x)
        for level, (edges, q) in enumerate(zip(base.edges, coarse)):
            # a coarse level that has left nearly all it saw is tried in every eighth block only; the finest always is
            if level + 1 == len(coarse) or turn % 8 == 0 or seen[level, 1] < IDLE * seen[level, 0]:
                before = len(alive)
                alive.keep(q, segment_statistics(around, edges), least)
                seen[level] += before, len(alive)
            counts[1 + level] += len(alive)
        a, b, score = alive.scores(queries, x, best.least, ids[None, :] == query_ids[:, None], big)
        best.add(a, score, ids[b])
    return best


# --- the layout ---

_BLOCKS = "is_query boolean, is_group boolean, dim int, grp long, ids binary, vectors binary, floors binary, summary binary"


def _matrix(batch, rows: np.ndarray, dim: int, ends: np.ndarray, flat: np.ndarray) -> np.ndarray:
    out = np.floor(64.0 * flat[(ends[rows] - dim)[:, None] + np.arange(dim)])
    _fits(np.abs(out))
    return out


def _lists(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = batch.column("embedding")
    sizes = np.diff(lists.offsets.to_numpy())
    return sizes, np.cumsum(sizes), lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def _raw(x: np.ndarray) -> bytes:
    """Whole numbers in the narrower type that holds them exactly."""
    return x.astype(np.float32 if np.abs(x).max(initial=0) < 1 << 24 else np.float64).tobytes()


def _values(raw, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.float32 if len(raw) == 4 * n * dim else np.float64).reshape(n, dim).astype(np.float64)


def _placer(known: dict[int, Basis]):
    """(is_query, dim, pivot, vec_id, vector): each vector with its nearest pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends, flat = _lists(batch)
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                x = _matrix(batch, rows, int(dim), ends, flat)
                pivots = known[dim].pivots if dim in known else None
                near = np.zeros(len(rows), np.int32) if pivots is None else (x @ pivots.T - (pivots * pivots).sum(axis=1) / 2).argmax(axis=1).astype(np.int32)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("is_query").take(at), pa.array(np.full(len(rows), dim, np.int32)), pa.array(near), batch.column("vec_id").take(at), pa.array([_raw(row) for row in x], pa.binary())],
                    ["is_query", "dim", "pivot", "vec_id", "vector"],
                )

    return run


def _packer(known: dict[int, Basis], k: int, cell_queries: int, cell_data: int):
    """Blocks and, behind them, their groups; of rows sorted by kind, length and pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        kind, ids, held = None, [], []
        inside: list[tuple[np.ndarray, float]] = []

        def row(is_query, is_group, dim, *binary):
            return pa.RecordBatch.from_arrays([pa.array([is_query]), pa.array([is_group]), pa.array([dim], pa.int32()), pa.array([number], pa.int64()), *[pa.array([b], pa.binary()) for b in binary]], [c.split()[0] for c in _BLOCKS.split(", ")])

        def block():
            is_query, dim = kind
            base = known.get(dim) or basis(dim)
            names, x = np.array(ids, dtype=np.int64), np.stack(held)
            floors = np.full(len(x), -np.inf)
            if is_query and base.scouts is not None:
                scores = x @ base.scouts.T
                scores[names[:, None] == base.scout_ids[None, :]] = -np.inf
                if scores.shape[1] >= k:
                    floors = np.partition(scores, -k, axis=1)[:, -k]
                floors -= SLACK * np.sqrt((x * x).sum(axis=1)) * np.sqrt((base.scouts**2).sum(axis=1).max())
            level = base.edges[min(GROUP_LEVEL, len(base.edges) - 1)] if base.edges else np.zeros(min(dim, 1), np.int64)
            told = summary(segment_statistics(base.turned(x), level)) if dim else np.zeros(0)
            norm = np.sqrt((x * x).sum(axis=1).max(initial=0))
            inside.append((told, float(floors.min()), float(norm)))
            ids.clear()
            held.clear()
            yield row(is_query, False, dim, names.tobytes(), _raw(x), floors.tobytes(), np.append(told, norm).tobytes())

        def group():
            nonlocal number
            if inside:
                told = np.append(merged([s for s, *_ in inside]) if kind[1] else np.zeros(0), [max(n for *_, n in inside), min(f for _, f, _ in inside)])
                inside.clear()
                yield row(*kind[:1], True, kind[1], b"", b"", b"", told.tobytes())
                number += 1

        last = None
        for batch in batches:
            for is_query, dim, pivot, vec_id, raw in zip(*(batch.column(c).to_pylist() for c in ("is_query", "dim", "pivot", "vec_id", "vector"))):
                if (is_query, dim, pivot) != last:
                    if held:
                        yield from block()
                    if kind != (is_query, dim):
                        yield from group()
                    last, kind = (is_query, dim, pivot), (is_query, dim)
                ids.append(vec_id)
                held.append(_values(raw, 1, dim)[0])
                rows, size = QUERY_BLOCK if is_query else DATA_BLOCK
                if len(ids) >= max(1, min(rows, size // (4 * max(dim, 1)))):
                    yield from block()
                if len(inside) >= (cell_queries if is_query else cell_data):
                    yield from group()
        if held:
            yield from block()
        yield from group()

    return run


def _pairer(groups: list[tuple[int, int, np.ndarray]]):
    """(r, c): the pairs of query groups and groups of vectors in which some score can reach some query's first k-th score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [np.frombuffer(x.as_buffer(), dtype=np.float64) for x in batch.column("summary")]
            dims, numbers = batch.column("dim").to_numpy(), batch.column("grp").to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                mine = np.stack([told[i] for i in at])
                for d, r, a in groups:
                    if d == dim:
                        over = summary_bound(a[:-2], mine[:, :-2]) + SLACK * a[-2] * mine[:, -2] + 1e-6 >= a[-1]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(int(over.sum()), r, np.int64)), pa.array(numbers[at[over]])], ["r", "c"])

    return run


def _cell(known: dict[int, Basis], k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        counts = np.zeros(2 + len(LEVELS), np.int64)

        def arrays(table: pa.Table, i: int):
            dim = table.column("dim")[i].as_py()
            ids = np.frombuffer(table.column("ids")[i].as_buffer(), dtype=np.int64)
            return ids, _values(table.column("vectors")[i].as_buffer(), len(ids), dim)

        told = np.stack([np.frombuffer(x.as_buffer(), dtype=np.float64) for x in right.column("summary")]) if len(right) else None
        for i in range(len(left) if told is not None else 0):
            query_ids, queries = arrays(left, i)
            base = known.get(queries.shape[1]) or basis(queries.shape[1])
            floors = np.frombuffer(left.column("floors")[i].as_buffer(), dtype=np.float64)
            mine = np.frombuffer(left.column("summary")[i].as_buffer(), dtype=np.float64)
            bounds = summary_bound(mine[:-1], told[:, :-1]) + SLACK * mine[-1] * told[:, -1] + 1e-6
            order = [j for j in np.argsort(-bounds, kind="stable") if bounds[j] >= floors.min()]  # the most promising blocks raise the k-th scores first
            counts[0] += len(queries) * sum(len(x.as_buffer()) // 8 for x in right.column("ids"))
            best = search(query_ids, queries, (arrays(right, int(j)) for j in order), k, base, floors, counts[1:])
            parts.append(pa.table({"query_id": query_ids[best.q], "vec_id": best.id, "score": best.score}))
        parts.append(pa.table({"query_id": pa.array([None] * len(counts), pa.int64()), "vec_id": np.arange(len(counts)), "score": counts}))
        return pa.concat_tables(parts)

    return run


def _bases(rows: DataFrame) -> tuple[dict[int, Basis], int]:
    n, longest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    if not n:
        return {}, 0
    wanted = min(SAMPLE_ROWS, SAMPLE_BYTES // (4 * max(1, longest)))
    chance = F.pmod(F.xxhash64(F.lit(23), "vec_id", "embedding"), F.lit(1 << 30)) < int(min(1.0, wanted / n) * (1 << 30))
    drawn = rows.where(chance).select("vec_id", "embedding").toArrow().combine_chunks()
    known: dict[int, Basis] = {}
    for batch in drawn.to_batches():
        sizes, ends, flat = _lists(batch)
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            known[int(dim)] = basis(int(dim), batch.column("vec_id").to_numpy()[at], _matrix(batch, at, int(dim), ends, flat), min(PIVOTS, n // PER_PIVOT))
    return known, n


def searched(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, vec_id, score: the best of each query in each cell, k at most. Rows without query_id count pairs: vec_id 0 those of all cells, 1 those of
    blocks that were compared, 2 and on those that were left behind each level."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(col(vectors, "vec_id").cast("long").alias("vec_id"), col(vectors, "embedding").alias("embedding")).where("vec_id is not null and embedding is not null").where(whole)
    rows = stage_table(rows.distinct(), "rows")
    known, n = _bases(rows)
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    both = rows.select(F.lit(False).alias("is_query"), "vec_id", "embedding").union(queries.select(F.lit(True), "vec_id", "embedding"))
    placed = both.mapInArrow(_placer(known), "is_query boolean, dim int, pivot int, vec_id long, vector binary")
    key = ["is_query", "dim", "pivot"]
    salts = max(1, n // (PIVOTS * DATA_BLOCK[0]))  # a pivot's vectors, however many, lie in several tasks
    laid = placed.repartition(*key, F.pmod(F.xxhash64("vec_id"), F.lit(salts))).sortWithinPartitions(*key)
    tasks = 2 * vectors.sparkSession.sparkContext.defaultParallelism
    pivots = min(PIVOTS, n // PER_PIVOT)
    cell_queries, cell_data = (min(most, max(1, max(rows // block[0], pivots) // tasks)) for most, rows, block in ((CELL_QUERIES, n // every, QUERY_BLOCK), (CELL_DATA, n, DATA_BLOCK)))
    blocks = stage_table(laid.mapInArrow(_packer(known, k, cell_queries, cell_data), _BLOCKS), "vectors")
    groups, singles = blocks.where("is_group"), blocks.where("not is_group")
    asked, offered = groups.where("is_query"), groups.where("not is_query").select("dim", "grp", "summary")
    pairs = None
    for part in range(slices := max(1, -(-asked.count() // GROUPS))):
        told = asked.where(F.pmod(F.xxhash64("grp"), F.lit(slices)) == part).select("dim", "grp", "summary").collect()
        found = offered.mapInArrow(_pairer([(r["dim"], r["grp"], np.frombuffer(bytes(r["summary"]), dtype=np.float64)) for r in told]), "r long, c long")
        pairs = found if pairs is None else pairs.union(found)
    pairs = near_if_small(stage_table(pairs, "pairs"))
    columns = [F.col(c).alias(c) for c in ("r", "c", "dim", "ids", "vectors", "floors", "summary")]  # columns of their own on either side
    left = singles.where("is_query").withColumnRenamed("grp", "r").join(pairs, "r").select(*columns)
    right = singles.where("not is_query").withColumnRenamed("grp", "c").join(pairs, "c").select(*columns)
    return left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInArrow(_cell(known, k), "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """For each vec_id divisible by ``every`` its k best other rows: query_id, rank, vec_id, score.

    Components are floor(64 * x); the score is the inner product, ties go to the smaller vec_id. Vectors that are null or hold null or non-finite components take no part,
    nor do rows without vec_id. Wholly equal rows are one row; of rows that repeat a vec_id with other vectors, each can be found, and the query is the smallest. Vectors meet
    only those of their own length. A query without any other row has no result row; an empty table gives an empty result; other columns are ignored.
    A component of 2**63 or more is an error, and so is a pair that isn't ruled out and whose components' products, taken as positive, sum up to that: no score wraps.
    """
    found = searched(vectors, k, every).where("query_id is not null")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def pruning(vectors: DataFrame, k: int = 20, every: int = 20) -> dict[str, int]:
    """How many pairs of queries and vectors were left: in cells, in blocks, behind each level. All pairs are the first where no group was left out."""
    counts = {r["step"]: r["pairs"] for r in searched(vectors, k, every).where("query_id is null").groupBy(F.col("vec_id").alias("step")).agg(F.sum("score").alias("pairs")).collect()}
    return {name: counts.get(i, 0) for i, name in enumerate(["cells", "blocks", *(f"{s} segments" for s in LEVELS)])}
