"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

The learner sees confirmed toxic texts and unlabelled ones, whose labels it never looks at, and minimises the class-prior-corrected risk

    prior * E_P[loss(g)] + max(0, E_U[loss(-g)] - prior * E_P[loss(-g)])

by full-batch Adam in numpy. Features of a text are the presence of words and of words' beginnings, among those that confirmed texts have clearly more often than
unlabelled ones. Samples for the fit are bounded; counts of labels, and scores, are over all rows. The sample's features are counted by Spark, so that the driver sees only the few
that count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeproof.llm import _words
from lakeproof.llm._common import col, stage_table

#: Bounds of the fit: confirmed and unlabelled texts of the sample, features of the model, and features that the fit looks at in one text.
MOST_POSITIVE, MOST_UNLABELLED, MOST_FEATURES, MOST_IN_TEXT = 3000, 6000, 1 << 16, 4096
#: A sample is dealt into so many times its size places, of which each keeps one row.
PLACES = 8
PREFIXES = (4, 5, 6, 7)
#: A feature is in so many confirmed texts, and by the prior at least this share of the texts that have it is toxic.
LEAST_TEXTS, LEAST_SHARE = 2, 0.75
#: Share of the chosen features that may be there by chance; it, not a number of texts, grows stricter or laxer with the sample.
CHANCE = 0.02
SLOTS = 1 << 20


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 5 == 0


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text its distinct features, as 64-bit hashes."""
    hashes, offsets = _words.word_hashes(column, letters=True, prefixes=PREFIXES)
    for a, b in zip(offsets[:-1], offsets[1:]):
        each = np.unique(np.concatenate([h[a:b] for h in hashes]))
        yield each[1:] if len(each) and each[0] == 0 else each


@dataclass
class Model:
    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        order = np.argsort(self.hashes)
        self.hashes, self.weights = self.hashes[order], self.weights[order]
        self.maybe = np.zeros(SLOTS, bool)  # a quick look, before the search in the sorted hashes
        self.maybe[self._slots(self.hashes)] = True

    @staticmethod
    def _slots(hashes: np.ndarray) -> np.ndarray:
        return (hashes & _words.U(SLOTS - 1)).astype(np.int64)

    def scores(self, column: pa.Array) -> np.ndarray:
        """Scores of all texts, in [0, 1]; a text's length plays no part but by its words."""
        out = np.full(len(column), self.bias)
        hashes, offsets = _words.word_hashes(column, letters=True, prefixes=PREFIXES)
        rows = np.repeat(np.arange(len(column)), np.diff(offsets))
        hit_rows, hit_at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for h in hashes if len(self.hashes) else []:
            hit = np.flatnonzero(self.maybe[self._slots(h)])
            at = np.searchsorted(self.hashes, h[hit])
            at[at == len(self.hashes)] = 0
            real = (self.hashes[at] == h[hit]) & (h[hit] != 0)
            hit_rows.append(rows[hit[real]])
            hit_at.append(at[real])
        pairs = np.unique(np.concatenate(hit_rows) * np.int64(max(1, len(self.weights))) + np.concatenate(hit_at))
        if len(pairs):
            np.add.at(out, pairs // len(self.weights), self.weights[pairs % len(self.weights)])
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def risk(theta: np.ndarray, p: tuple[np.ndarray, np.ndarray], u: tuple[np.ndarray, np.ndarray], n_p: int, n_u: int, prior: float, decay: float) -> tuple[float, float, np.ndarray]:
    """Positive part and negative part of the risk at theta (weights, then bias), and the gradient to go by.

    ``p`` and ``u`` are (row, feature) pairs of confirmed and unlabelled texts. Where the negative part has fallen below zero, the gradient is that of its
    negative, which leads back; weights decay in either case.
    """
    size = len(theta) - 1
    w, b = theta[:-1], theta[-1]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    loss = lambda z: np.logaddexp(0, -z)
    g_p, g_u = (b + np.bincount(rows, weights=w[at], minlength=n) for (rows, at), n in ((p, n_p), (u, n_u)))
    positive, negative = prior * loss(g_p).mean(), loss(-g_u).mean() - prior * loss(-g_p).mean()
    d_p, d_u = -prior * sigmoid(g_p) / n_p, sigmoid(g_u) / n_u  # of the negative part
    if negative >= 0:
        d_p = d_p - prior * sigmoid(-g_p) / n_p
    else:
        d_p, d_u = -d_p, -d_u
    grad = np.empty(size + 1)
    grad[:-1] = np.bincount(p[1], weights=d_p[p[0]], minlength=size) + np.bincount(u[1], weights=d_u[u[0]], minlength=size) + decay * w
    grad[-1] = d_p.sum() + d_u.sum()
    return positive, negative, grad


def choose(known: np.ndarray, in_p: np.ndarray, in_u: np.ndarray, in_rest: np.ndarray, n_p: int, n_u: int, n_rest: int, n_known: int, prior: float) -> np.ndarray:
    """The features of the model, sorted, of candidates sorted by hash and how many confirmed, unlabelled and not confirmed unlabelled texts have each.

    ``n_known`` features are in confirmed texts at all; those that chance gives more often than one in 1 / ``CHANCE`` times need not be among the candidates.
    """
    lift = (in_p / n_p) / ((in_u + 1) / (n_u + 1))
    expected = n_p * (in_rest + 1) / (n_rest + 1)
    surprise = np.where(in_p > expected, in_p * np.log(in_p / expected) - in_p + expected, 0.0)  # bound on the log of a chance this small
    ranked = np.sort(surprise)[::-1]
    passed = np.flatnonzero(ranked >= np.log(n_known / (CHANCE * np.arange(1, len(known) + 1))))  # Benjamini and Hochberg's step-up rule
    pick = np.flatnonzero((in_p >= LEAST_TEXTS) & (prior * lift >= LEAST_SHARE) & (surprise >= ranked[passed[-1]])) if len(passed) else passed
    pick = pick[np.argsort(-in_p[pick], kind="stable")][:MOST_FEATURES]
    return np.sort(known[pick])


def places(hashes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where these features are among the sorted ones, without those that aren't."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    at = np.searchsorted(hashes, values)
    at[at == len(hashes)] = 0
    return at[hashes[at] == values]


def matrix(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs of texts' places."""
    return np.repeat(np.arange(len(found)), [len(f) for f in found]), np.concatenate(found)


def descend(hashes: np.ndarray, p: tuple[np.ndarray, np.ndarray], u: tuple[np.ndarray, np.ndarray], n_p: int, n_u: int, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 7e-5) -> Model:
    """The classifier over these features, from the (row, feature) pairs of confirmed and of unlabelled texts."""
    theta = np.zeros(len(hashes) + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    theta[-1] = -1.0
    for step in range(1, steps + 1):
        *_, grad = risk(theta, p, u, n_p, n_u, prior, decay)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(hashes, theta[:-1], float(theta[-1]))


def never() -> Model:
    """What is learnt without a confirmed text, or without any feature of one: it always says no."""
    return Model(np.zeros(0, np.uint64), np.zeros(0), -20.0)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, confirmed: list[bool] | None = None) -> Model:
    """The classifier from features of confirmed and of unlabelled texts; without confirmed ones it always says no.

    ``confirmed`` tells which of the unlabelled texts are among the confirmed ones too: what chance can do is judged by the others. :func:`train` does the same
    where the texts' features are rows of a table.
    """
    if not positive or not unlabelled:
        return never()
    known, in_p = np.unique(np.concatenate(positive), return_counts=True)
    if not len(known):
        return never()

    def among(texts: list[np.ndarray]) -> np.ndarray:
        """In how many of these texts each known feature is."""
        out = np.zeros(len(known), np.int64)
        for t in texts:
            out[places(known, t)] += 1
        return out

    rest = [t for t, c in zip(unlabelled, confirmed) if not c] if confirmed is not None else unlabelled
    hashes = choose(known, in_p, among(unlabelled), among(rest), len(positive), len(unlabelled), len(rest), len(known), prior)
    p, u = (matrix([places(hashes, t) for t in texts]) for texts in (positive, unlabelled))
    return descend(hashes, p, u, len(positive), len(unlabelled), prior)


def _featurer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _words.slices(batch, "text", 1 << 20):
            rows = [f if len(f) <= MOST_IN_TEXT else np.sort(f[np.argsort(_words.mix(f), kind="stable")[:MOST_IN_TEXT]]) for f in features(part.column("text"))]
            offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("confirmed"), part.column("doc_id"), found], ["confirmed", "doc_id", "features"])


def _placer(sent):
    """Of each sampled text the places of its features among the chosen ones, as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = sent.value
        for batch in batches:
            texts = batch.column("features")
            values, offsets = texts.flatten().to_numpy().view(np.uint64), np.concatenate(([0], np.cumsum(texts.value_lengths().to_numpy())))
            found = [places(hashes, values[i:j]).astype(np.int32).tobytes() for i, j in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("confirmed"), pa.array(found, pa.binary())], ["confirmed", "found"])

    return run


def sample(rows: DataFrame, salt: int, share: float, most: int) -> DataFrame:
    """About ``share`` of the rows (doc_id, text) and never more than ``PLACES`` * ``most``: of the rows whose hash is low enough, one for each place that hashes fall on.

    A row's chance depends on doc_id and text alone, equal rows count once, and the choice is made on the map side first.
    """
    h = F.xxhash64(F.lit(salt), "doc_id", "text")
    chosen = rows.select("doc_id", "text", h.alias("h")).where(F.pmod("h", F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30)))
    place = F.pmod(F.xxhash64("h"), F.lit(PLACES * most))
    return chosen.groupBy(place.alias("place")).agg(F.min_by(F.struct("doc_id", "text"), "h").alias("row")).select("row.doc_id", "row.text")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the rows that are not held out: confirmed toxic ones by ``labels``, and others whatever their label.

    Both samples are bounded whatever the tables hold: about ``MOST_POSITIVE`` and ``MOST_UNLABELLED`` texts, and of a text with very many features the fit looks at
    ``MOST_IN_TEXT`` of them, chosen by hash.
    """
    docs = docs.select(col(docs, "doc_id").cast("long").alias("doc_id"), F.coalesce(col(docs, "text"), F.lit("")).alias("text")).where(~held_out(F.col("doc_id")))
    labels = labels.select(col(labels, "doc_id").cast("long").alias("doc_id"), col(labels, "toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    n_labels, n_toxic = labels.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)), F.lit(0))).first()
    n_docs = docs.count()
    if not n_toxic or not n_docs:
        return never()
    place = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(PLACES * MOST_POSITIVE))
    marked = labels.where("toxic = 1").where(F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(1 << 30)) < int(min(1.0, MOST_POSITIVE / n_toxic) * (1 << 30)))
    marked = marked.groupBy(place.alias("place")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")  # at most a row for each place
    both = [sample(docs.join(F.broadcast(marked), "doc_id", "left_semi"), 5, 1.0, MOST_POSITIVE), sample(docs, 6, MOST_UNLABELLED / n_docs, MOST_UNLABELLED)]
    texts = both[0].withColumn("confirmed", F.lit(True)).union(both[1].withColumn("confirmed", F.lit(False)))
    return _learnt(stage_table(texts.mapInArrow(_featurer, "confirmed boolean, doc_id long, features array<long>"), "features"), n_toxic / n_labels)


def _learnt(sampled: DataFrame, prior: float) -> Model:
    """:func:`fit` on a written table of a sample (confirmed, doc_id, features): features are counted by Spark, and the driver gets what chance doesn't explain, then each text's places among the chosen ones."""
    spark = sampled.sparkSession
    again = sampled.where("confirmed").select("doc_id").distinct()  # as bounded as the sample of confirmed texts
    sampled = sampled.join(F.broadcast(again.withColumn("again", F.lit(True))), "doc_id", "left")
    is_p, is_u, is_rest = F.col("confirmed"), ~F.col("confirmed"), ~F.col("confirmed") & F.col("again").isNull()
    n_p, n_u, n_rest = sampled.agg(*(F.count_if(c) for c in (is_p, is_u, is_rest))).first()
    if not n_p or not n_u:
        return never()
    each = sampled.select("confirmed", "again", F.explode("features").alias("feature"))
    counts = each.groupBy("feature").agg(F.count_if(is_p).alias("in_p"), F.count_if(is_u).alias("in_u"), F.count_if(is_rest).alias("in_rest")).where("in_p > 0")
    counts = stage_table(counts, "counts")
    n_known = counts.count()
    if not n_known:
        return never()
    expected = n_p * (F.col("in_rest") + 1) / F.lit(n_rest + 1)
    surprise = F.col("in_p") * F.ln(F.col("in_p") / expected) - F.col("in_p") + expected
    likely = counts.where((F.col("in_p") > expected) & (surprise >= float(np.log(1 / CHANCE)) - 1e-6)).toArrow()
    known = likely.column("feature").to_numpy().view(np.uint64)
    order = np.argsort(known)
    in_p, in_u, in_rest = (likely.column(c).to_numpy()[order] for c in ("in_p", "in_u", "in_rest"))
    hashes = choose(known[order], in_p, in_u, in_rest, n_p, n_u, n_rest, n_known, prior)
    sent = spark.sparkContext.broadcast(hashes)
    table = sampled.select("confirmed", "features").mapInArrow(_placer(sent), "confirmed boolean, found binary").toArrow()
    sent.unpersist()
    confirmed = table.column("confirmed").to_pylist()
    found = [np.frombuffer(x.as_buffer(), dtype=np.int32) for x in table.column("found")]
    p, u = (matrix([f for f, c in zip(found, confirmed) if c is wanted]) for wanted in (True, False))
    return descend(hashes, p, u, n_p, n_u, prior)


def scorer(docs: DataFrame, model: Model):
    """A column function of text to score; the model, at most a few MB whatever the corpus, goes out once per executor."""
    sent = docs.sparkSession.sparkContext.broadcast((model.hashes, model.weights, model.bias))

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Model(*sent.value)
        for column in batches:
            parts = [known.scores(column.slice(at, 256)) for at in range(0, len(column), 256)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return F.arrow_udf(scores, "double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Empty and null texts have the score of a text without any known feature. A null doc_id is not held out, nor learnt from. Without confirmed
    labels all scores are about 0. Texts are scored whole, however long. Repeated rows are scored each; an empty table gives an empty result; other columns are ignored.
    """
    score = scorer(docs, train(docs, labels))
    out = docs.select(col(docs, "doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(col(docs, "doc_id")), F.lit(False)).alias("held_out"), score(col(docs, "text")).alias("score"))
    return out.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with a score below 0.5.

    Null and empty texts have the score of a text without any known feature, and so stay wherever clean texts do. Texts are scored whole, however long, whatever
    their doc_id; repeated rows fare alike. An empty table stays empty, and without confirmed labels all rows stay.
    """
    score = scorer(docs, train(docs, labels))
    return docs.where(score(col(docs, "text")) < 0.5)
