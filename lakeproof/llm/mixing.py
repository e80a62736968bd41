"""Temperature mixing of sources.

Weights are token shares to the power alpha, normalised. alpha is bisected between 0 (uniform) and 1 (proportional) to the target entropy, or
to the flattest mixture in which no source repeats more often than a limit. A source's budget of tokens is then realised as epochs. In each, its
documents are dealt into blocks, blocks follow one another in the epoch's own permutation, and documents within a block in theirs. The last epoch ends where the
budget does: whole blocks up to the one that holds the end, and in that one single documents. All choices are hashes, so texts never move.

The driver holds no source's total: it sees the least and the largest of them, and sums over all sources at a few exponents at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeproof.llm._common import col, fresh, stage_table

BLOCKS = 4096
#: UTF-8 bytes that count as a token where no counts are given.
BYTES_PER_TOKEN = 4
#: Rows of some 40 bytes that are broadcast at most; beyond it the same joins shuffle.
BROADCAST_ROWS = 64 * BLOCKS
#: Exponents that one pass over the sources' totals tries, and passes: an interval is cut to 1 / 16 each time, to 2**-60 in all.
TRIED, PASSES = 15, 15


@dataclass
class Totals:
    """What a mixture needs to know of the sources' token totals; ``sums`` gives for each exponent a the sums of (t / most) ** a, and of that times ln(t / most)."""

    least: int
    most: int
    sums: Callable[[list[float]], list[tuple[float, float]]]


@dataclass
class Mixture:
    """A source of t tokens has weight (t / most) ** alpha / norm, and is shown budget * weight / t times."""

    alpha: float
    norm: float
    most: int
    budget: float

    def weight(self, t):
        return (t / self.most) ** self.alpha / self.norm

    def repeats(self, t):
        return self.budget * self.weight(t) / t


def totals_of(tokens: list[int]) -> Totals | None:
    """Totals of sources that are at hand; those without tokens take no part."""
    tokens = [t for t in tokens if t > 0]
    if not tokens:
        return None
    top = max(tokens)
    logs = [math.log(t / top) for t in tokens]
    return Totals(min(tokens), top, lambda alphas: [(math.fsum(math.exp(a * x) for x in logs), math.fsum(math.exp(a * x) * x for x in logs)) for a in alphas])


def entropy(alpha: float, norm: float, first: float) -> float:
    """Entropy in nats of weights e**(alpha * x) / norm, where ``first`` is the sum of e**(alpha * x) * x."""
    return math.log(norm) - alpha * first / norm


def _last_that(holds: Callable[[list[float]], list[bool]]) -> float:
    """The largest exponent in [0, 1] for which a condition holds that holds up to somewhere; 0 if it never does."""
    at_zero, at_one = holds([0.0, 1.0])
    if at_one or not at_zero:
        return 1.0 if at_one else 0.0
    lo, hi = 0.0, 1.0
    for _ in range(PASSES):
        inside = [lo + (hi - lo) * k / (TRIED + 1) for k in range(1, TRIED + 1)]
        good = sum(holds(inside))
        lo, hi = [lo, *inside][good], [*inside, hi][good]
    return lo


def solve(totals: Totals, max_repeat: float | None = 2.0, target_entropy: float | None = None, budget: float | None = None) -> Mixture:
    """The mixture of these sources.

    ``budget`` is in tokens; without it, it is the least with which every source is seen in full at least once. ``target_entropy`` in nats goes before
    ``max_repeat``; beyond what alpha in [0, 1] can reach, its nearer end holds.
    """
    ratio = totals.most / totals.least

    def norms(alphas: list[float]) -> list[float]:
        return [n for n, _ in totals.sums(alphas)]

    if target_entropy is not None:
        alpha = _last_that(lambda alphas: [entropy(a, *s) >= target_entropy for a, s in zip(alphas, totals.sums(alphas))])
    elif max_repeat is None:
        alpha = 0.0
    elif budget is None:  # the largest source is shown once, the smallest most often
        alpha = 1 - _last_that(lambda falls: [ratio**f <= max_repeat for f in falls])
    else:
        alpha = 1 - _last_that(lambda falls: [budget / n * ratio**f / totals.most <= max_repeat for f, n in zip(falls, norms([1 - f for f in falls]))])
    norm = norms([alpha])[0]
    return Mixture(alpha, norm, totals.most, budget if budget is not None else totals.most * norm)


def _unit(*of: Column) -> Column:
    """A hash in [0, 2**62)."""
    return F.pmod(F.xxhash64(*of), F.lit(1 << 62))


def estimated_tokens(text: Column) -> Column:
    """A text's UTF-8 bytes / 4, rounded up: near what byte-level ids come to, in scripts with and without spaces. Empty and null texts have none."""
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / BYTES_PER_TOKEN).cast("long")


def _totals(sources: DataFrame) -> Totals | None:
    """The same as :func:`totals_of`, for a written table with a column t."""
    own = sources.where("t > 0")
    least, most = own.agg(F.min("t"), F.max("t")).first()
    if most is None:
        return None
    log = F.log(F.col("t") / float(most))

    def sums(alphas: list[float]) -> list[tuple[float, float]]:
        raised = [F.exp(F.lit(a) * log) for a in alphas]
        row = own.agg(*[F.sum(x) for r in raised for x in (r, r * log)]).first()
        return list(zip(row[::2], row[1::2]))

    return Totals(least, most, sums)


def mix(docs: DataFrame, max_repeat: float | None = 2.0, target_entropy: float | None = None, budget: float | None = None, tokens: Column | None = None, seed: int = 17, details: bool = False) -> DataFrame:
    """``docs``, all columns, each row as often as the mixture has it; with ``details`` also source_key, tokens, weight, epoch, block, mix_order.

    Sorting by mix_order interleaves the sources in proportion. A null source is a source of its own. Rows without tokens, as empty and null texts are,
    belong to their source's epochs at no cost; a source without any tokens passes once. Null doc_ids are rows like others. Repeated rows are each repeated; those that
    tie at a budget's end go together. Without ``tokens`` a text counts as its UTF-8 bytes / 4, whatever its length. An empty table gives an empty one.
    """
    key, count, block, place, epoch, weight, order = fresh(docs, "source_key", "tokens", "block", "place", "epoch", "weight", "mix_order")
    text = col(docs, "text")
    source = F.coalesce(F.concat(F.lit("s:"), col(docs, "source").cast("string")), F.lit("null"))
    spread = _unit(F.lit(seed), col(docs, "doc_id"), text)
    marked = docs.withColumns({key: source, count: estimated_tokens(text) if tokens is None else tokens.cast("long"), block: F.pmod(spread, F.lit(BLOCKS)).cast("int"), place: spread})
    narrow = stage_table(marked.select(F.col(key).alias("s"), F.col(count).alias("t"), F.col(block).alias("b"), F.col(place).alias("h")), "mix")
    per_block = stage_table(narrow.groupBy("s", "b").agg(F.sum("t").alias("t")), "blocks")
    sums = stage_table(per_block.groupBy("s").agg(F.sum("t").alias("t")), "sources")
    totals = _totals(sums)
    own, times_shown = F.lit(0.0), F.lit(1.0)
    if totals is not None:
        mixture = solve(totals, max_repeat, target_entropy, budget)
        own = F.when(F.col("t") > 0, F.pow(F.col("t") / float(mixture.most), F.lit(mixture.alpha)) / mixture.norm).otherwise(0.0)
        times_shown = F.when(F.col("t") > 0, mixture.budget * F.col("weight") / F.col("t")).otherwise(1.0)
    sources = sums.select("s", F.col("t").alias("total"), own.alias("weight"), F.col("t")).withColumn("times", times_shown).withColumn("full", F.floor(F.col("times") + 1e-9).cast("int"))
    sources = sources.select("s", "weight", "times", "full", F.when(F.col("times") - F.col("full") > 1e-9, (F.col("times") - F.col("full")) * F.col("total")).otherwise(0.0).alias("want"))
    n_sources = sums.count()
    near = lambda df, rows=BLOCKS: F.broadcast(df) if n_sources * rows <= BROADCAST_ROWS else df
    turn = Window.partitionBy("s").orderBy(_unit(F.lit(seed), "s", "full", "b"), "b")
    plan = per_block.join(near(sources, 1), "s").withColumn("upto", F.sum("t").over(turn))
    plan = plan.withColumn("within", (F.col("want") > 0) & (F.col("upto") <= F.col("want"))).withColumn("partly", ~F.col("within") & (F.col("upto") - F.col("t") < F.col("want")))
    plan = stage_table(plan.select("s", "b", "weight", "times", "full", "within", "partly", (F.col("want") - F.col("upto") + F.col("t")).alias("rest")), "plan")
    ends = narrow.join(near(plan.where("partly").select("s", "b", "rest"), 1), ["s", "b"])  # one block of each source
    ends = ends.groupBy("s", "b", "h", "rest").agg(F.sum("t").alias("t"))  # equal rows, of which there may be many, count as one
    inner = Window.partitionBy("s", "b").orderBy("h")
    cuts = ends.withColumn("upto", F.sum("t").over(inner)).where("upto <= rest").groupBy("s", "b").agg(F.max("h").alias("cut"))
    plan = stage_table(plan.join(near(cuts, 1), ["s", "b"], "left").select(F.col("s").alias("ps"), F.col("b").alias("pb"), F.col("weight").alias("pw"), "times", "full", "within", "cut"), "cuts")
    out = marked.join(near(plan), (F.col(key) == F.col("ps")) & (F.col(block) == F.col("pb")))
    extra = F.when(F.col("within") | F.coalesce(F.col(place) <= F.col("cut"), F.lit(False)), 1).otherwise(0)
    out = out.withColumn(weight, F.col("pw")).withColumn(epoch, F.explode(F.when(F.col("full") + extra > 0, F.sequence(F.lit(0), F.col("full") + extra - 1)).otherwise(F.array().cast("array<int>"))))
    turn_at = _unit(F.lit(seed), F.col(key), F.col(epoch), F.col(block)) / float(1 << 62)
    out = out.withColumn(order, (F.col(epoch) + turn_at) / F.col("times"))
    columns = docs.columns + ([key, count, weight, epoch, block, order] if details else [])
    return out.select(*[col(out, c) for c in columns])
