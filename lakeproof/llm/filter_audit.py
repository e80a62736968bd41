"""How filters interact when they are applied one after another in every order, by aggregating the edges of their lattice.

A document is reduced to a bit mask of the filters that it fails. Documents of one part with the same mask and labels count as one row with a number; such a row
contributes to each edge (subset of filters that were already applied, next filter): n * 2 ** (n - 1) edges, 80 for five filters. An order of the filters is a
path through that lattice, so the steps of all orders, 600, get their counts by a join with the edges.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeproof.llm._common import SPACE_CLASS, col, join_classes, near_if_small, stage_table

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """The four filters that see one text alone: under 50 words, few distinct words, many capitals, signs of code or markup."""
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 65 * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > 5 * F.char_length(text).cast("long"),
        "D": F.regexp_like(text, F.lit("[#$%&*|]")),
    }


def document_failures(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, part, fails_A to fails_E.

    The part is the source; null sources and texts count as the empty string. A document fails E if a smaller doc_id of the table has the same text; a row
    without doc_id neither fails it nor makes others fail. Texts are read whole, however long; equal texts are known by their SHA-256.
    """
    rows = docs.select(col(docs, "doc_id").cast("long").alias("doc_id"), *[F.coalesce(col(docs, c).cast("string"), F.lit("")).alias(n) for c, n in (("source", "part"), ("text", "text"))])
    rows = rows.withColumn("words", F.filter(F.split("text", SPACE_CLASS + "+"), lambda w: w != ""))
    alone = [f.alias(f"fails_{name}") for name, f in text_failures(F.col("text"), F.col("words")).items()]
    rows = stage_table(rows.select("doc_id", "part", *alone, F.unhex(F.sha2(F.encode("text", "utf-8"), 256)).alias("digest")), "failures")
    classes = stage_table(rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1"), "texts")
    return join_classes(rows, classes, ["digest"], "left").select("doc_id", "part", *[f"fails_{x}" for x in "ABCD"], F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("fails_E"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` (doc_id, ...) with good and toxic from ``labels``; of several labels of one doc_id any counts, without one a row is neither."""
    said = labels.select(col(labels, "doc_id").cast("long").alias("doc_id"), (col(labels, "quality") == 1).alias("good"), (col(labels, "toxic") == 1).alias("toxic"))
    said = said.where("doc_id is not null and (good or toxic)").groupBy("doc_id").agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("good", "toxic")])
    said = near_if_small(stage_table(said, "labels"))
    return rows.join(said, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def lattice_audit(rows: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """For each part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``rows`` has part, a boolean fails_X for each letter X of ``filters``, good and toxic; a null there counts as false, a null part as the empty string. Every part of ``rows``
    has all its steps, with zeros where nothing happens; an empty table gives an empty result. Six filters are 4,320 steps a part; more than seven aren't taken.
    """
    n = len(filters)
    if not 0 < n <= 7 or len(set(filters)) != n:
        raise ValueError("between one and seven different filters")
    mask = sum((F.when(F.col(f"fails_{f}"), 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    # a document's part in every edge depends on its mask and labels alone: at most 2 ** n * 4 rows of a part, combined on the map side
    profiles = rows.select(F.coalesce("part", F.lit("")).alias("part"), mask.alias("mask"), *flags).groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    edges = [(sum(1 << i for i in before), k) for k in range(n) for size in range(n) for before in itertools.combinations([i for i in range(n) if i != k], size)]
    lattice = F.expr("array(" + ",".join(f"named_struct('done', {done}, 'next', {k}, 'bit', {1 << k})" for done, k in edges) + ")")
    met = profiles.select("*", F.inline(lattice))
    here = F.col("mask").bitwiseAND(F.col("bit")) != 0
    earlier = F.col("mask").bitwiseAND(F.col("done")) != 0
    tally = lambda when, name: F.sum(F.when(when, F.col("n")).otherwise(0)).alias(name)
    counted = met.groupBy("part", "done", "next").agg(
        tally(~here & ~earlier, "kept"), tally(here & ~earlier, "removed"), tally(here & earlier, "redundant"), tally(F.col("mask") == F.col("bit"), "unique_fails"),
        tally(here & ~earlier & F.col("good"), "good_lost"), tally(here & ~earlier & F.col("toxic"), "toxic_lost"),
    )
    paths = [("".join(filters[i] for i in path), step + 1, sum(1 << i for i in path[:step]), k) for path in itertools.permutations(range(n)) for step, k in enumerate(path)]
    steps = F.broadcast(rows.sparkSession.createDataFrame(paths, "filter_order string, step int, done int, next int"))  # n! * n rows
    walked = counted.join(steps, ["done", "next"])
    # an edge lies on as many paths as there are orders of what came before and of what comes after it
    on = {size: len(list(itertools.permutations(range(size)))) * len(list(itertools.permutations(range(n - 1 - size)))) for size in range(n)}
    weight = F.element_at(F.expr("map(" + ",".join(f"{k}, {v}L" for k, v in on.items()) + ")"), F.bit_count("done"))
    shares = counted.groupBy("part", "next").agg(F.sum(F.col("removed") * weight).alias("shapley"))
    return walked.join(shares, ["part", "next"]).select("part", "filter_order", "step", *COUNTS, "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """:func:`lattice_audit` of the five filters over ``docs``; repeated rows count each, columns that play no part are ignored."""
    return lattice_audit(labelled(document_failures(docs), labels))
