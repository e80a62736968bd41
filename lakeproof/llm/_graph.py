"""Connected components by alternating stars, wholly as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeproof.llm._common import stage_table


def _print(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a > b")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) with a > b, in whatever number, to (a, b) with b the smallest node that a reaches; smallest nodes have no row.

    Kiveris et al., Connected Components in MapReduce and Beyond (2014). Only minima are gathered by node, so a node
    with very many links is combined on the map side and its join can be split. Each round's edges are written to the shared folder.
    """
    edges = stage_table(edges.select("a", "b").where("a > b").distinct(), "edges")
    before = _print(edges)
    for _ in range(most_rounds):
        edges = stage_table(_small_star(_large_star(edges).distinct()).distinct(), "edges")
        after = _print(edges)
        if after == before:
            return edges
        before = after
    raise RuntimeError("components did not settle")
