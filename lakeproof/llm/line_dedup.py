"""Cross-site boilerplate lines by distinct-site spread, all in DataFrame expressions.

HyperLogLog sketches of the sites are merged by line hash, on the map side first, so that a line on a third of all rows costs a sketch per
task. Lines whose estimate lies within ``margin`` of the threshold get an exact distinct count; the others are decided by their
estimate, which is off by 1.6 % (one standard deviation), so ``margin`` is over ten of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeproof.llm._common import col, near_if_small, stage_table
from lakeproof.llm.url_filter import BITS_PER_KEY, bloom_passes, bloom_words

MIN_SITES = 10
MARGIN = 0.2
LG_K = 12
#: Documents with removed lines that are broadcast (with eight times as many lines), and that a Bloom filter is built of.
NEAR, BLOOM = 500_000, 8_000_000


def _bare(line: Column) -> Column:
    return F.regexp_replace(line, r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")


def _keys(line: Column) -> list[Column]:
    """A 128-bit key of a line, as two columns."""
    return [F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b")]


def boilerplate_keys(lines: DataFrame, min_sites: int, margin: float) -> DataFrame:
    """The keys (a, b) of ``lines`` (a, b, site) found on ``min_sites`` sites or more."""
    spread = lines.groupBy("a", "b").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
    spread = stage_table(spread.where(F.col("sites") >= int(min_sites * (1 - margin))), "spread")
    sure = spread.where(F.col("sites") > min_sites * (1 + margin)).select("a", "b")
    near = spread.where(F.col("sites") <= min_sites * (1 + margin)).select("a", "b")
    counted = lines.join(near, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.count_distinct("site").alias("sites"))
    return sure.union(counted.where(F.col("sites") >= min_sites).select("a", "b"))


def _marked(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """``docs``, whole texts among them, with the numbers of their removed lines in ``hits``, null if there are none.

    Few numbers are broadcast, so no text is shuffled. Of more, a Bloom filter over the documents that have any, at most ``BLOOM`` of them, tells the rest, which stay where they lie;
    only beyond that every text is shuffled.
    """
    n, numbers = hits.agg(F.count("*"), F.coalesce(F.sum(F.size("hits")), F.lit(0))).first()
    if n <= NEAR and numbers <= 8 * NEAR:
        return docs.join(F.broadcast(hits), ["h1", "h2"], "left")
    if n > BLOOM:
        return docs.join(hits, ["h1", "h2"], "left")
    bits = 1 << max(6, (BITS_PER_KEY * n - 1).bit_length())
    words = stage_table(bloom_words(hits.select(F.lit(0).alias("part"), F.col("h1").alias("key")), 0, bits, 1), "bloom").select("words").scalar()
    maybe = bloom_passes(words, F.col("h1"), 0, bits)
    return docs.where(maybe).join(hits, ["h1", "h2"], "left").unionByName(docs.where(~maybe).withColumn("hits", F.lit(None).cast("array<int>")))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, text.

    Lines end at newlines and are compared without the white space around them; empty ones always stay. A line found in the documents of at
    least ``min_sites`` values of ``source`` is removed from all. A null source is a site of its own. A null text has no lines
    and stays null; a document may become empty. Texts are read whole, however long. Repeated rows are judged each; an empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(col(docs, "doc_id").alias("doc_id"), F.coalesce(F.concat(F.lit("s"), col(docs, "source").cast("string")), F.lit("")).alias("site"), col(docs, "text").alias("text"))
    split = F.split("text", "\n", -1)
    lines = docs.select("site", F.explode(F.array_distinct(F.transform(split, _bare))).alias("line")).where("line <> ''").select(*_keys(F.col("line")), "site")
    gone = stage_table(boilerplate_keys(lines, min_sites, margin), "boilerplate")
    # a row is known by a hash of its text, not by a number that a lost task could give anew; rows of one text have the same lines
    known = docs.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(3), "text", "doc_id")})
    hits = known.where(F.col("text").isNotNull()).select("h1", "h2", F.posexplode(F.transform(split, _bare)).alias("at", "line")).where("line <> ''").select("h1", "h2", "at", *_keys(F.col("line"))).join(near_if_small(gone), ["a", "b"], "left_semi")
    hits = stage_table(hits.groupBy("h1", "h2").agg(F.collect_set("at").alias("hits")), "hits")
    marked = _marked(known, hits)
    kept = F.filter(split, lambda line, at: ~F.array_contains("hits", at))
    return marked.select(
        "doc_id", F.coalesce(F.size(split), F.lit(0)).alias("n_lines"), F.coalesce(F.size("hits"), F.lit(0)).alias("n_removed"),
        F.when(F.col("hits").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
    )
