"""URL rules and an exact host list as a Bloom filter cascade, all in DataFrame expressions.

Level 0 encodes the listed keys, level 1 the other keys of the corpus that level 0 lets through, level 2 the listed keys
that level 1 lets through, and so on until nothing wrong passes. Over the key universe that it was built from, which is every key of
the corpus, the first level without a key gives its exact membership. Each level is a sequence of 64-bit words made by bit_or, read
through a scalar subquery, so a page is judged without any join.

Keys are dealt by hash into parts, so many that a part's filters stay small. Pages are laid out by part as well, and each part's pages
meet that part's filters alone, however long the list is.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeproof.llm._common import col, stage_table

HASHES = 4
BITS_PER_KEY = 8
#: Listed keys of a part, whose level 0 then has as many bytes.
PART_KEYS = 8 << 20
#: Words of a run, which one row of the build holds.
RUN = 1 << 12
#: (rule, verdict): host, then the beginning of the path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; nulls if none does."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


@dataclass
class Level:
    bits: int
    words: DataFrame = field(repr=False)

    def of(self, part: int) -> Column:
        return self.words.where(F.col("part") == part).select("words").scalar()


def _places(key: Column, level: int, bits: int) -> list[Column]:
    a, b = F.xxhash64(F.lit(2 * level), key), F.xxhash64(F.lit(2 * level + 1), key)
    return [F.pmod(F.pmod(a, F.lit(bits)) + i * F.pmod(b, F.lit(bits)), F.lit(bits)) for i in range(HASHES)]


def bloom_passes(words: Column, key: Column, level: int, bits: int) -> Column:
    out = F.lit(True)
    for place in _places(key, level, bits):
        word = F.get(words, F.shiftright(place, 6).cast("int"))
        out = out & (F.getbit(word, F.pmod(place, F.lit(64)).cast("int")) == 1)
    return out


def bloom_words(keys: DataFrame, level: int, bits: int, parts: int) -> DataFrame:
    """(part, words): each part's 64-bit words in order. Zeros stand in for every place, so words are put in order by sorting, run by run."""
    place = keys.select("part", F.explode(F.array(*_places(F.col("key"), level, bits))).alias("place"))
    bit = F.expr("shiftleft(1L, cast(pmod(place, 64) as int))")
    n = max(1, bits >> 6)
    zeros = keys.sparkSession.range(n * parts).select(F.expr(f"cast(id div {n} as int)").alias("part"), F.expr(f"id % {n}").alias("at"), F.lit(0).cast("long").alias("word"))
    words = place.select("part", F.shiftright("place", 6).alias("at"), bit.alias("word")).union(zeros).groupBy("part", "at").agg(F.bit_or("word").alias("word"))
    runs = words.groupBy("part", (F.col("at") / RUN).cast("int").alias("run")).agg(F.sort_array(F.collect_list(F.struct("at", "word"))).getField("word").alias("words"))
    return runs.groupBy("part").agg(F.flatten(F.sort_array(F.collect_list(F.struct("run", "words"))).getField("words")).alias("words"))


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(parts)).cast("int")


def _by_part(df: DataFrame, parts: int, tag: str) -> list[DataFrame]:
    """``df`` written once, with a folder for each value of its column ``part``, and read again part by part."""
    if parts == 1:
        return [stage_table(df, tag)]
    written = stage_table(df, tag, by="part")
    return [written.where(F.col("part") == p) for p in range(parts)]


def _together(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.union, parts)


class Cascade:
    """Exact membership of ``listed`` keys for every key of ``universe``; both have one string column ``key``."""

    def __init__(self, universe: DataFrame, listed: DataFrame, part_keys: int = PART_KEYS):
        universe = universe.select("key").where("key is not null").distinct()
        listed = listed.select(F.col("key").alias("key"), F.lit(True).alias("is_listed")).where("key is not null").distinct()
        keys = stage_table(universe.join(listed, "key", "left").select("key", F.coalesce("is_listed", F.lit(False)).alias("is_listed")), "keys")
        self.levels: list[Level] = []
        count = keys.where("is_listed").count()
        self.parts = parts = max(1, -(-count // part_keys))
        keys = keys.withColumn("part", part_of(F.col("key"), parts))
        wrong, other = (_by_part(keys.where(is_).select("part", "key"), parts, "part") for is_ in ("is_listed", "not is_listed"))
        while count:
            n = len(self.levels)
            bits = 1 << max(6, (BITS_PER_KEY * count // parts - 1).bit_length())
            level = Level(bits, stage_table(bloom_words(_together(wrong), n, bits, parts), "bloom"))
            self.levels.append(level)
            passing = [o.where(bloom_passes(level.of(p), F.col("key"), n, bits)) for p, o in enumerate(other)]
            wrong, other = _by_part(_together(passing), parts, "passing"), wrong
            count = _together(wrong).count()

    def contains(self, key: Column, part: int = 0) -> Column:
        """Whether the list has ``key``, for keys of this part of the universe."""
        inside = F.lit(len(self.levels) % 2 == 1)
        for n in range(len(self.levels) - 1, -1, -1):
            level = self.levels[n]
            inside = F.when(bloom_passes(level.of(part), key, n, level.bits), inside).otherwise(F.lit(n % 2 == 1))
        return inside


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES, part_keys: int = PART_KEYS) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    The longest rule that fits decides; where none does, pages whose host ``listed`` (column ``key``) has are blocked and the others
    allowed. A null url or one without ``://`` has an empty host and path. Urls are read whole, however long. Repeated pages are judged each, whatever
    their page_id, null included; an empty table gives an empty result; other columns are ignored.
    """
    url = col(pages, "url")
    parsed = pages.select(col(pages, "page_id").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    cascade = Cascade(parsed.select(F.col("host").alias("key")), listed, part_keys)
    rule, says = longest_rule(F.col("host"), F.col("path"), rules)
    laid = [parsed] if cascade.parts == 1 else _by_part(parsed.withColumn("part", part_of(F.col("host"), cascade.parts)), cascade.parts, "pages")
    judged = [p.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, F.when(cascade.contains(F.col("host"), n), "block").otherwise("allow")).alias("verdict")) for n, p in enumerate(laid)]
    return _together(judged)


def stand_in_list(pages: DataFrame, below: str = "4") -> DataFrame:
    """A host list (column ``key``) where none is given: the hosts whose MD5 in hex sorts below ``below``, a quarter of all."""
    host = host_of(col(pages, "url"))
    return pages.select(host.alias("key")).where(F.md5(F.col("key").cast("binary")) < below).distinct()
