"""Text predicates as column expressions."""

from __future__ import annotations

import functools
import itertools
import operator
import os.path
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lakeproof.functions import fixed


def _ranges(points: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for p in sorted(set(points)):
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [tuple(r) for r in out]


def _java_class(points: list[int]) -> str:
    one = lambda p: f"\\x{{{p:X}}}"
    return "[" + "".join(one(a) if a == b else f"{one(a)}-{one(b)}" for a, b in _ranges(points)) + "]"


def _hidden_points() -> list[int]:
    """Code points that conceal text: listed ones, the tag block, and all of categories Cf and Co by this Python's tables, without those
    that scripts need or that only reorder."""
    allowed = {*fixed.BIDI, *fixed.ALLOWED_JOINERS_AND_MARKS}
    by_kind = (p for p in range(sys.maxunicode + 1) if unicodedata.category(chr(p)) in ("Cf", "Co"))
    return [p for p in {*fixed.INVISIBLE, *range(fixed.TAG_BLOCK[0], fixed.TAG_BLOCK[1] + 1), *by_kind} if p not in allowed]


def _beyond_prose() -> str:
    """A class of few ranges that has every character that conceals or reorders, and of the rest none that most prose is written in."""
    odd = {*_hidden_points(), *fixed.BIDI}
    prose = [(a, b) for a, b in ((0, 0xAC), (0xAE, 0x5FF), (0x2010, 0x2027), (0x3000, 0xD7FF)) if odd.isdisjoint(range(a, b + 1))]
    return "[^" + _java_class([p for a, b in prose for p in range(a, b + 1)])[1:]


#: Classes of characters, as ranges from one Unicode table whichever Java runs.
BEYOND_PROSE = _beyond_prose()
HIDDEN, BIDI = _java_class(_hidden_points()), _java_class(fixed.BIDI)
CONCEALED = "[" + HIDDEN[1:-1] + BIDI[1:-1] + "]"
#: Characters that compatibility composition may change, or that look like others: all but ASCII and the composed Latin letters that stand for themselves.
COMPOSABLE = r"[^\x{00}-\x{7F}\x{C0}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}]"
#: A class of few ranges, none beyond 16 bits, that has all control characters.
BEYOND_PRINT = r"[^\t\n\r\x{20}-\x{7E}\x{A0}-\x{FFFF}]"
CONTROL = r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}]"


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def once(value: Column, of) -> Column:
    """``of(value)`` with the value computed a single time, however often ``of`` uses it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def holds(text: Column, kind: str) -> Column:
    """Whether a text has a character outside a class of few ranges, given as ``[^...]``. What is inside is matched greedily up to the end, many times faster than a search that begins anew at each character."""
    return ~text.rlike(rf"\A[{kind[2:]}*\z")


def has(text: Column, pattern: str) -> Column:
    """Whether a pattern is found. Cheaper signs come first: no text without them can hold it."""
    signs = dict.fromkeys((HIDDEN, BIDI, CONCEALED), ~is_ascii(text) & holds(text, BEYOND_PROSE))
    signs |= {CONTROL: holds(text, BEYOND_PRINT), fixed.URL_PATTERN: text.contains("://"), fixed.IP_PATTERN: text.rlike("[0-9][.][0-9]")}
    found = text.rlike(pattern)
    return F.coalesce(signs[pattern] & found if pattern in signs else found, F.lit(False))


def urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(fixed.URL_PATTERN), F.lit(0))


def addresses(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(fixed.IP_PATTERN), F.lit(0))


def code_points(text: Column, kind: str) -> Column:
    """The distinct characters of a class, ascending, as ``U+0041, U+200B``."""
    found = F.array_sort(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(kind), F.lit(0))), lambda c: F.conv(F.hex(F.encode(c, "utf-32")), 16, 10).cast("int")))
    shown = F.array_join(F.transform(found, lambda p: F.concat(F.lit("U+"), F.lpad(F.hex(p), F.greatest(F.lit(4), F.length(F.hex(p))), "0"))), ", ")
    return F.when(has(text, kind), shown).otherwise("")


@F.arrow_udf(StringType())
def nfkc(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Compatibility composition; ASCII, which it never changes, goes straight through."""
    for part in parts:
        plain = pc.all(pc.fill_null(pc.string_is_ascii(part), True)).as_py()
        yield part if plain else pc.utf8_normalize(part, form="NFKC")


def lexical(text: Column) -> Column:
    """Text as instruction idioms are looked for in it: composed, look-alike letters made Latin, lower case."""
    odd = ~is_ascii(text) & holds(text, COMPOSABLE)
    composed = F.translate(nfkc(F.when(odd, text)), fixed.LOOKALIKES, fixed.LOOKALIKE_LATIN)  # other texts don't go to Python
    return F.lower(F.coalesce(composed, text))


def stems(needles: list[str]) -> list[str]:
    """The longest beginnings that needles with the same first word share: no text without one of them holds any."""
    words = itertools.groupby(sorted(needles), lambda n: n.split(" ")[0])
    return [os.path.commonprefix(list(same)) for _, same in words]


def first_of(haystack: Column, needles: list[str]) -> Column:
    """The first of the list that a text holds, or null. Only texts that hold the beginning of some are searched for all."""

    def pick(text: Column) -> Column:
        out = F.lit(None).cast("string")
        for n in reversed(needles):
            out = F.when(text.contains(n), F.lit(n)).otherwise(out)
        few = stems(needles)
        return out if len(few) == len(needles) else F.when(functools.reduce(operator.or_, map(text.contains, few)), out)

    return once(haystack, pick)


def first_instruction(lexical_text: Column) -> Column:
    return first_of(lexical_text, fixed.INSTRUCTIONS)


def normalized_template(source: Column) -> Column:
    """Newlines made one kind, white space at the ends off. Texts that have none of these are left as they are."""
    white = r"[\s\x1C-\x1F\x85\p{Z}&&[^\x{200B}]]"
    lines = F.when(source.contains("\r"), F.regexp_replace(source, "\r\n|\r", "\n")).otherwise(source)
    ends = lambda t: F.concat(F.left(t, F.lit(1)), F.right(t, F.lit(1))).rlike(white)
    return once(lines, lambda t: F.when(ends(t), F.regexp_replace(t, rf"\A{white}+|{white}+\z", "")).otherwise(t))


def template_sha256(source: Column) -> Column:
    return F.sha2(F.encode(normalized_template(source), "utf-8"), 256)


def blank_key(source: Column) -> Column:
    """A key under which texts that differ in white space only are equal."""
    return F.trim(F.regexp_replace(normalized_template(source), r"[\s\x1C-\x1F\x85\p{Z}]+", " "))
