"""Fill-in-the-middle by escaped marker injection, all in DataFrame expressions.

A text is cut into units, words with the white space before them. A delimiter that the text itself holds only in escaped form is put after each unit
by one regular expression; the growth of the text counts the units; the parts before, between and after two hashed ranks are cut out by
``substring_index``, lose their delimiters and escapes, and are put together around the markers in one of two orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeproof.llm._common import col, fresh

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A unit: a word with the white space before it, or what white space is left at the end.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: The delimiter and the letter that escapes both; neither is white space, so an escaped text has the units of the text itself.
_CUT, _ESCAPE = "\x01", "\x02"


def _escaped(text: Column) -> Column:
    """``text`` without the delimiter: each escape letter is followed by 0, each delimiter is an escape letter and 1."""
    return F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "0")), F.lit(_CUT), F.lit(_ESCAPE + "1"))


def _plain(part: Column) -> Column:
    """A part of a marked text as it was."""
    bare = F.replace(part, F.lit(_CUT), F.lit(""))
    return F.replace(F.replace(bare, F.lit(_ESCAPE + "1"), F.lit(_CUT)), F.lit(_ESCAPE + "0"), F.lit(_ESCAPE))


def _first(marked: str, units: str) -> str:
    """SQL for the first so many units of a marked text, without the last delimiter."""
    return f"substring_index({marked}, '\\u0001', {units})"


def _last(marked: str, units: str) -> str:
    """SQL for the last so many delimiters' worth of a marked text."""
    return f"substring_index({marked}, '\\u0001', -({units}))"


def fill_in_middle(docs: DataFrame, rate: int = 50, spm_rate: int = 80, seed: int = 42) -> DataFrame:
    """The rows of ``docs``, all columns, and after them n, form, prefix, middle, suffix and output (under other names where these are taken).

    ``rate`` per cent of the texts are rearranged, of these ``spm_rate`` per cent with the suffix first; both and the two cuts come from hashes of
    ``seed`` and doc_id alone. An empty text, and one that holds a marker, stays plain: its parts are null and its output is the text. A null text counts
    as empty, so its output is the empty string; a null doc_id is hashed as no digits at all. Repeated rows fare alike. Texts are taken whole, however long;
    words and white space of any length are one unit. An empty table gives an empty result.
    """
    n, form, prefix, middle, suffix, output, text, marked, size, low, high, hexed, h1, h2, h3, h4 = fresh(
        docs, "n", "form", "prefix", "middle", "suffix", "output", "fim_text", "fim_marked", "fim_size", "fim_low", "fim_high", "fim_hex", "fim_h1", "fim_h2", "fim_h3", "fim_h4"
    )
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(col(docs, "doc_id").cast("long").cast("string"), F.lit(""))), 256)
    out = docs.withColumns({text: F.coalesce(col(docs, "text"), F.lit("")), hexed: digest})
    out = out.withColumns({h: F.conv(F.substring(hexed, 8 * i + 1, 8), 16, 10).cast("long") for i, h in enumerate((h1, h2, h3, h4))})
    out = out.withColumn(marked, _escaped(F.col(text)))
    # the text's length in code points before and after the marking differ by the number of units
    out = out.withColumns({marked: F.regexp_replace(marked, UNIT, f"$0{_CUT}"), size: F.char_length(marked)})
    out = out.withColumn(n, (F.char_length(marked) - F.col(size)).cast("long"))
    has_marker = F.contains(F.col(text), F.lit(PREFIX)) | F.contains(F.col(text), F.lit(SUFFIX)) | F.contains(F.col(text), F.lit(MIDDLE))
    plain = (F.col(n) == 0) | (F.col(h3) % 100 >= rate) | has_marker
    out = out.withColumns({
        form: F.when(plain, "plain").when(F.col(h4) % 100 < spm_rate, "spm").otherwise("psm"),
        low: F.least(F.col(h1) % (F.col(n) + 1), F.col(h2) % (F.col(n) + 1)).cast("int"),
        high: F.greatest(F.col(h1) % (F.col(n) + 1), F.col(h2) % (F.col(n) + 1)).cast("int"),
    })
    moved = F.col(form) != "plain"
    part = lambda sql: F.when(moved, _plain(F.expr(sql)))
    out = out.withColumns({
        prefix: part(_first(marked, low)),
        middle: part(_last(_first(marked, high), f"{high} - {low}")),
        suffix: part(_last(marked, f"{n}::int - {high} + 1")),
    })
    p, m, s = F.col(prefix), F.col(middle), F.col(suffix)
    out = out.withColumn(
        output,
        F.when(F.col(form) == "psm", F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m))
        .when(F.col(form) == "spm", F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m))
        .otherwise(F.col(text)),
    )
    return out.drop(text, marked, size, low, high, hexed, h1, h2, h3, h4)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. A marker occurs once each in a rearranged text, so what lies around it is told by it."""
    first, second = F.when(form == "psm", F.lit(PREFIX)).otherwise(F.lit(SUFFIX)), F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    head, middle = F.split_part(output, F.lit(MIDDLE), F.lit(1)), F.split_part(output, F.lit(MIDDLE), F.lit(2))
    one = F.split_part(F.split_part(head, second, F.lit(1)), first, F.lit(2))
    two = F.split_part(head, second, F.lit(2))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
