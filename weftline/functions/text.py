"""Text expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null gives null."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.size(tokens(text)), F.lit(0)).cast("long")


def shingles(words: Column, n: int) -> Column:
    """Distinct runs of n words joined by a blank; fewer than n words are one run, none give an empty array."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def normalised(text: Column) -> Column:
    """Control characters out, runs of white space to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0E-\x1F\x7F]", ""), r"[ \t\r\n\x0B\f]+", " "))


#: Characters whose full upper case is more than one character, and the single one that stands for them in other engines.
_EXPANDED = {c: {"\u00df": "\u1e9e"}.get(c, c.title() if len(c.title()) == 1 else c) for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)]) if len(c.upper()) > 1}


def upper(text: Column) -> Column:
    """Upper case character by character, as DuckDB has it: F.upper() makes two letters of a sharp s and of ligatures."""
    these = "[" + "".join(_EXPANDED) + "]"
    single = F.create_map(*(F.lit(x) for pair in _EXPANDED.items() for x in pair))
    parts = F.split(text, f"(?<={these})|(?={these})")
    whole = F.array_join(F.transform(parts, lambda p: F.when(p.rlike(f"^{these}$"), F.try_element_at(single, p)).otherwise(F.upper(p))), "")
    return F.when(text.rlike(these), whole).otherwise(F.upper(text))


def hash_share(key: Column) -> Column:
    """A number from 0 to 2**32 - 1 that other engines can compute too: the first 8 hex digits of the md5."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def fill(template: str, values: dict[str, Column]) -> Column:
    """The template with each {name} replaced; unknown names stay."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out
