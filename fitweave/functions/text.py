"""Column builders for text: keys, boundaries, lines, numbers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def quote(label: str) -> str:
    """Escape a literal for a Java pattern."""
    return re.sub(r"([\\.\[\]{}()*+?^$|#&~-])", r"\\\1", label)


def word_cues(alternatives: str) -> str:
    """Whole-word, case-insensitive Unicode pattern over the alternatives."""
    return rf"(?iU)\b(?:{alternatives})\b"


def skill_key(name: Column) -> Column:
    """Comparison key of a skill label: lower case, '&' as 'and', separators as one blank."""
    text = F.replace(F.lower(F.trim(name)), F.lit("&"), F.lit(" and "))
    text = F.regexp_replace(text, r"[/_\-]+", " ")
    text = F.regexp_replace(text, r"[^a-z0-9+.# ]+", "")
    return F.trim(F.regexp_replace(text, r" +", " "))


def let(value: Column, build) -> Column:
    """Evaluate ``value`` once and use it inside higher-order functions.

    An outer expression named inside a lambda is computed again for every
    element; as the variable of a one-element array it is computed once.
    """
    return F.get(F.transform(F.array(value), build), F.lit(0))


def strip(text: Column) -> Column:
    """Trim every kind of blank, not only spaces."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def squeeze(text: Column) -> Column:
    """All runs of blanks become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def snippets(body: Column, quote_chars: int | None = None) -> Column:
    """Sentences and lines of a text, without bullets; blank ones are left out.

    ``quote_chars`` clips each quote (off by default, so whole texts are read).
    """
    parts = F.filter(F.split(body, r"\n+|(?<=[.!?;])\s+"), lambda s: s.rlike(r"(?U)\S"))
    parts = F.transform(parts, lambda s: F.btrim(s, F.lit(" \t-•")))
    return F.transform(parts, lambda s: F.left(s, F.lit(quote_chars))) if quote_chars else parts


def quoted(label: Column) -> Column:
    """Column form of :func:`quote`."""
    return F.regexp_replace(label, r"([\\.\[\]{}()*+?^$|#&~-])", r"\\$1")


def distinct_ignoring_case(values: Column, limit: int | None = None) -> Column:
    """Trimmed non-blank values, first spelling of each kept, in order."""
    clean = F.filter(F.transform(values, lambda v: strip(v)), lambda v: v != "")
    def first_spellings(words: Column) -> Column:
        ranked = F.sort_array(F.transform(words, lambda v, i: F.struct(F.lower(v).alias("k"), i.alias("i"))))
        firsts = let(ranked, lambda r: F.filter(r, lambda x, j: ~F.get(r, j - 1)["k"].eqNullSafe(x["k"])))
        return F.transform(F.sort_array(F.transform(firsts, lambda x: x["i"])), lambda i: F.get(words, i))
    kept = let(clean, first_spellings)
    return F.slice(kept, 1, limit) if limit else kept


def language_tokens(text: Column) -> Column:
    """Lower-case letter runs."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{Nl}\p{No}]+"), F.lit(0)), F.lower)


def literal(value) -> str:
    """SQL form of a fixed string, number or list; whole tables parse in one call."""
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(literal(v) for v in value) + ")"
    if isinstance(value, bool) or not isinstance(value, str):
        return str(value).lower()
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_map(values: dict) -> Column:
    """Fixed dictionary as a map literal."""
    return F.expr("map(" + ", ".join(f"{literal(k)}, {literal(v)}" for k, v in values.items()) + ")")


def literal_array(values: list) -> Column:
    return F.expr(literal(values))
