"""Column builders for HTML text."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from fitweave.functions.constants import NULL_WORDS
from fitweave.functions.text import let, literal_array, squeeze, strip

def clean_text(value: Column) -> Column:
    """Trimmed text; blanks and null-like words become null."""
    text = strip(value.cast("string"))
    return F.when((text != "") & ~F.lower(text).isin(NULL_WORDS), text)


_SEAM = "\u0002"
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;\u0002]{1,32};?)"
#: Names that count without a semicolon, too, longest first.
_BARE = "|".join(sorted((name for name in html5 if not name.endswith(";")), key=lambda name: (-len(name), name)))
#: Control numbers that stand for the characters of an old code page.
_OLD = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}


def _named() -> Column:
    """Names of the standard's entities -> characters, as one folded constant."""
    return F.from_json(F.lit(json.dumps({name: value for name, value in html5.items()})), "map<string,string>")


def _character(code: Column) -> Column:
    """Character of a number: old control numbers are mapped, impossible ones are U+FFFD, those that stand for nothing vanish."""
    nothing = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    impossible = code.isNull() | (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    old = F.element_at(literal_array([_OLD[n] for n in sorted(_OLD)]), (code - 0x7F).cast("int"))
    return F.when(impossible, "\ufffd").when(code.between(0x80, 0x9F), old).when(nothing, "").otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def _meaning(reference: Column) -> Column:
    """Text of one reference: a number, a whole name, or the longest name without semicolon that it begins with."""
    digits = F.regexp_extract(reference, "^&#[xX]?0*([0-9a-fA-F]*)", 1)  # of more than seven digits no number is a character
    code = F.when(F.length(digits) > 7, F.lit(None).cast("bigint")).when(digits == "", F.lit(0).cast("bigint")).when(reference.rlike("^&#[xX]"), F.conv(digits, 16, 10).cast("bigint")).otherwise(digits.try_cast("bigint"))
    name = F.substring(reference, 2, 40)
    begins = F.regexp_extract(name, f"^(?:{_BARE})", 0)
    short = F.when(begins != "", F.concat(F.element_at(_named(), begins), F.substr(name, F.length(begins) + 1))).otherwise(reference)
    return F.when(reference.startswith("&#"), let(code, _character)).otherwise(F.coalesce(F.when(F.endswith(name, F.lit(";")), F.element_at(_named(), name)), short))


def unescape(text: Column) -> Column:
    """Named and numeric character references, from left to right in one pass: what a reference spells is not read again."""
    def joined(t: Column) -> Column:
        between, found = F.split(t, _REFERENCE), F.regexp_extract_all(t, F.lit(_REFERENCE), F.lit(0))
        distinct = F.array_distinct(found)
        known = F.map_from_arrays(distinct, F.transform(distinct, _meaning))
        return let(known, lambda k: F.array_join(F.zip_with(between, found, lambda before, r: F.concat(before, F.coalesce(F.element_at(k, r), F.lit("")))), ""))

    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), joined(t)).otherwise(t))


def plain_text(value: Column, limit: int | None = None) -> Column:
    """Listing markup -> lines of text; script and style bodies vanish, block tags end lines."""
    text = unescape(unescape(clean_text(value)))
    text = F.regexp_replace(text, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?i)</?(?:p|div|li)(?=[\s/>])[^>]*>|<(?:br|h1|h2|h3)(?=[\s/>])[^>]*>", "\n")
    # references between tags are read once more; a tag that vanishes must not make two halves one reference
    text = F.replace(unescape(F.regexp_replace(text, r"</?[A-Za-z][^>]*>|<![^>]*>", _SEAM)), F.lit(_SEAM), F.lit(""))
    lines = F.filter(F.transform(F.split(text, r"[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"), squeeze), lambda v: v != "")
    joined = F.array_join(lines, "\n")
    return F.nullif(F.left(joined, F.lit(limit)) if limit else joined, F.lit(""))


def block_text(fragment: Column) -> Column:
    """Text of a page fragment with list bullets kept."""
    text = F.regexp_replace(fragment, r"(?is)<(script|style|button|svg|noscript)\b[^>]*>.*?</\1\s*>", "")
    text = F.regexp_replace(text, r"(?i)<li(?=[\s/>])[^>]*>", "\n• ")
    text = F.regexp_replace(text, r"(?i)</li\s*>|<br\s*/?>|</?(?:p|div|section|ul|ol|h[1-5]|tr)(?=[\s/>])[^>]*>", "\n")
    text = unescape(F.regexp_replace(text, r"</?[A-Za-z][^>]*>|(?s)<!--.*?-->", ""))
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r" *\n *", "\n")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def clean_description(text: Column) -> Column:
    """No "about the job" heading; texts under 20 characters are no description."""
    text = strip(F.regexp_replace(text, r"(?i)^about the job[ \n:\-]*", ""))
    return F.when(F.length(text) >= 20, text)
