"""Column builders for URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fitweave.functions.constants import TRACKING_PARAMS

# scheme, authority, path, query (the fragment is dropped)
_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 4)


def host(url: Column) -> Column:
    bare = F.regexp_replace(authority(url), r"^.*@", "")
    return F.lower(F.regexp_replace(bare, r":\d*$", ""))


def port(url: Column) -> Column:
    return F.nullif(F.regexp_extract(authority(url), r":(\d+)$", 1), F.lit(""))


def is_web_url(url: Column) -> Column:
    """http(s) with a host and without credentials; null is not safe."""
    safe = scheme(url).isin("http", "https") & (host(url) != "") & ~F.contains(authority(url), F.lit("@"))
    return F.coalesce(safe, F.lit(False))


def _decode(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def query_pairs(text: Column) -> Column:
    """Non-blank ``key=value`` parameters as array<struct<k, v>>, decoded."""
    parts = F.filter(F.split(text, "&"), lambda p: p.rlike(r"^[^=]*=."))
    return F.transform(parts, lambda p: F.struct(
        _decode(F.substring_index(p, "=", 1)).alias("k"),
        _decode(F.regexp_replace(p, r"^[^=]*=", "")).alias("v"),
    ))


def canonical_url(url: Column) -> Column:
    """Comparison form of a posting link: no tracking parameters, sorted query, no fragment."""
    kept = F.filter(query_pairs(query(url)), lambda p: ~(
        F.startswith(F.lower(p["k"]), F.lit("utm_")) | F.lower(p["k"]).isin(TRACKING_PARAMS)))
    text = F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(
        F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")
    base = F.concat(scheme(url), F.lit("://"), F.lower(authority(url)), F.regexp_replace(path(url), r"/+$", ""))
    return F.when(text != "", F.concat(base, F.lit("?"), text)).otherwise(base)


def workspace_url(url: Column) -> Column:
    """Link form used for hand-added roles: only the fragment and ``utm_`` parameters are dropped."""
    parts = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.startswith(p, F.lit("utm_")))
    text = F.array_join(parts, "&")
    base = F.concat(scheme(url), F.lit("://"), F.lower(authority(url)),
                    F.when(path(url) == "", F.lit("/")).otherwise(path(url)))
    return F.when(text != "", F.concat(base, F.lit("?"), text)).otherwise(base)


def company_apply_url(url: Column, network: str = "linkedin.com") -> Column:
    """An apply link outside the network's own hosts, else null.

    A link on the network's host is unwrapped once through its ``url`` or
    ``session_redirect`` parameter.
    """
    text = F.trim(F.regexp_replace(F.trim(_decode(url)), r"^<!--+|--+>$", ""))

    def own(u: Column) -> Column:
        return (host(u) == network) | F.endswith(host(u), F.lit("." + network))

    pairs = query_pairs(query(text))
    target = F.coalesce(
        F.try_element_at(F.filter(pairs, lambda p: p["k"] == "url"), F.lit(-1))["v"],
        F.try_element_at(F.filter(pairs, lambda p: p["k"] == "session_redirect"), F.lit(-1))["v"],
    )
    chosen = F.when(own(text), F.when(~own(target), target)).otherwise(text)
    rebuilt = F.concat(scheme(chosen), F.lit("://"), F.lower(authority(chosen)), path(chosen),
                       F.when(query(chosen) != "", F.concat(F.lit("?"), query(chosen))).otherwise(F.lit("")))
    return F.when(is_web_url(chosen), rebuilt)
