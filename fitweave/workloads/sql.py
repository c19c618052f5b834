"""SQL fragments shared by the oracles."""

from __future__ import annotations

import re

from fitweave.functions.vocabulary import ALIAS_GROUPS, GENERIC_TERMS
from fitweave.operators.skills import _CANONICAL, _ROLES, base_labels, plain_key


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


def rows(values) -> str:
    def cell(v):
        return text(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else "NULL" if v is None else str(v)
    return "VALUES " + ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in values)


def key(x: str) -> str:
    x = f"replace(lower(trim({x})), '&', ' and ')"
    x = f"regexp_replace({x}, '[/_\\-]+', ' ', 'g')"
    x = f"regexp_replace({x}, '[^a-z0-9+.# ]+', '', 'g')"
    return f"trim(regexp_replace({x}, ' +', ' ', 'g'))"


def escape(label: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", label)


def escape_column(x: str) -> str:
    return f"regexp_replace({x}, '([\\\\.\\[\\]{{}}()*+?^$|])', '\\\\\\1', 'g')"


def ascii_pattern(label: str) -> str:
    return "(^|[^a-z0-9])" + escape(label.lower()) + "([^a-z0-9]|$)"


GENERIC = in_list(sorted({plain_key(t) for t in GENERIC_TERMS}))
CANON = f"canon(key, canonical) AS ({rows(_CANONICAL.items())})"
ROLES = f"roles(key, family, umbrella) AS ({rows((k, f, u) for k, (f, u) in _ROLES.items())})"
VOCABULARY = "vocabulary(ord, label, key, pattern) AS (" + rows(
    (i, label, plain_key(label), ascii_pattern(label)) for i, label in enumerate(base_labels())) + ")"


def azure_cut(x: str) -> str:
    return f"regexp_replace({x}, '\\bazure\\s+(devops|pipelines)\\b', '', 'gi')"


def mentions(docs: str, doc_key: str, column: str) -> str:
    """(doc_key, ord, label, key) of base labels in a text column."""
    body = f"CASE WHEN v.key = 'azure' THEN {azure_cut('lower(d.' + column + ')')} ELSE lower(d.{column}) END"
    return (f"SELECT d.{doc_key}, v.ord, v.label, v.key FROM {docs} d CROSS JOIN vocabulary v "
            f"WHERE contains(lower(d.{column}), lower(v.label)) AND regexp_matches({body}, v.pattern) "
            f"OR (length(d.{column}) < 200 AND {key('d.' + column)} = v.key)")


def label_mentioned(body: str, label: str) -> str:
    """Exact check of a label column in a text column."""
    cut = f"CASE WHEN {key(label)} = 'azure' THEN {azure_cut(body)} ELSE {body} END"
    return (f"({key(body)} = {key(label)} OR regexp_matches({cut}, "
            f"'(?i)(^|[^a-z0-9])' || {escape_column(label)} || '([^a-z0-9]|$)'))")


def groups_sql() -> str:
    """alias_labels(name_key, label): every spelling per canonical key."""
    return "alias_labels(name_key, label) AS (" + rows(
        (plain_key(g[0]), label) for g in ALIAS_GROUPS for label in g) + ")"
