"""Bindings of the jobs to the test tables: one module per job family.

Each module holds QUERIES (name -> callable(spark, sf_dir)) and ORACLE
(name -> equivalent SQL). Inputs that the tables lack (payloads, skill texts,
saved searches) are derived from them by Spark, over all their rows.
"""

from __future__ import annotations

from importlib import import_module

MODULES = ["ranking", "skills", "evidence", "texts", "reports", "postings"]


def collect(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        entries = getattr(import_module(f"fitweave.workloads.{name}"), attribute)
        overlap = merged.keys() & entries.keys()
        if overlap:
            raise ValueError(f"duplicate queries: {sorted(overlap)}")
        merged.update(entries)
    return merged
