"""The queries of this package, for the driver's entry module."""

from __future__ import annotations

from importlib import import_module

MODULES = ["minhash", "tokens", "revisits", "rules", "repeats", "toxicity", "mixing", "secrets", "quality", "decontaminate", "codebooks", "periods", "fingerprints"]


def collect(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        merged.update(getattr(import_module(f"fitweave.llm.{name}"), attribute))
    return merged


def queries() -> dict:
    return collect("QUERIES")


def oracle_sql() -> dict:
    return collect("ORACLE")
