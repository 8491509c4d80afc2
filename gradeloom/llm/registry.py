"""The queries of the training-data operators and their SQL, for __spark_entry__.py."""

from __future__ import annotations

import importlib

MODULES = ["decontaminate", "fingerprint", "html_text", "importance", "language", "mixing", "near_dups", "pii", "quality", "suffix_dedup", "token_counts", "token_files", "vector_codes"]


def _all(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(importlib.import_module(f"gradeloom.llm.{module}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLES")
