"""The registered queries of this subpackage, by operator."""

from __future__ import annotations

from importlib import import_module

MODULES = ("toxicity", "bpe", "chat", "packing", "spotsigs", "va_file", "ring", "repeats", "bagminhash", "wordpiece", "merkle", "prefix_trie", "langid")


def queries() -> dict:
    operators = {k: v for name in MODULES for k, v in import_module(f"offerscope.llm.{name}").QUERIES.items()}
    return operators | {"pipeline": import_module("corpus_pipeline").run}


def oracle_sql() -> dict:
    return {k: v for name in MODULES for k, v in getattr(import_module(f"offerscope.llm.{name}"), "ORACLE", {}).items()}
