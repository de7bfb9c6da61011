"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

_NAMES = {
    "op1_fingerprints": "fingerprint",
    "op2_packing": "packing",
    "op3_simhash": "simhash",
    "op4_chat": "chat",
    "op5_embeddings": "vectors",
    "op6_sentencepiece": "pieces",
    "op7_substrings": "substrings",
    "op8_pii": "pii",
    "op9_langid": "langid",
    "op10_warc": "warc",
}


def _query(name: str, module: str):
    def run(spark, sf_dir: str):
        return getattr(importlib.import_module(f"{__package__}.{module}"), name)(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _query(name, module) for name, module in _NAMES.items()}


def oracle_sql() -> dict[str, str]:
    from . import chat, substrings, vectors, warc

    return {"op4_chat": chat.ORACLE, "op5_embeddings": vectors.ORACLE, "op7_substrings": substrings.ORACLE, "op10_warc": warc.ORACLE}
