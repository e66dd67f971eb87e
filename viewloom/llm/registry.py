"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Module of this subpackage that holds each query's ``query`` function and, if any, its ``SQL``.
MODULES = {
    "op1_html": "q_html",
    "op2_minhash": "q_minhash",
    "op3_secrets": "q_secrets",
    "op4_tokens": "q_tokens",
    "op5_langid": "q_langid",
    "op6_decontam": "q_decontam",
    "op7_packing": "q_packing",
    "op8_search": "q_search",
    "op9_lm": "q_lm",
    "op10_chat": "q_chat",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: importlib.import_module(f"{__package__}.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"{__package__}.{module}"), "SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
