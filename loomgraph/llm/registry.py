"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: query -> module of this subpackage that defines it; its ORACLE, if it has one, is the SQL.
MODULES = {
    "op7_mixing": "mixing",
    "op9_packing": "packing",
    "op2_chat": "chat",
    "op10_neardup": "neardup",
    "op5_lines": "linededup",
    "op8_quality": "quality",
    "op1_forest": "forest",
    "op3_tokens": "tokencount",
    "op4_audio": "audio",
    "op6_katz": "katz",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
