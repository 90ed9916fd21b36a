"""The corpus queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import op1_packing, op2_jaccard, op3_quality, op4_neighbours, op5_decontaminate, op6_secrets, op7_suffixes, op8_urls, op9_lines, op10_language

MODULES = (op1_packing, op2_jaccard, op3_quality, op4_neighbours, op5_decontaminate, op6_secrets, op7_suffixes, op8_urls, op9_lines, op10_language)


def _name(module) -> str:
    return module.__name__.rpartition(".")[2]


def queries() -> dict:
    return {_name(m): m.query for m in MODULES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    known = {_name(m): m.oracle_sql() if hasattr(m, "oracle_sql") else getattr(m, "ORACLE_SQL", None) for m in MODULES} | {"pipeline": corpus_pipeline.ORACLE_SQL}
    return {n: sql for n, sql in known.items() if sql}
