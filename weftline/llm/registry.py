"""The training-data queries and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

import corpus_pipeline
from weftline.llm import queries_corpus, queries_models, queries_native

_MODULES = (queries_native, queries_models, queries_corpus)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    found = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
