"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import answers, decisions, evidence, geometry, grounding, identities, metrics, printed, relational, reports, retrieval, sequential, stateful, storage, structure, summarized, texts, validation, vectors

FLAGSHIP = "rrf_hybrid"

_MODULES = (retrieval, texts, decisions, grounding, metrics, stateful, sequential, relational, vectors, structure, reports, geometry, validation, identities, storage, summarized, evidence, printed, answers)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}


def covers() -> dict[str, str]:
    """Operator ids of the blueprint by query."""
    return {name: ids for m in _MODULES for name, ids in m.COVERS.items()}
