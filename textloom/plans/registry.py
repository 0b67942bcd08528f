"""All queries of the library with their SQL, keyed by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.plans import answers, attention, chains, chunks, evaluation, extraction, figures, papers, prompts, replay, retrieval, runs, schemas, sequences, streams, structure, texts, vectors

MODULES = (vectors, retrieval, chunks, texts, evaluation, sequences, answers, replay, structure, schemas, attention, figures, prompts, streams, papers, chains, runs, extraction)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
