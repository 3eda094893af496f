"""All queries of the library but those of the optional training-data package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import context, dispositions, documents, events, governance, retrieval, safety, service, sessions, stemmed, streams, transcripts, views

_MODULES = (events, documents, retrieval, sessions, transcripts, views, streams, service, safety, context, governance, dispositions, stemmed)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
