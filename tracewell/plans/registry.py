"""Registered queries of the evidence and context analytics, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.plans import corpora, documents, feeds, logs, missions, sessions, streams

_PLANS = (sessions, documents, streams, missions, logs, feeds, corpora)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for plan in _PLANS for name, q in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for plan in _PLANS for name, q in plan.SQL.items()}
