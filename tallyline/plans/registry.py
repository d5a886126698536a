"""Registered queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bands, corpus, evaluation, evidence, fields, grammar, layout, metadata, reconciliation, regions, relational, semantics, structure  # noqa: F401  declare their queries
from .base import QUERIES, Tables


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir)) for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql is not None}
