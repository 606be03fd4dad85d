"""Registered queries over the given tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelforge.plans import access, evaluate, factor, misc, models, study, ts_xs

MODULES = (ts_xs, factor, misc, models, evaluate, study, access)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}


def flagship(spark: SparkSession, root: str) -> DataFrame:
    return queries()["xs12_signal_monthly"](spark, root)
