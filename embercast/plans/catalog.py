"""Registered queries: one Spark DataFrame builder per operator, each with the
equivalent DuckDB SQL when the operator is SQL-expressible.

Every builder reads the whole driver tables through the adapters (lazy scans),
and rounds its DOUBLE outputs to 6 digits so both engines hash equal; the
SQL text rounds the same columns (``_wrap``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every DOUBLE column (comparison-friendly output); ``+ 0.0`` turns
    a rounded negative zero into zero, as in the oracle text."""
    return df.select(*[
        (F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, DoubleType)
        else F.col(f.name)
        for f in df.schema.fields])


def wrap(sql: str, doubles: list[str], digits: int = DIGITS) -> str:
    """Oracle text: round the listed DOUBLE columns of ``sql``'s result."""
    if not doubles:
        return sql
    rep = ", ".join(f'round("{c}", {digits}) + 0.0 as "{c}"' for c in doubles)
    return f"select * replace ({rep}) from (\n{sql}\n) q"


# Query modules register themselves on import.
from . import q_clean, q_features, q_stats, q_hotspots, q_curves, q_scoring, q_models, q_stream, q_jobs, q_io, q_logistic, q_forest, q_manifest  # noqa: E402,F401,E501
