"""Named queries over the test tables, each with its DuckDB form where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query; doubles are rounded to 6 places on both sides."""

    def wrap(run: Run) -> Run:
        if name in CATALOG:
            raise ValueError(f"query {name!r} is already registered")
        CATALOG[name] = Query(name, lambda spark, sf: rounded(run(spark, sf)), sql)
        return run

    return wrap


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to 6 places, and no negative zero."""
    return df.select(
        *[
            (F.round(F.col(f.name), places) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
