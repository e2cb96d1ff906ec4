"""Where queries over the given tables and their SQL check register themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.plans.views import sql_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Register a query. ``views`` names the shared views that ``sql`` reads, besides the tables."""
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql_views(views.split(), sql)
        return function
    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded, so that the order of additions does not show in the check."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.col(f"`{f.name}`") for f in df.schema.fields])


def r6(column: Column) -> Column:
    return F.round(column, 6)
