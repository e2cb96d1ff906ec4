"""Joining per-group results back to rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.session import saved

FIT_ROWS = 200_000
FIT_BYTES = 32 << 20


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` itself, or a ``ValueError`` naming the missing columns (no job is run)."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}; have {df.columns}")
    return df


def required_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``name, present, filled`` of every required column: whether the table has it, and in how many rows it has a value."""
    have = [name for name in names if name in df.columns]
    counted = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(have)])
    filled = {c: F.col(f"n{i}") for i, c in enumerate(have)}
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), F.lit(c in filled).alias("present"), filled.get(c, F.lit(0).cast("bigint")).alias("filled"))
        for c in names])))


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on ``keys`` in which a null key matches a null key; the keys of ``left`` are kept."""
    renamed = right.withColumnsRenamed({key: f"__r_{key}" for key in keys})
    condition = reduce(lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(f"__r_{key}")) for key in keys])
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"__r_{key}" for key in keys])


def fitted(df: DataFrame, max_rows: int = FIT_ROWS, max_bytes: int = FIT_BYTES) -> DataFrame:
    """Materialise a table of fitted values and let it be broadcast only if its size, counted in rows and in bytes of its
    files, allows.

    Beyond ``max_rows`` or ``max_bytes`` the table takes part in ordinary (adaptive, skew-split) joins.
    """
    table = saved(df)
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(table) if size <= max_bytes and table.count() <= max_rows else table


def attach(rows: DataFrame, per_group: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the columns of ``per_group`` (one row per group) to every row.

    Without keys the single row comes in as a scalar subquery, so there is no join at all. With keys the
    caller says how small ``per_group`` is: pass ``fitted(...)`` or a hinted table of bounded size.
    """
    if keys:
        return join_groups(rows, per_group, keys, "left")
    packed = per_group.select(F.struct(*per_group.columns).alias("__packed")).scalar()
    return (rows.withColumn("__packed", packed)
            .select(*rows.columns, *[F.col(f"__packed.`{name}`").alias(name) for name in per_group.columns])
            )


def unpivot(df: DataFrame, columns: Sequence[str], cast: str, keep: Sequence[str] = (),
            name: str = "feature", value: str = "value") -> DataFrame:
    """Long table ``keep + (name, value)``: one scan for any number of columns."""
    typed = df.select(*keep, *[F.col(f"`{c}`").try_cast(cast).alias(c) for c in columns])
    return typed.unpivot(list(keep), list(columns), name, value)


def finite(column: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(F.isnan(column) | (F.abs(column) == F.lit(float("inf"))), None).otherwise(column)


def ratio(top: Column, bottom: Column) -> Column:
    """Double division that gives null for a zero divisor."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))
