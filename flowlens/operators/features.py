"""Feature preparation with tables fitted on the training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.relational import finite, fitted, unpivot
from flowlens.operators.ordered import exact_quantiles, running
from flowlens.schemas import FEATURE_SETS


def split_by_type(df: DataFrame, leave_out: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Column names as (numeric, other)."""
    fields = [f for f in df.schema.fields if f.name not in leave_out]
    numeric = [f.name for f in fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    return numeric, [f.name for f in fields if f.name not in numeric]


def column_kinds(df: DataFrame, leave_out: Sequence[str] = ()) -> DataFrame:
    """``name, kind, filled`` of every column: ``num`` or ``cat``, and in how many rows it has a value."""
    numeric, other = split_by_type(df, leave_out)
    kinds = dict.fromkeys(numeric, "num") | dict.fromkeys(other, "cat")
    counted = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(kinds)])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(k).alias("kind"), F.col(f"n{i}").alias("filled"))
                                             for i, (c, k) in enumerate(kinds.items())])))


def numeric_only(df: DataFrame, leave_out: Sequence[str] = ()) -> DataFrame:
    return df.select(*split_by_type(df, leave_out)[0])


def feature_set(df: DataFrame, name: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*FEATURE_SETS[name], *keep)


def fit_medians(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact median per column, ``feature, median``; 0 for a column without any finite value."""
    values = unpivot(train, columns, "double").withColumn("value", finite(F.col("value")))
    found = exact_quantiles(values, ["feature"], "value", 2).where("step = 1")
    frame = _names(train, columns)
    return frame.join(found, "feature", "left").select("feature", F.coalesce("quantile", F.lit(0.0)).alias("median"))


def _names(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")


def _as_row(table: DataFrame, value: str, columns: Sequence[str]) -> Column:
    """A ``feature, value`` table, one row per column of the schema, as a map from a scalar subquery."""
    return table.agg(F.map_from_entries(F.collect_list(F.struct("feature", value)))).scalar()


def impute_medians(df: DataFrame, medians: DataFrame, columns: Sequence[str]) -> DataFrame:
    known = df.withColumn("__fit", _as_row(medians, "median", columns))
    return known.withColumns({
        c: F.coalesce(finite(F.col(c).cast("double")), F.try_element_at("__fit", F.lit(c))) for c in columns}).drop("__fit")


def fit_modes(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value per column, ``feature, mode``; among equals the smallest."""
    counts = (unpivot(train, columns, "string").where("value is not null")
              .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))
    best = counts.groupBy("feature").agg(F.min(F.struct((-F.col("n")).alias("down"), "value")).alias("b"))
    return best.select("feature", F.col("b.value").alias("mode"))


def impute_modes(df: DataFrame, modes: DataFrame, columns: Sequence[str]) -> DataFrame:
    known = df.withColumn("__fit", _as_row(modes, "mode", columns))
    return known.withColumns({
        c: F.coalesce(F.col(c).cast("string"), F.try_element_at("__fit", F.lit(c))) for c in columns}).drop("__fit")


def fit_scales(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Population standard deviation of the finite values per column, ``feature, scale``; 1 for a constant column."""
    wide = train.agg(*[F.stddev_pop(finite(F.col(c).cast("double"))).alias(c) for c in columns])
    long = wide.unpivot([], list(columns), "feature", "scale")
    return long.select("feature", F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0).alias("scale"))


def scale(df: DataFrame, scales: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values divided by the fitted scale, not centred."""
    known = df.withColumn("__fit", _as_row(scales, "scale", columns))
    return known.withColumns({c: F.col(c).cast("double") / F.try_element_at("__fit", F.lit(c))
                              for c in columns}).drop("__fit")


def fit_codes(train: DataFrame, columns: Sequence[str], missing: str | None = "NA") -> DataFrame:
    """Codes 0, 1, 2… in value order per column: ``feature, value, code``.

    Only the distinct values are numbered, in ranges of the order, so a column of a billion addresses is
    not sorted in one task. With ``missing`` a null is that text and gets a code.
    """
    values = unpivot(train, columns, "string")
    if missing is not None:
        values = values.withColumn("value", F.coalesce("value", F.lit(missing)))
    values = values.where("value is not null")
    distinct = values.groupBy("feature", "value").agg(F.lit(1).cast("bigint").alias("one"))
    numbered = running(distinct, values, ["feature"], "value", ["one"], descending=False)
    return numbered.select("feature", "value", (F.col("one_cum") - 1).alias("code"))


def encode(df: DataFrame, codes: DataFrame, columns: Sequence[str], missing: str | None = "NA",
           unknown: int | None = 0) -> DataFrame:
    """Text columns to codes. A value without a code gets ``unknown``.

    The dictionary is broadcast only if its counted size allows; a larger one is joined by value.
    """
    table = fitted(codes)
    out = df
    for c in columns:
        part = table.where(F.col("feature") == c).select(F.col("value").alias("__value"), F.col("code").alias("__code"))
        text = F.col(c).cast("string") if missing is None else F.coalesce(F.col(c).cast("string"), F.lit(missing))
        code = F.col("__code") if unknown is None else F.coalesce(F.col("__code"), F.lit(unknown))
        out = out.join(part, text == F.col("__value"), "left").withColumn(c, code).drop("__value", "__code")
    return out


def union_codes(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Codes over both tables together. Fitting on the training rows alone is the leak-free choice."""
    return fit_codes(train.select(*columns).unionByName(test.select(*columns)), columns)
