"""Distribution shift between a reference and a target table.

All columns of a kind are unpivoted into one long table, so the number of jobs and shuffles does not grow
with the number of features. Non-finite numbers count as missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.relational import finite, join_groups, ratio, unpivot
from flowlens.operators.ordered import grid_points, position, running, search_steps
from flowlens.schemas import FLOW_NUMERIC, LABEL_COLUMNS
from flowlens.session import saved


def common_columns(ref: DataFrame, tgt: DataFrame) -> tuple[list[str], list[str]]:
    """Shared feature columns as (numeric, categorical): numbers and booleans on both sides are numeric, all else (text,
    dates, times) is categorical."""
    shared = [c for c in ref.columns if c in tgt.columns and c not in LABEL_COLUMNS]

    def numeric(df: DataFrame, c: str) -> bool:
        return isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType))

    numbers = [c for c in shared if numeric(ref, c) and numeric(tgt, c)]
    return numbers, [c for c in shared if c not in numbers]


def long_numbers(ref: DataFrame, tgt: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature, value, is_ref`` for both sides; missing and non-finite values are left out."""
    def one(df: DataFrame, is_ref: int) -> DataFrame:
        long = unpivot(df, columns, "double")
        return long.select("feature", finite(F.col("value")).alias("value"), F.lit(is_ref).alias("is_ref"))
    return one(ref, 1).unionByName(one(tgt, 0)).where(F.col("value").isNotNull())


def summed(values: DataFrame) -> DataFrame:
    """``feature, value`` with ``ref`` and ``tgt``, how often either side has it, their running sums ``…_cum`` in ascending
    order and their totals ``…_all``; saved. Quantile edges, bins, KS and means are all read off this one table.
    """
    counts = saved(values.groupBy("feature", "value").agg(
        F.sum("is_ref").alias("ref"), F.sum(1 - F.col("is_ref")).alias("tgt")))
    return saved(running(counts, counts.select("feature", "value"), ["feature"], "value", ["ref", "tgt"], descending=False))


def psi(values: DataFrame, bins: int = 10, eps: float = 1e-6, min_n: int = 50) -> DataFrame:
    """Population stability index per feature over ``bins`` quantile bins of the reference.

    Null with fewer than ``min_n`` values on a side or fewer than three distinct edges. Target values
    outside the reference range fall in no bin; the last bin is closed.
    """
    return psi_of(summed(values), bins, eps, min_n)


def psi_of(sums: DataFrame, bins: int = 10, eps: float = 1e-6, min_n: int = 50) -> DataFrame:
    """``psi`` from the table of ``summed``."""
    cuts = grid_points(sums.where("ref > 0"), ["feature"], "value", F.col("ref_cum") - F.col("ref"), F.col("ref"), F.col("ref_all"), bins)
    # One row per feature, at most bins + 1 numbers each: the schema bounds it, so it may be broadcast.
    edges = cuts.groupBy("feature").agg(F.array_sort(F.collect_set("quantile")).alias("edges"))
    edges = F.broadcast(edges.withColumn("steps", search_steps("edges")))
    placed = join_groups(sums.select("feature", "value", "ref", "tgt"), edges, ["feature"], "left")
    within = (F.col("value") >= F.element_at("edges", 1)) & (F.col("value") <= F.element_at("edges", -1))
    at = F.least(position("value", "edges", "steps"), F.size("edges") - 1)
    binned = placed.withColumn("bin", F.when(F.col("edges").isNotNull() & within, at))

    # Counted per bin before the shuffle; what is gathered per feature is at most one count per side and bin.
    cells = binned.groupBy("feature", "bin").agg(F.sum("ref").alias("n_1"), F.sum("tgt").alias("n_0"),
                                                 F.max(F.size("edges") - 1).alias("k"))
    counts = cells.groupBy("feature").agg(
        F.max("k").alias("k"),
        *[F.sum(f"n_{side}").alias(f"n_{side}") for side in (1, 0)],
        *[F.expr(f"greatest(sum(if(bin IS NOT NULL, n_{side}, 0)), 1) AS inside_{side}") for side in (1, 0)],
        *[F.expr(f"map_from_entries(collect_list(if(bin IS NOT NULL, struct(bin, n_{side}), null))) "
                 f"AS bins_{side}") for side in (1, 0)])

    def share(side: int) -> str:
        return f"least(greatest(coalesce(try_element_at(bins_{side}, b), 0) / inside_{side}, {eps!r}D), 1D)"

    shares = F.expr(f"transform(sequence(1, greatest(k, 1)), b -> struct({share(1)} AS e, {share(0)} AS a))")
    index = F.expr("aggregate(shares, 0D, (total, x) -> total + (x.a - x.e) * ln(x.a / x.e))")
    enough = (F.col("n_1") >= min_n) & (F.col("n_0") >= min_n) & (F.col("k") >= 2)
    return counts.withColumn("shares", shares).select("feature", F.when(enough, index).alias("psi"))


def _ks() -> Column:
    """Over the table of ``summed``; null if a side is empty."""
    return F.max(F.abs(ratio(F.col("ref_cum"), F.col("ref_all")) - ratio(F.col("tgt_cum"), F.col("tgt_all")))).alias("ks")


def _means() -> list[Column]:
    return [ratio(F.sum(F.col("value") * F.col(side)), F.sum(side)).alias(f"mean_{side}") for side in ("ref", "tgt")]


def ks(values: DataFrame) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic per feature; null if a side is empty."""
    return summed(values).groupBy("feature").agg(_ks())


def means(values: DataFrame) -> DataFrame:
    return values.groupBy("feature").agg(F.avg(F.when(F.col("is_ref") == 1, F.col("value"))).alias("mean_ref"),
                                         F.avg(F.when(F.col("is_ref") == 0, F.col("value"))).alias("mean_tgt"))


def number_shift(ref: DataFrame, tgt: DataFrame, columns: Sequence[str], bins: int = 10, eps: float = 1e-6,
                 min_n: int = 50) -> DataFrame:
    """``feature, psi, ks, mean_ref, mean_tgt`` with one scan of either table."""
    sums = summed(long_numbers(ref, tgt, columns))
    return psi_of(sums, bins, eps, min_n).join(sums.groupBy("feature").agg(_ks(), *_means()), "feature")


def total_variation(ref: DataFrame, tgt: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Half the summed difference of category shares; a missing value is a category of its own."""
    def one(df: DataFrame, is_ref: int) -> DataFrame:
        return unpivot(df, columns, "string", value="category").withColumn("is_ref", F.lit(is_ref))
    counts = saved(one(ref, 1).unionByName(one(tgt, 0)).groupBy("feature", "category")
                   .agg(F.sum("is_ref").alias("ref"), F.sum(1 - F.col("is_ref")).alias("tgt")))
    # One row per feature: bounded by the schema.
    totals = F.broadcast(counts.groupBy("feature").agg(F.sum("ref").alias("n_ref"), F.sum("tgt").alias("n_tgt")))
    shares = counts.join(totals, "feature")
    gap = F.abs(_share("ref", "n_ref") - _share("tgt", "n_tgt"))
    return shares.groupBy("feature").agg((F.lit(0.5) * F.sum(gap)).alias("tv"))


def _share(top: str, bottom: str) -> Column:
    return F.coalesce(ratio(F.col(top), F.col(bottom)), F.lit(0.0))


def shift_report(ref: DataFrame, tgt: DataFrame, bins: int = 10, eps: float = 1e-6, min_n: int = 50) -> DataFrame:
    """``feature, type, psi, ks, tv, mean_ref, mean_tgt`` for all common columns."""
    numeric, categorical = common_columns(ref, tgt)
    empty = F.lit(None).cast("double")
    parts = []
    if numeric:
        parts.append(number_shift(ref, tgt, numeric, bins, eps, min_n).select(
            "feature", F.lit("num").alias("type"), "psi", "ks", empty.alias("tv"), "mean_ref", "mean_tgt"))
    if categorical:
        parts.append(total_variation(ref, tgt, categorical).select(
            "feature", F.lit("cat").alias("type"), empty.alias("psi"), empty.alias("ks"), "tv",
            empty.alias("mean_ref"), empty.alias("mean_tgt")))
    if not parts:
        raise ValueError("the tables share no feature column")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def top_shifts(report: DataFrame, k: int = 25) -> DataFrame:
    """The ``k`` most shifted features of each type; numeric by 10·PSI + KS, categorical by TV."""
    key = F.when(F.col("type") == "num", F.coalesce("psi", F.lit(0.0)) * 10 + F.coalesce("ks", F.lit(0.0))
                 ).otherwise(F.coalesce("tv", F.lit(0.0)))
    ranked = report.withColumn("rank_key", key)
    order = W.partitionBy("type").orderBy(F.col("rank_key").desc(), "feature")
    return ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def verdict(report: DataFrame, large: float = 0.25, moderate: float = 0.1) -> DataFrame:
    """Largest PSI and KS, and the rule-of-thumb band of the PSI."""
    found = report.agg(F.max("psi").alias("max_psi"), F.max("ks").alias("max_ks"))
    band = F.when(F.col("max_psi") > large, "large").when(F.col("max_psi") >= moderate, "moderate").when(
        F.col("max_psi").isNotNull(), "small")
    return found.withColumn("verdict", band)


def equivalence_report(ref: DataFrame, tgt: DataFrame, columns: Sequence[str] = FLOW_NUMERIC) -> DataFrame:
    """Numeric shift of two captures with PSI clipped at 1e-8 and no minimum size, most shifted first."""
    shared = [c for c in columns if c in ref.columns and c in tgt.columns]
    found = number_shift(ref, tgt, shared, eps=1e-8, min_n=1)
    return found.orderBy(F.col("psi").desc_nulls_last(), F.col("ks").desc_nulls_last(), "feature")


def equivalence_counts(ref: DataFrame, tgt: DataFrame, columns: Sequence[str] = ("proto", "state"),
                       k: int = 10) -> DataFrame:
    """Row counts of both captures and their most frequent values, as ``side, column, value, n``; one scan of either."""
    shared = [c for c in columns if c in ref.columns and c in tgt.columns]

    def side(df: DataFrame, name: str) -> DataFrame:
        named = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in shared]
        every = F.struct(F.lit("rows").alias("column"), F.lit(None).cast("string").alias("value"))
        return df.select(F.lit(name).alias("side"), F.inline(F.array(every, *named)))

    counts = side(ref, "ref").unionByName(side(tgt, "tgt")).groupBy("side", "column", "value").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("side", "column").orderBy(F.col("n").desc(), F.col("value").asc_nulls_first())
    return counts.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= k).drop("__place")


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 50) -> DataFrame:
    """Density histogram over equal bins between each feature's own ends; empty bins are kept."""
    values = (unpivot(df, columns, "double").withColumn("value", finite(F.col("value"))).where("value is not null"))
    # One row per feature: bounded by the schema.
    ends = F.broadcast(values.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"),
                                                     F.count(F.lit(1)).alias("n")))
    # A feature with a single value gets a bin range of one around it.
    ends = ends.select("feature", "n", F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                       F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    placed = values.join(F.broadcast(ends), "feature").withColumn(
        "bin", F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1)).cast("int"))
    counts = placed.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("c"))
    frame = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return frame.join(counts, ["feature", "bin"], "left").select(
        "feature", "bin", (F.col("lo") + F.col("bin") * width).alias("left"),
        F.coalesce("c", F.lit(0)).alias("n"), (F.coalesce("c", F.lit(0)) / (F.col("n") * width)).alias("density"))
