"""Exact running sums and exact quantiles over a whole ordering, without putting it in one task.

Values are cut into buckets at splitters taken by hash from the values themselves. The splitters are a
function of the data alone, so a recomputed task always sees the same ones; they only spread the load,
and every result is exact whatever they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.functions.relational import attach, join_groups
from flowlens.session import saved

ROWS_PER_BUCKET = 65_536
MAX_BUCKETS = 262_144
OVERSAMPLE = 4
SEARCH_BITS = 20


def splitters(values: DataFrame, keys: Sequence[str], value: str,
              rows_per_bucket: int = ROWS_PER_BUCKET, max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """Sorted bucket borders per group: ``keys + (__borders, __steps)``.

    ``values`` are the raw rows: counting them and hashing them are plain scans, and only sampled values
    are shuffled. A value is sampled when its hash is divisible by a stride set from the total row count,
    so the table holds about ``max_buckets * OVERSAMPLE`` values over all groups together at the very most.
    Groups too small to be sampled are absent and keep a single bucket.
    """
    total = values.agg(F.count(F.lit(1)).alias("n")).scalar()
    stride = F.greatest(F.lit(max(1, rows_per_bucket // OVERSAMPLE)),
                        (total / F.lit(max_buckets * OVERSAMPLE)).cast("bigint"))
    sampled = (values.where(F.pmod(F.xxhash64(*keys, value), stride) == 0)
               .groupBy(*keys, value).agg(F.lit(1).alias("__one")))
    borders = (sampled.groupBy(*keys)
               .agg(F.sort_array(F.collect_list(value)).alias("__sample"))
               .select(*keys, F.expr(f"filter(__sample, (_, i) -> i % {OVERSAMPLE} = {OVERSAMPLE - 1})").alias("__borders"))
               .select(*keys, "__borders", search_steps("__borders").alias("__steps")))
    return borders.where(F.size("__borders") > 0) if keys else borders


def search_steps(borders: str) -> Column:
    """The powers of two up to the number of borders, largest first: the strides of a binary search."""
    powers = ", ".join(str(1 << bit) for bit in reversed(range(SEARCH_BITS)))
    return F.expr(f"filter(array({powers}), step -> step <= size({borders}))")


def position(value: str, borders: str = "__borders", steps: str = "__steps") -> Column:
    """How many of the sorted ``borders`` are at or below ``value``, by binary search; all are column names.

    ``steps`` are the borders' own ``search_steps``, worked out once per group and not per row. The result
    is 0 where there are no borders.
    """
    return F.expr(f"coalesce(aggregate({steps}, 0, (found, step) -> "
                  f"if(get({borders}, found + step - 1) <= {value}, found + step, found)), 0)")


def bucketed(values: DataFrame, keys: Sequence[str], value: str, borders: DataFrame) -> DataFrame:
    """``values`` with a ``__bucket`` number that grows with ``value``."""
    table = F.broadcast(borders) if keys else borders
    located = attach(values, table, keys)
    return (located.withColumn("__bucket", position(value))
            .drop("__borders", "__steps"))


def running(distinct: DataFrame, source: DataFrame, keys: Sequence[str], value: str, measures: Sequence[str],
            descending: bool = True, look_ahead: bool = False,
            rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add ``<measure>_cum`` (up to and including the row) and ``<measure>_all`` (whole group).

    ``distinct`` holds one row per group and value, ``source`` the rows it was counted from. With ``look_ahead`` the measures of the following row
    come as ``<measure>_next``, null on the last row. A bucket's starting sums enter its window as one
    extra row in front, so the rows are shuffled once and nothing is joined.
    """
    keys = list(keys)
    borders = splitters(source, keys, value, rows_per_bucket)
    rows = bucketed(distinct, keys, value, borders)

    edge = F.max_by if descending else F.min_by
    sums = rows.groupBy(*keys, "__bucket").agg(
        *[F.sum(m).alias(m) for m in measures],
        *([edge(m, value).alias(f"{m}_next") for m in measures] if look_ahead else []))
    bucket_order = F.col("__bucket").desc() if descending else F.col("__bucket").asc()
    across = W.partitionBy(*keys).orderBy(bucket_order)
    before = across.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    starts = sums.select(
        *keys, "__bucket", F.lit(0).alias("__row"),
        *[F.coalesce(F.sum(m).over(before), F.lit(0)).cast(distinct.schema[m].dataType).alias(m) for m in measures],
        *[F.sum(m).over(whole).alias(f"{m}_all") for m in measures],
        *([F.lead(f"{m}_next").over(across).alias(f"{m}_next") for m in measures] if look_ahead else []))

    together = rows.withColumn("__row", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    value_order = F.col(value).desc() if descending else F.col(value).asc()
    inside = W.partitionBy(*keys, "__bucket").orderBy("__row", value_order)
    so_far = inside.rowsBetween(W.unboundedPreceding, 0)
    out = together.withColumns({
        **{f"{m}_cum": F.sum(m).over(so_far) for m in measures},
        **{f"{m}_all": F.first(f"{m}_all", ignorenulls=True).over(so_far) for m in measures},
    })
    if look_ahead:
        out = out.withColumns({
            f"{m}_next": F.coalesce(F.lead(m).over(inside), F.first(f"{m}_next", ignorenulls=True).over(so_far))
            for m in measures})
    return out.where(F.col("__row") == 1).drop("__row", "__bucket")


def grid_steps(start: Column, stop: Column, n: Column, parts: int) -> tuple[Column, Column]:
    """First and last grid step j in 0..parts that needs a rank in [start, stop) of ``n`` sorted rows.

    Step j sits at rank (n-1)·j/parts and needs that rank rounded down and up. Whole-number arithmetic
    keeps the grid free of rounding.
    """
    span = F.greatest(n - 1, F.lit(1)).cast("bigint")
    low = F.when((start <= 0) | (n <= 1), F.lit(0)).otherwise(_div((start - 1) * parts, span) + 1)
    high = F.when(n <= 1, F.lit(parts)).otherwise(
        F.least(F.lit(parts).cast("bigint"), _div(stop * parts - 1, span)))
    return low.cast("bigint"), high.cast("bigint")


def _div(top: Column, bottom: Column) -> Column:
    return F.call_function("div", top.cast("bigint"), bottom.cast("bigint"))


def grid_points(ranked: DataFrame, keys: Sequence[str], value: str, start: Column, count: Column, n: Column,
                parts: int, carry: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolated quantiles at j/parts from rows that know their rank range.

    ``start`` is the number of rows below ``value`` and ``count`` the rows equal to it. Returns
    ``keys + (step, quantile)`` plus, for every column in ``carry``, its content on the row of the
    smallest value at or above the quantile.
    """
    keys = list(keys)
    rows = ranked.select(*keys, value, *carry, start.cast("bigint").alias("__start"),
                         (start + count).cast("bigint").alias("__stop"), n.cast("bigint").alias("__n"))
    low, high = grid_steps(F.col("__start"), F.col("__stop"), F.col("__n"), parts)
    hit = (rows.withColumns({"__low": low, "__high": high}).where(F.col("__low") <= F.col("__high"))
           .withColumn("step", F.explode(F.sequence("__low", "__high"))))
    scaled = (F.col("__n") - 1) * F.col("step")
    floor_rank = _div(scaled, F.lit(parts))
    rest = scaled % parts
    upper_rank = floor_rank + F.when(rest > 0, 1).otherwise(0)
    payload = F.struct(value, *carry)

    def covering(rank: Column) -> Column:
        return F.max(F.when((F.col("__start") <= rank) & (rank < F.col("__stop")), payload))

    ends = hit.groupBy(*keys, "step").agg(
        covering(floor_rank).alias("__lo"), covering(upper_rank).alias("__hi"),
        F.max((rest / F.lit(float(parts)))).alias("__gamma"))
    lo, hi = F.col(f"__lo.{value}"), F.col(f"__hi.{value}")
    ends = ends.withColumn("quantile", lo + (hi - lo) * F.col("__gamma"))
    at_low = F.col("quantile") <= lo
    return ends.select(*keys, F.col("step").cast("int").alias("step"), "quantile",
                       *[F.when(at_low, F.col(f"__lo.{c}")).otherwise(F.col(f"__hi.{c}")).alias(c) for c in carry])


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, parts: int,
                    rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Exact quantiles at 0/parts … parts/parts of every group: ``keys + (step, quantile)``.

    The table is read once, into saved counts of its distinct values. These are counted per bucket; then just the buckets that
    hold a wanted rank are ordered, for a median one or two out of thousands. Null values are skipped.
    """
    keys = list(keys)
    rows = saved(df.select(*keys, F.col(value).cast("double").alias(value)).where(
        F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__count")))
    borders = splitters(rows, keys, value, rows_per_bucket)
    counts = bucketed(rows, keys, value, borders).groupBy(*keys, "__bucket").agg(F.sum("__count").alias("__count"))
    across = W.partitionBy(*keys).orderBy("__bucket")
    starts = counts.select(
        *keys, "__bucket", "__count",
        F.coalesce(F.sum("__count").over(across.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__start"),
        F.sum("__count").over(W.partitionBy(*keys)).alias("__n"))
    low, high = grid_steps(F.col("__start"), F.col("__start") + F.col("__count"), F.col("__n"), parts)
    wanted = starts.where(low <= high)

    # A group absent from the borders has one bucket, which is always wanted; so the list of wanted
    # buckets is no larger than the borders table and may be broadcast with it.
    lists = wanted.groupBy(*keys).agg(F.collect_list("__bucket").alias("__wanted"))
    if keys:
        plan = F.broadcast(join_groups(borders, lists, keys, "left"))
    else:
        plan = attach(borders, lists, keys)
    chosen = (attach(rows, plan, keys)
              .withColumn("__bucket", position(value))
              .where(F.col("__borders").isNull() | F.array_contains("__wanted", F.col("__bucket"))))
    distinct = chosen.select(*keys, "__bucket", value, "__count")
    heads = wanted.select(*keys, "__bucket", F.lit(0).alias("__row"), F.col("__start").alias("__count"), "__n")
    together = distinct.withColumn("__row", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    inside = (W.partitionBy(*keys, "__bucket").orderBy("__row", value)
              .rowsBetween(W.unboundedPreceding, 0))
    ranked = (together
              .withColumns({"__cum": F.sum("__count").over(inside),
                            "__n": F.first("__n", ignorenulls=True).over(inside)})
              .where(F.col("__row") == 1))
    return grid_points(ranked, keys, value, F.col("__cum") - F.col("__count"), F.col("__count"), F.col("__n"), parts)
