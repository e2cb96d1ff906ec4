"""Repeatable splits and samples.

A row's place is the order of its key's hash. Splits of exact size need only the hash at each cut, which
is found from counts over hash prefixes; the rows themselves are then split in place, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.hashing import PRIME, coefficients, draws, hash_bucket, row_hash, uniform
from flowlens.functions.relational import attach, fitted, join_groups
from flowlens.session import saved


def rank_cuts(placed: DataFrame, strata: Sequence[str], place: Sequence[str], bucket: Column,
              ranks: Sequence[Column]) -> DataFrame:
    """The ``place`` of the rows at given ranks of every stratum, as structs ``cut_0, cut_1, …``.

    ``ranks`` are expressions over ``n``, the size of the stratum. ``bucket`` must follow the order of
    ``place`` and be spread evenly. Only the buckets holding a wanted rank are ordered. A rank of 0 gives null.
    """
    strata = list(strata)
    rows = placed.withColumn("__bucket", bucket)
    counts = rows.groupBy(*strata, "__bucket").agg(F.count(F.lit(1)).alias("__count"))
    across = W.partitionBy(*strata).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        *strata, "__bucket", "__count",
        F.coalesce(F.sum("__count").over(across), F.lit(0)).alias("__before"),
        F.sum("__count").over(W.partitionBy(*strata)).alias("n"))
    listed = F.array(*[F.struct(F.lit(i).alias("which"), r.cast("bigint").alias("rank")) for i, r in enumerate(ranks)])
    wanted = (starts.select(*strata, "__bucket", "__before", "__count", F.inline(listed))
              .where((F.col("rank") > F.col("__before")) & (F.col("rank") <= F.col("__before") + F.col("__count")))
              .select(*strata, "__bucket", "which", (F.col("rank") - F.col("__before")).alias("rest")))
    per_bucket = wanted.groupBy(*strata, "__bucket").agg(
        F.collect_list(F.struct("which", "rest")).alias("__asked"))
    if strata:
        near = join_groups(rows, fitted(per_bucket), [*strata, "__bucket"], "inner")
    else:
        asked = per_bucket.agg(F.map_from_entries(F.collect_list(F.struct("__bucket", "__asked")))).scalar()
        near = rows.withColumn("__asked", F.try_element_at(asked, F.col("__bucket"))).where("__asked is not null")
    order = W.partitionBy(*strata, "__bucket").orderBy(*place)
    found = (near.withColumn("__rank", F.row_number().over(order))
             .select(*strata, *place, "__rank", F.inline("__asked")).where("__rank = rest"))
    return found.groupBy(*strata).agg(*[
        F.max(F.when(F.col("which") == i, F.struct(*place))).alias(f"cut_{i}") for i in range(len(ranks))])


def hash_split(df: DataFrame, names: Sequence[str], ranks: Sequence[Column], key: str = "row_id",
               strata: Sequence[str] = (), seed: int = 7, into: str = "split") -> DataFrame:
    """Name the first ``ranks[0]`` rows of each stratum ``names[0]``, up to ``ranks[1]`` ``names[1]``, …

    Rows past the last rank get the last name.
    """
    strata = list(strata)
    placed = df.select(*strata, row_hash(seed, F.col(key)).alias("__hash"), F.col(key).alias("__key"))
    cuts = rank_cuts(placed, strata, ["__hash", "__key"], hash_bucket(F.col("__hash")), ranks)
    rows = df.withColumn("__here", F.struct(row_hash(seed, F.col(key)).alias("__hash"), F.col(key).alias("__key")))
    located = attach(rows, fitted(cuts) if strata else cuts, strata)
    choice = F.when(F.col("__here") <= F.col("cut_0"), names[0])
    for i, name in enumerate(names[1:-1], start=1):
        choice = choice.when(F.col("__here") <= F.col(f"cut_{i}"), name)
    return (located.withColumn(into, choice.otherwise(names[-1]))
            .drop("__here", *[f"cut_{i}" for i in range(len(ranks))]))


def _ceil(fraction: float, of: Column) -> Column:
    return F.ceil(F.lit(float(fraction)) * of).cast("bigint")


def train_test(df: DataFrame, test: float, strata: Sequence[str] = (), **how) -> DataFrame:
    """Exact ``ceil(test · n)`` test rows per stratum."""
    return hash_split(df, ["test", "train"], [_ceil(test, F.col("n"))], strata=strata, **how)


def train_val_test(df: DataFrame, test: float, val_of_rest: float, strata: Sequence[str] = (), **how) -> DataFrame:
    """``ceil(test·n)`` test rows, then ``ceil(val_of_rest·rest)`` validation rows per stratum."""
    n_test = _ceil(test, F.col("n"))
    return hash_split(df, ["test", "val", "train"],
                      [n_test, n_test + _ceil(val_of_rest, F.col("n") - n_test)], strata=strata, **how)


def holdout_halves(df: DataFrame, holdout: float = 0.4, test_of_holdout: float = 0.5,
                   strata: Sequence[str] = (), **how) -> DataFrame:
    """A held-out part of ``ceil(holdout·n)`` rows, of which ``ceil(test_of_holdout·part)`` are the test rows."""
    part = _ceil(holdout, F.col("n"))
    return hash_split(df, ["test", "val", "train"], [_ceil(test_of_holdout, part), part], strata=strata, **how)


def bernoulli_split(df: DataFrame, test: float, key: str = "row_id", seed: int = 7) -> DataFrame:
    """Expected-size split in a single pass: test where the row's uniform draw is below ``test``."""
    return df.withColumn("split", F.when(uniform(seed, F.col(key)) < test, "test").otherwise("train"))


def calibration_split(df: DataFrame, fraction: float = 0.2, seed: int = 7, key: str = "row_id") -> DataFrame:
    """``floor(fraction·n)`` calibration rows, the rest test rows."""
    return hash_split(df, ["calib", "test"], [F.floor(F.lit(float(fraction)) * F.col("n"))], key=key, seed=seed)


def group_split(df: DataFrame, group: str, test: float = 0.3, seed: int = 7) -> DataFrame:
    """``ceil(test · groups)`` whole groups to test; no group on both sides.

    Only the distinct groups are ranked. A row's side follows from its group's hash, so nothing is joined.
    """
    groups = df.select(group).where(F.col(group).isNotNull()).distinct()
    placed = groups.select(row_hash(seed, F.col(group)).alias("__hash"), F.col(group).alias("__key"))
    cuts = rank_cuts(placed, [], ["__hash", "__key"], hash_bucket(F.col("__hash")), [_ceil(test, F.col("n"))])
    here = F.struct(row_hash(seed, F.col(group)).alias("__hash"), F.col(group).alias("__key"))
    located = attach(df, cuts, [])
    return located.withColumn("split", F.when(here <= F.col("cut_0"), "test").otherwise("train")).drop("cut_0")


#: Draws worked out at a time inside a task.
DRAWS = 65_536
#: Rows of a repetition that one task orders.
ORDERED = 65_536


def calibration_samples(df: DataFrame, k: int, reps: int, seed: int = 7, key: str = "row_id") -> DataFrame:
    """``k`` rows for each of ``reps`` repetitions (all rows if there are fewer), every repetition an independent order of
    the rows.

    One md5 per row gives all its repetition draws as values of a polynomial; ties go by key. A row is written once for each
    repetition in which its draw lies below a bound. The bound is set so that k draws surely do; where counts
    show that they don't, it is doubled. Only these rows, little more than the samples themselves, are ordered.
    """
    rows = df.count()
    wanted = min(k, rows)
    bound = PRIME * min(1.0, (wanted + 12 * wanted**0.5 + 12) / max(rows, 1))
    hashed = df.withColumns({f"__a{i}": c for i, c in enumerate(coefficients(row_hash(seed, F.col(key))))})
    while True:
        near = saved(_drawn_below(hashed, df.schema, int(bound), reps))
        counts = near.groupBy("rep").count().agg(F.count(F.lit(1)).alias("reps"), F.min("count").alias("least")).first()
        if bound >= PRIME or wanted == 0 or (counts["reps"] == reps and counts["least"] >= wanted):
            break
        bound *= 2
    place = F.struct(F.col("__draw"), F.col(key).alias("__key"))
    width = max(1, int(bound) // max(1, -(-wanted // ORDERED)))
    cuts = rank_cuts(near.select("rep", "__draw", F.col(key).alias("__key")), ["rep"], ["__draw", "__key"],
                     F.floor(F.col("__draw") / width).cast("int"), [F.least(F.lit(k).cast("bigint"), F.col("n"))])
    return attach(near, fitted(cuts), ["rep"]).where(place <= F.col("cut_0")).drop("__draw", "cut_0")


def _drawn_below(hashed: DataFrame, schema: T.StructType, bound: int, reps: int) -> DataFrame:
    """The rows once for each repetition 1…``reps`` in which they draw ``bound`` or less, with ``rep`` and ``__draw``."""
    names, step = schema.names, max(1, DRAWS // reps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = np.arange(1, reps + 1)
        for batch in batches:
            coefs = np.stack([np.asarray(batch.column(f"__a{i}")) for i in range(4)], 1)
            for low in range(0, batch.num_rows, step):
                drawn = draws(coefs[low:low + step], points)
                row, rep = np.nonzero(drawn <= bound)
                kept = batch.select(names).take(pa.array(row + low))
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array(rep + 1, pa.int32()), pa.array(drawn[row, rep], pa.int64())], [*names, "rep", "__draw"])

    out = T.StructType([*schema.fields, T.StructField("rep", T.IntegerType()), T.StructField("__draw", T.LongType())])
    return hashed.mapInArrow(run, out)


def subsample(df: DataFrame, n: int, key: str = "row_id", seed: int = 7) -> DataFrame:
    """``n`` rows by hash order; every row if ``n`` is not positive or not below the row count."""
    if n <= 0:
        return df
    marked = hash_split(df, ["kept", "left"], [F.least(F.lit(n).cast("bigint"), F.col("n"))], key=key, seed=seed)
    return marked.where("split = 'kept'").drop("split")


def day_split(df: DataFrame, train: Sequence[str], val: Sequence[str], test: Sequence[str],
              day: str = "day") -> DataFrame:
    """Whole days to train, validation and test; other days are left out by the partition filter."""
    kept = df.where(F.col(day).isin([*train, *val, *test]))
    return kept.withColumn("split", F.when(F.col(day).isin(list(train)), "train")
                           .when(F.col(day).isin(list(val)), "val").otherwise("test"))


# Day protocols.
DAY_PROTOCOLS = {
    "default": {"train": ["Monday", "Tuesday", "Wednesday"], "val": ["Thursday"], "test": ["Friday"]},
    "no_monday": {"train": ["Tuesday", "Wednesday"], "val": ["Thursday"], "test": ["Friday"]},
}
