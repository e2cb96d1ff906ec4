"""Merging phases and days, and the audits that go with it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.functions import cleaning as C
from flowlens.functions.hashing import row_hash
from flowlens.functions.relational import fitted, require_columns
from flowlens.operators.labels import label_from_type, phase_label
from flowlens.schemas import FLOW_NUMERIC


def union_by_name(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows, columns matched by name, absent ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def benign_and_attack(benign: DataFrame, attack: DataFrame, attack_type: str = "attack") -> DataFrame:
    return union_by_name([phase_label(benign, 0, "benign"), phase_label(attack, 1, attack_type)])


def merge_phases(phases: DataFrame) -> DataFrame:
    """Canonical types for phase rows that already carry ``attack_type``: numbers, text, label."""
    require_columns(phases, ["attack_type"])
    texts = [c for c in ("proto", "state", "saddr", "daddr", "attack_type") if c in phases.columns]
    typed = phases.withColumns({
        **{c: C.number_or_zero(F.col(c)) for c in FLOW_NUMERIC if c in phases.columns},
        **{c: C.text_or_nan(F.col(c)) for c in texts}})
    return label_from_type(typed)


def paired_phases(benign: DataFrame, attack: DataFrame, rep: str = "rep") -> DataFrame:
    """Benign and attack rows of repetitions present on both sides."""
    both = fitted(benign.select(rep).distinct().join(attack.select(rep).distinct(), rep))
    return union_by_name([phase_label(benign.join(both, rep, "left_semi"), 0, "benign"),
                          phase_label(attack.join(both, rep, "left_semi"), 1, "attack")])


def unpaired(benign: DataFrame, attack: DataFrame, rep: str = "rep") -> DataFrame:
    """Repetitions present on one side only, and which side that is."""
    left = benign.select(rep).distinct().withColumn("benign", F.lit(1))
    right = attack.select(rep).distinct().withColumn("attack", F.lit(1))
    return (left.join(right, rep, "full_outer").where(F.col("benign").isNull() | F.col("attack").isNull())
            .select(rep, F.when(F.col("benign").isNull(), "attack").otherwise("benign").alias("only_in")))


def days(df: DataFrame, wanted: Sequence[str], day: str = "day") -> DataFrame:
    """The rows of the wanted days; a partition filter on a table partitioned by day."""
    return df.where(F.col(day).isin(list(wanted)))


def dataset_summary(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("y_true").cast("double")).alias("pos_rate"),
                                   F.min("rep").alias("rep_min"), F.max("rep").alias("rep_max"))


def value_counts(df: DataFrame, column: str, groups: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*groups, column).agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, column: str, k: int = 10, groups: Sequence[str] = ()) -> DataFrame:
    """The ``k`` most frequent values per group, nulls counted as a value; equals in value order."""
    counts = value_counts(df, column, groups)
    if not groups:
        return counts.orderBy(F.col("n").desc(), F.col(column).asc_nulls_first()).limit(k)
    order = W.partitionBy(*groups).orderBy(F.col("n").desc(), F.col(column).asc_nulls_first())
    return counts.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= k).drop("__rank")


def day_statistics(df: DataFrame, top: int = 15, day: str = "day", label: str = "Label") -> DataFrame:
    """Rows, attack share and the most frequent labels of every day, from one aggregation."""
    counts = df.groupBy(day, F.trim(F.col(label)).alias("label_name")).agg(F.count(F.lit(1)).alias("n"))
    attacks = F.when(F.upper("label_name") != "BENIGN", F.col("n")).otherwise(0)
    totals = counts.groupBy(day).agg(F.sum("n").alias("day_n"), (F.sum(attacks) / F.sum("n")).alias("attack_ratio"))
    order = W.partitionBy(day).orderBy(F.col("n").desc(), F.col("label_name"))
    leading = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    return leading.join(totals, day).select(day, "label_name", "n", "day_n", "attack_ratio", "place")


def crosstab(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Counts per pair in long form; combined before the shuffle."""
    return df.groupBy(rows, columns).agg(F.count(F.lit(1)).alias("n"))


def crosstab_wide(df: DataFrame, rows: str, columns: str, values: Sequence) -> DataFrame:
    """Counts with one column per listed value, 0 where a pair does not occur."""
    return df.groupBy(rows).agg(*[
        F.sum(F.when(F.col(columns) == v, 1).otherwise(0)).alias(str(v)) for v in values])


def content_row_id(df: DataFrame, columns: Sequence[str], into: str = "row_id") -> DataFrame:
    """A row key from the row's content, the same in every run and under any partitioning.

    Rows equal in ``columns`` share the key; add a file name or offset to ``columns`` to keep them apart.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]
    return df.withColumn(into, row_hash(0, *parts))


def with_positions(spark: SparkSession, path: str, into: str = "row_id") -> DataFrame:
    """A Parquet table with every row's position from 0, in the order of its files' paths and of the rows in them.

    Spark numbers the rows of a file as it reads them; the counts of the files before are added. So equal rows keep keys of their
    own, in every run and under any partitioning, as long as the files stay. Counting reads no column.
    """
    own, file, start = (f"__{n}_{into}" for n in ("own", "file", "start"))
    table = spark.read.parquet(path)
    rows = table.select("*", F.col("_metadata.row_index").alias(own), F.col("_metadata.file_path").alias(file))
    # One row for each file, which Spark's listing of them on the driver holds too.
    before = W.orderBy(file).rowsBetween(W.unboundedPreceding, -1)
    files = rows.groupBy(file).agg(F.count(F.lit(1)).alias(start))
    starts = fitted(files.select(F.col(file).alias(f"{file}_of"), F.coalesce(F.sum(start).over(before), F.lit(0)).alias(start)))
    return (rows.join(starts, F.col(file) == F.col(f"{file}_of"))
            .select(*[F.col(f"`{c}`") for c in table.columns if c != into], (F.col(start) + F.col(own)).alias(into)))


def zipped(left: DataFrame, right: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows of two tables side by side by position; the longer table's rest is left out. Columns of ``right`` that ``left``
    has too keep the left's values."""
    own = [c for c in right.columns if c == key or c not in left.columns]
    return left.join(right.select(*[F.col(f"`{c}`") for c in own]), key)


def duplicate_keys(df: DataFrame, key: str = "row_id") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
