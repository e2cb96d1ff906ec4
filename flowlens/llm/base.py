"""What the operators share: tables, the fold rule, samples of labelled rows, saved intermediate tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.session import scratch_path

FOLDS = 5
#: A word, in the notation of Java's and of RE2's expressions.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_open: list[list[str]] = []


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    if _open:
        _open[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """The saved result of ``build``; tables it saved on the way are deleted once the result is written."""
    _open.append([])
    try:
        result = build()
        between = list(_open[-1])
    finally:
        _open.pop()
    out, spark = saved(result, name), result.sparkSession
    for path in between:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return out


#: Batches that go to Python workers. By default Spark fills 10,000 rows whatever their size, and what a worker and the
#: executor beside it took for the largest batch they keep for the stages that follow.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20)}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """BATCHES hold for what is worked out inside; the caller's own settings of these come first."""
    own = [key for key in BATCHES if spark.conf.get(key, None) is None]
    for key in own:
        spark.conf.set(key, BATCHES[key])
    try:
        yield
    finally:
        for key in own:
            spark.conf.unset(key)


def fresh(taken: list[str], *wanted: str) -> list[str]:
    """Names like ``wanted`` for columns on the way, none of which ``taken`` has (in any case of letters)."""
    low = {c.lower() for c in taken}
    out = []
    for name in wanted:
        name = f"__{name}"
        while name in low:
            name += "_"
        out.append(name)
    return out


def positions(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``rows`` with ``name``, their place from 0 in the global ``order``, which is saved.

    Rows are saved with a number of their own, which comes last in the order: it makes the order total, whatever rows
    are equal, and lets range partitioning cut groups of equal rows. Then the rows of each range partition are counted
    as they are saved, and the counts of the partitions before, one row for each partition, are added.
    """
    tie, number = fresh(rows.columns, "tie", "number")
    own = saved(rows.withColumn(tie, F.monotonically_increasing_id()), "rows")
    keys = [*order, F.col(tie)]
    ordered = saved(own.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(tie)
                    .withColumn(number, F.monotonically_increasing_id()), "ordered")
    # A monotonically increasing id is the partition's number above 33 bits, the row's place in the partition below.
    part, inside = F.shiftright(number, 33), F.col(number).bitwiseAND(F.lit((1 << 33) - 1))
    start, of = fresh([*rows.columns, number], "start", "of")
    before = Window.orderBy(of).rowsBetween(Window.unboundedPreceding, -1)
    counts = ordered.groupBy(part.alias(of)).agg(F.count(F.lit(1)).alias(start))
    starts = counts.select(of, F.coalesce(F.sum(start).over(before), F.lit(0)).alias(start))
    return (ordered.join(F.broadcast(starts), part == F.col(of))
            .withColumn(name, inside + F.col(start)).drop(of, start, number))


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 5; null for a null key."""
    return F.crc32(key.cast("string")) % FOLDS


def held_out(key: Column) -> Column:
    """Rows that nothing is learnt from; false for a null key (which has no fold and isn't learnt from either)."""
    return F.coalesce(fold(key) == 0, F.lit(False))


SAMPLE_BYTES = 64 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int,
                    most_bytes: int = SAMPLE_BYTES) -> tuple[pd.DataFrame, float]:
    """At most ``per_class`` documents of each class 0 and 1, the first by hash of doc_id: columns doc_id, text, label,
    fold. And the share of label 1 among all labels that may be learnt from (0 if there are none).

    Held-out rows, null keys and other label values are left out; of several labels of one document the largest
    counts, of several texts the one first in order. Only keys and sizes are ordered; the texts, of which as many are
    taken of each class as have ``most_bytes`` together (one at least), are fetched by a broadcast of at most twice
    ``per_class`` keys.
    """
    known = (labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
             .groupBy("doc_id").agg(F.max(label).alias("label")))
    order = [F.xxhash64("doc_id", F.lit(17)), F.col("doc_id")]
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(*order).limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    share = known.agg(F.avg("label")).first()[0]
    return texts_of(docs, chosen, "label", order, most_bytes), float(share or 0)


def texts_of(docs: DataFrame, chosen: DataFrame, group: str, order: list, most_bytes: int = SAMPLE_BYTES) -> pd.DataFrame:
    """doc_id, text, ``group`` and fold of the documents in ``chosen`` (doc_id and ``group``, few enough to be sent
    out), in each group those first in ``order`` that have ``most_bytes`` together, and one at least."""
    some = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    sized = (some.select("doc_id", F.octet_length("text").alias("bytes")).join(F.broadcast(chosen), "doc_id")
             .groupBy("doc_id", group).agg(F.max("bytes").alias("bytes")))
    first = Window.partitionBy(group).orderBy(*order)
    sized = sized.withColumns({"first": F.row_number().over(first), "used": F.sum("bytes").over(
        first.rowsBetween(Window.unboundedPreceding, 0))})
    taken = sized.where((F.col("used") <= most_bytes) | (F.col("first") == 1)).select("doc_id", group)
    rows = (some.join(F.broadcast(taken), "doc_id").groupBy("doc_id", group).agg(F.min("text").alias("text"))
            .select("doc_id", "text", group, fold(F.col("doc_id")).alias("fold")))
    return rows.toPandas().sort_values(["doc_id", group], ignore_index=True)


def same_schema(df: DataFrame, columns: str) -> str:
    """The schema text of ``df``'s columns followed by ``columns``, for mapInPandas."""
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return f"{own}, {columns}" if columns else own
