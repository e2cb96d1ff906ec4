"""Reading flow, packet, prediction and log files."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.cleaning import weekday_in
from flowlens.operators.cleaning import clean_day_table
from flowlens.schemas import PACKET_SCHEMA
from flowlens.session import saved

# Phase file names.
PHASE_NAMES = ["benign", "attack_scan", "attack_c2_beacon", "attack_lateral", "attack_exfil_burst",
               "attack_exfil_lowslow"]


def phase_pattern(names: Sequence[str] = PHASE_NAMES) -> str:
    return rf"^({'|'.join(names)})_(\d+)\.csv$"


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Headered CSV. Without a schema every column is text; nothing is inferred by a second read."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def scan_packets(spark: SparkSession, path: str) -> DataFrame:
    """Header-less tab-separated packet table."""
    return spark.read.schema(PACKET_SCHEMA).option("sep", "\t").csv(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, modified, length`` of the files below ``path``; contents are not read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
            .load(path).select("path", F.col("modificationTime").alias("modified"), "length"))


def first_lines(spark: SparkSession, path: str | Sequence[str], pattern: str = "*.csv") -> DataFrame:
    """``file_path, header``: the first line that isn't blank of every file that has one; saved.

    Only splits at the start of a file can hold it. A split as large as Spark cuts them is alone in its task, which then
    ends after the first line; so of large files little is read, whatever their number.
    """
    alone = int(_bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            rows = batch.to_pandas()
            first = rows[(rows["start"] == 0) & (rows["value"].str.strip() != "")].drop_duplicates("file_path")
            first = first[~first["file_path"].isin(seen)]
            seen.update(first["file_path"])
            yield pa.RecordBatch.from_arrays([pa.array(first[c].tolist(), pa.string()) for c in ("file_path", "value")], ["file_path", "value"])
            if len(rows) and (rows["length"] >= alone).all() and (len(seen) or (rows["start"] > 0).any()):
                return

    lines = (spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path)
             .select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("start"),
                     F.col("_metadata.file_block_length").alias("length"), "value"))
    return saved(lines.mapInArrow(run, "file_path string, value string").withColumnRenamed("value", "header"))


def _bytes(size: str) -> int:
    """Bytes of a size as Spark's settings write it."""
    found = re.fullmatch(r"(\d+)\s*([bkmgtp]?)i?b?", size.strip().lower())
    if not found:
        raise ValueError(f"no size: {size}")
    return int(found[1]) << (10 * "bkmgtp".index(found[2] or "b"))


def union_csv(spark: SparkSession, path: str | Sequence[str], pattern: str = "*.csv", full_path: str | None = None) -> DataFrame:
    """All CSV files of a folder (or of a list of files), columns matched by name, with ``file_name``.

    Spark aligns the files of one scan by position. So one job finds the header lines, of which the distinct ones, the
    layouts, come to the driver; then one scan reads every file by position, and each row finds a column's place in the
    layout of its file. The number of jobs depends neither on the files nor on the layouts. Names are trimmed; of a name that a
    layout repeats the first place counts. A file without any line adds nothing. ``full_path`` names a column for the files' paths.
    """
    headers = first_lines(spark, path, pattern)
    layouts = {row["header"]: [c.strip() for c in next(csv.reader([row["header"].lstrip("\ufeff")]))]
               for row in headers.select("header").distinct().orderBy("header").collect()}
    if not layouts:
        raise ValueError(f"no {pattern} files with content in {path}")
    names = list(dict.fromkeys(c for layout in layouts.values() for c in layout))
    width = max(map(len, layouts.values()))
    places = spark.createDataFrame([(h, [layout.index(c) if c in layout else -1 for c in names]) for h, layout in layouts.items()],
                                   "header string, __places array<int>")
    by_file = headers.join(F.broadcast(places), "header").select(F.col("file_path").alias("__of"), "__places")
    schema = T.StructType([T.StructField(f"__{i}", T.StringType()) for i in range(width)])
    rows = (spark.read.option("header", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).schema(schema)
            .csv(path).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_name").alias("__name")))
    if len(layouts) == 1:  # every row has its columns in the same places
        return rows.select(*[F.col(f"__{next(iter(layouts.values())).index(c)}").alias(c) for c in names], F.col("__name").alias("file_name"),
                           *([F.col("__file").alias(full_path)] if full_path else []))
    cells = F.array(*[f"__{i}" for i in range(width)])
    found = rows.join(by_file, F.col("__file") == F.col("__of"))
    return found.select(*[F.get(cells, F.get("__places", F.lit(i))).alias(c) for i, c in enumerate(names)],
                        F.col("__name").alias("file_name"), *([F.col("__file").alias(full_path)] if full_path else []))


def with_phase(df: DataFrame, names: Sequence[str] = PHASE_NAMES, file_name: str = "file_name") -> DataFrame:
    """``attack_type`` and ``rep`` from the file name; rows of other files are left out."""
    pattern = phase_pattern(names)
    return (df.where(F.col(file_name).rlike(pattern))
            .withColumns({"attack_type": F.regexp_extract(file_name, pattern, 1),
                          "rep": F.regexp_extract(file_name, pattern, 2).try_cast("bigint")}))


def with_day(df: DataFrame, file_name: str = "file_name") -> DataFrame:
    return df.withColumn("day", weekday_in(F.col(file_name)))


#: Where a converted table keeps the list of the files it was made from; Spark's readers pass over names with an underscore.
LEDGER = "_converted"
#: The partition column that tells the files of a day apart.
FROM = "from_file"


def csv_to_days(spark: SparkSession, source: str, target: str, pattern: str = "*.csv") -> int:
    """Convert a folder of day CSVs to Parquet partitioned by day and, below it, by file; the number of files converted.

    Files of one weekday add up. A file is converted again only if its time or size has changed. Each file owns its
    partition, which is replaced as a whole; the list of converted files is written last. So a run that is repeated, or that
    broke off at any point and is repeated, leaves every file's rows exactly once.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(source)
             .where("length > 0").select("path", F.col("modificationTime").alias("modified"), "length",
                                         _file_key(F.col("_metadata.file_path")).alias("key")))
    ledger = f"{target}/{LEDGER}"
    if _exists(spark, ledger):
        converted = spark.read.schema(files.schema).parquet(ledger)
        files = saved(files.join(converted, files.columns, "left_anti"))
        # A changed file may have rows no more, in which case nothing would replace its partition.
        for row in files.join(converted, "key", "left_semi").select("key").collect():
            _delete(spark, f"{target}/day=*/{FROM}={row['key']}")
    else:
        files = saved(files)
    # As many paths as are new, which Spark's own listing of them holds too.
    paths = [row["path"] for row in files.select("path").collect()]
    if not paths:
        return 0
    rows = union_csv(spark, paths, pattern, full_path="__path").withColumn(FROM, _file_key(F.col("__path")))
    cleaned = clean_day_table(with_day(rows).drop("file_name", "__path"))
    cleaned.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", FROM).parquet(target)
    files.write.mode("append").parquet(ledger)
    return len(paths)


def _file_key(path: Column) -> Column:
    return F.substring(F.md5(path), 1, 16)


def _delete(spark: SparkSession, pattern: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in files.globStatus(where) or ():
        files.delete(found.getPath(), True)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def scan_days(spark: SparkSession, root: str, wanted: Iterable[str]) -> DataFrame:
    """The wanted days of a day-partitioned table; an error names the days that are not there.

    Days are partition values, so the check reads no column, and at most the wanted days come to the driver.
    """
    table = spark.read.parquet(root).drop(FROM)
    wanted = list(wanted)
    found = table.where(F.col("day").isin(wanted))
    there = {row["day"] for row in found.select("day").distinct().collect()}
    missing = [d for d in wanted if d not in there]
    if missing:
        raise ValueError(f"no rows for {missing} in {root}")
    return found


def empty_files(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """``file_name`` of the CSV files without a row below their header."""
    names = list_files(spark, path, pattern).select(F.element_at(F.split("path", "/"), -1).alias("file_name"))
    filled = (spark.read.option("header", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
              .schema("first string").csv(path).select(F.col("_metadata.file_name").alias("file_name")).distinct())
    return names.join(filled, "file_name", "left_anti")


def phase_inventory(files: DataFrame, names: Sequence[str] = PHASE_NAMES, path: str = "path") -> DataFrame:
    """Number of files per folder and phase, 0 for an expected phase without files."""
    pattern = phase_pattern(names)
    name = F.element_at(F.split(path, "/"), -1)
    folder = F.element_at(F.split(path, "/"), -2)
    found = files.select(folder.alias("folder"), F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).alias("phase"))
    counts = found.groupBy("folder").agg(*[F.sum(F.when(F.col("phase") == n, 1).otherwise(0)).alias(n) for n in names])
    return counts.unpivot(["folder"], list(names), "phase", "files")


def scan_logs(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """Whole log files as ``path, modified, value``."""
    return (spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True)
            .select(F.col("_metadata.file_path").alias("path"),
                    F.col("_metadata.file_modification_time").alias("modified"), "value"))


def empty_flows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
