"""Folders of CSV files: layouts by name in a fixed number of jobs, and conversion that can be repeated."""

import os

import pytest
from pyspark.sql import functions as F

from flowlens.sources import files as S


def write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write(text)


LAYOUTS = [["a", "b", "c"], ["c", "a"], [" b ", "d", "a"], ["a", "b", "c"], ["a", "a", "e"]]


def make(folder, n):
    want = []
    for i in range(n):
        names = LAYOUTS[i % len(LAYOUTS)]
        lines = [",".join(names)] + [",".join(f"{i}-{j}-{k}" for k in range(len(names))) for j in range(3)]
        write(folder, f"f_{i}.csv", "\n".join(lines) + "\n")
        for j in range(3):
            row = dict.fromkeys("abcde")
            for k, name in reversed(list(enumerate(names))):
                row[name.strip()] = f"{i}-{j}-{k}"
            want.append((*row.values(), f"f_{i}.csv"))
    return sorted(want, key=str)


def jobs(spark, group, build):
    spark.sparkContext.setJobGroup(group, group)
    try:
        rows = build().collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return rows, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_layouts_are_united_in_a_fixed_number_of_jobs(spark, tmp_path):
    counts = []
    for n in (10, 2000):
        folder = str(tmp_path / f"files{n}")
        want = make(folder, n)
        rows, used = jobs(spark, f"union{n}", lambda: S.union_csv(spark, folder).select(*"abcde", "file_name"))
        assert sorted((tuple(r) for r in rows), key=str) == want
        counts.append(used)
    assert counts[1] <= counts[0] + 2 and counts[1] < 12


def test_large_files_are_united_from_many_splits(spark, tmp_path):
    """Later splits have no header of their own, and the search for headers ends early in full ones."""
    folder = str(tmp_path / "large")
    for name, header in (("x_1.csv", "a,b"), ("x_2.csv", "b,a"), ("x_3.csv", "\nb,a")):
        write(folder, name, header + "\n" + "".join(f"{i},{-i}\n" for i in range(20_000)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        table = S.union_csv(spark, folder)
        assert spark.read.text(folder).rdd.getNumPartitions() > 9
        got = table.groupBy("file_name").agg(F.count("*").alias("n"), F.min(F.col("a").cast("int")).alias("low"),
                                             F.max(F.col("a").cast("int")).alias("high")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert sorted(tuple(r) for r in got) == [("x_1.csv", 20_000, 0, 19_999), ("x_2.csv", 20_000, -19_999, 0), ("x_3.csv", 20_000, -19_999, 0)]


def test_files_of_many_batches(spark, tmp_path):
    """Most batches of a long file hold no header line."""
    folder = str(tmp_path / "long")
    for name, header in (("x.csv", "a,b"), ("y.csv", "b,a")):
        write(folder, name, header + "\n" + "".join(f"{i},{-i}\n" for i in range(45_000)))
    got = S.union_csv(spark, folder).groupBy("file_name").agg(F.count("*").alias("n"), F.sum(F.col("a").cast("long")).alias("s")).collect()
    total = 45_000 * 44_999 // 2
    assert sorted(tuple(r) for r in got) == [("x.csv", 45_000, total), ("y.csv", 45_000, -total)]


def test_odd_layouts(spark, tmp_path):
    folder = str(tmp_path / "odd")
    write(folder, "a.csv", "﻿x,y\n1,2\n")
    write(folder, "b.csv", '"y","x, z"\n"3, 4",5\n6\n7,8,9\n')
    write(folder, "c.csv", "y,x\n")
    write(folder, "d.csv", "")
    got = sorted((tuple(r) for r in S.union_csv(spark, folder).select("x", "y", "x, z").collect()), key=str)
    assert got == sorted([("1", "2", None), (None, "3, 4", "5"), (None, "6", None), (None, "7", "8")], key=str)


def converted(spark, target):
    return sorted((r["Flow Bytes"], r["Label"], r["day"]) for r in spark.read.parquet(target).collect())


def test_conversion_can_be_repeated(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "days")
    header = " Source IP, Flow Bytes, Label\n"
    write(source, "Monday-a.csv", header + "1.1.1.1,5, BENIGN\n1.1.1.1,6, BENIGN\n")
    write(source, "Monday-b.csv", header + "1.1.1.2,7,Bot \n")
    one = [(5.0, "BENIGN", "Monday"), (6.0, "BENIGN", "Monday"), (7.0, "Bot", "Monday")]
    assert S.csv_to_days(spark, source, target) == 2 and converted(spark, target) == one
    assert S.csv_to_days(spark, source, target) == 0 and converted(spark, target) == one
    write(source, "Friday.csv", "Label,Flow Bytes\nDoS,9\n")
    two = sorted([*one, (9.0, "DoS", "Friday")])
    assert S.csv_to_days(spark, source, target) == 1 and converted(spark, target) == two
    # A file that changes replaces its own rows alone; one that loses all its rows leaves none.
    write(source, "Monday-a.csv", header + "1.1.1.1,50, BENIGN\n")
    write(source, "Monday-b.csv", header)
    three = sorted([(50.0, "BENIGN", "Monday"), (9.0, "DoS", "Friday")])
    assert S.csv_to_days(spark, source, target) == 2 and converted(spark, target) == three
    assert S.csv_to_days(spark, source, target) == 0 and converted(spark, target) == three


@pytest.mark.parametrize("broken_at", ["write", "ledger"])
def test_a_run_that_broke_off_is_repeated(spark, tmp_path, monkeypatch, broken_at):
    source, target = str(tmp_path / "in"), str(tmp_path / "days")
    for i, day in enumerate(["Monday", "Tuesday", "Tuesday"]):
        write(source, f"{day}-{i}.csv", f"Label,Flow Bytes\nBENIGN,{i}\nBot,{i + 10}\n")
    from pyspark.sql.readwriter import DataFrameWriter
    plain, done = DataFrameWriter.parquet, []

    def parquet(self, path, *more, **options):
        if path.startswith(target):
            done.append(path)
            if broken_at == "ledger" and path.endswith(S.LEDGER):
                raise OSError("the driver was lost")
            if broken_at == "write":  # the rows of some files have been moved to their places
                part = self._df.where("day = 'Monday'")
                plain(part.write.mode("append").partitionBy("day", S.FROM), path)
                raise OSError("the driver was lost")
        return plain(self, path, *more, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    with pytest.raises(OSError):
        S.csv_to_days(spark, source, target)
    monkeypatch.setattr(DataFrameWriter, "parquet", plain)
    assert len(done) and S.csv_to_days(spark, source, target) == 3
    want = sorted((float(v), label, day) for i, day in enumerate(["Monday", "Tuesday", "Tuesday"])
                  for label, v in (("BENIGN", i), ("Bot", i + 10)))
    assert converted(spark, target) == want
    assert S.csv_to_days(spark, source, target) == 0
