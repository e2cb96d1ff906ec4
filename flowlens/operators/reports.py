"""Reading metrics back out of run logs and printed tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.functions.relational import finite

# How metrics are printed in logs. # stands for a number, … for anything up to what follows.
SCORE_LABELS = {"prauc": "PR-AUC", "fpr95": "FPR@TPR=0.95", "acc": "ACC"}
DECISION_LABELS = {"precision": "Precision", "recall": "Recall", "f1": "F1", "tpr": "TPR", "fpr": "FPR"}
INTERVAL = "{label} mean=# CI95=[#,#]"
FEW_SHOT = "[FewShot] k=# reps=#"
FEW_SHOT_LABELS = {"f1": "F1", "p": "P", "r": "R"}
SPREAD = "{label} mean=# std=#"
POINT = "PR-AUC(AP):# … FPR@TPR=0.95:#"
ORACLE = "[ORACLE] best_F1=# thr=# … precision=# … recall=#"
BEST_F1 = "[BestF1] thr=# F1=# P=# R=#"
SHIFT_KINDS = ["num", "cat"]

#: One rule for every printed number: sign, point, exponent, and what stands for no number.
NUMBER = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?|[+-]?(?i:nan|inf(?:inity)?)"


def printed(line: str) -> str:
    """The expression of a printed line: its words in order, with white space or none before and after each number."""
    out = ""
    for word in re.findall(r"#|…|[^\s#…]+", line):
        if word == "#":
            out += rf"\s*({NUMBER})\s*"
        elif word == "…":
            out += r"[\s\S]*?"
        else:  # a word begins where no other word goes on
            out += (r"\s*" if out else "") + (r"(?<!\w)" if word[0].isalnum() else "") + re.escape(word)
    return out


def captured(text: Column, pattern: str, group: int) -> Column:
    """A captured number; null without a match, or where what is printed is no finite number."""
    return finite(F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("double"))


def log_intervals(logs: DataFrame, labels: Mapping[str, str], key: str = "experiment",
                  text: str = "value") -> DataFrame:
    """``key, metric, ci struct<mean, low, high>`` for every metric printed in every whole log; a ``nan`` is null."""
    def one(name: str, label: str) -> Column:
        pattern = printed(INTERVAL.format(label=label))
        ends = [captured(F.col(text), pattern, i).alias(n) for i, n in enumerate(("mean", "low", "high"), 1)]
        return F.struct(F.lit(name).alias("metric"), F.struct(*ends).alias("ci"),
                        F.col(text).rlike(pattern).alias("there"))
    found = logs.select(key, F.inline(F.array(*[one(n, label) for n, label in labels.items()])))
    return found.where("there").drop("there")


def log_few_shot(logs: DataFrame, key: str = "experiment", text: str = "value") -> DataFrame:
    """Few-shot results; a log that lacks any of the lines is left out."""
    head = printed(FEW_SHOT)
    columns, there = {n: captured(F.col(text), head, i).cast("int") for i, n in enumerate(("k", "reps"), 1)}, F.col(text).rlike(head)
    for name, label in FEW_SHOT_LABELS.items():
        line = printed(SPREAD.format(label=label))
        there = there & F.col(text).rlike(line)
        columns |= {f"{name}_{n}": captured(F.col(text), line, i) for i, n in enumerate(("mean", "std"), 1)}
    return logs.where(there).select(key, *[c.alias(n) for n, c in columns.items()])


def log_points(logs: DataFrame, line: str, names: Sequence[str], key: str = "experiment",
               text: str = "value") -> DataFrame:
    """Point metrics of a printed ``line``, one column per number; logs without it are left out."""
    pattern = printed(line)
    return logs.where(F.col(text).rlike(pattern)).select(
        key, *[captured(F.col(text), pattern, i).alias(n) for i, n in enumerate(names, 1)])


def newest_per_pattern(files: DataFrame, patterns: Mapping[str, str], path: str = "path",
                       modified: str = "modified") -> DataFrame:
    """Per name, the latest file whose path matches its pattern; equal times go by path.

    ``files`` is a listing: paths and times, never contents.
    """
    kinds = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("pattern")) for n, p in patterns.items()])
    matched = files.select(path, modified, F.inline(kinds)).where(F.regexp_like(F.col(path), F.col("pattern")))
    order = W.partitionBy("name").orderBy(F.col(modified).desc(), F.col(path))
    return matched.withColumn("__place", F.row_number().over(order)).where("__place = 1").select("name", path, modified)


def summary_table(found: DataFrame, experiments: Sequence[str], key: str = "experiment") -> DataFrame:
    """One row per expected experiment with all its metrics in one map; missing ones stay, with null."""
    expected = found.sparkSession.createDataFrame([(e,) for e in experiments], f"{key} string")
    metrics = found.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "ci")))).alias("metrics"))
    return expected.join(metrics, key, "left")


def printed_interval(ci: Column, digits: int = 6) -> Column:
    """``mean [low, high]`` as text, ``NA`` if missing."""
    number = f"%.{digits}f"
    return F.coalesce(F.when(ci.isNotNull(), F.format_string(
        f"{number} [{number}, {number}]", ci["mean"], ci["low"], ci["high"])), F.lit("NA"))


def parse_shift_table(logs: DataFrame, text: str = "value", k: int = 10) -> DataFrame:
    """The ``k`` features of the highest PSI, with PSI and KS, from the shift tables printed in whole logs.

    A table begins below the first line that starts with ``feature`` and names psi and ks, and ends at an empty line; lines that
    start with # are passed over. The first type word ends a feature's name. The two words after it are PSI and KS; where one
    of them is no number, the first two numbers after the type are. Rows whose PSI or KS is not finite are left out.
    """
    def first(items: Column, holds) -> Column:
        return F.array_position(F.transform(items, holds), F.lit(True))

    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", F.lit(" "))))
    head = first(F.col("lines"), lambda x: F.lower(x).rlike(r"^feature(?=.* psi).* ks"))
    below = F.slice("lines", F.col("head").cast("int") + 1, F.size("lines"))
    end = first(F.col("below"), lambda x: x == "")
    rows = (logs.select(lines.alias("lines")).withColumn("head", head).where("head > 0").select(below.alias("below"))
            .withColumn("end", end)
            .select(F.explode(F.slice("below", 1, F.when(F.col("end") > 0, F.col("end").cast("int") - 1).otherwise(F.size("below")))).alias("line"))
            .where(~F.col("line").startswith("#")))
    words = rows.select(F.split("line", " ").alias("words")).withColumn(
        "type", first(F.col("words"), lambda w: w.isin(SHIFT_KINDS)).cast("int"))
    named = words.where((F.col("type") > 1) & (F.size("words") >= F.col("type") + 2)).select(
        F.array_join(F.slice("words", 1, F.col("type") - 1), " ").alias("feature"),
        F.transform(F.slice("words", F.col("type") + 1, F.size("words")), lambda w: w.try_cast("double")).alias("after"))
    numbers = F.when(F.get("after", F.lit(0)).isNotNull() & F.get("after", F.lit(1)).isNotNull(), F.col("after")).otherwise(
        F.filter("after", lambda x: x.isNotNull()))
    found = named.select("feature", numbers.alias("n")).select(
        "feature", finite(F.get("n", F.lit(0))).alias("psi"), finite(F.get("n", F.lit(1))).alias("ks"))
    return found.where("psi is not null and ks is not null").orderBy(F.col("psi").desc(), "feature").limit(k)
