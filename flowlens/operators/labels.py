"""Labels for flows: from text, numbers, addresses, phases and file names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.cleaning import number_or_zero
from flowlens.functions.relational import attach, fitted

# The label of harmless traffic, and label families by name prefix.
BENIGN = "BENIGN"
FAMILY_PREFIXES = {
    "benign": "benign",
    "attack_exfil": "attack_exfil",
    "attack": "attack_main",
}


def text_label(df: DataFrame, label: str = "Label", into: str = "y_true") -> DataFrame:
    """1 unless the trimmed label says benign, in any case."""
    return df.withColumn(into, (F.upper(F.trim(F.col(label))) != BENIGN).cast("int"))


def numeric_label(df: DataFrame, label: str = "label", into: str = "y_true") -> DataFrame:
    """1 unless the value is 0, missing or unreadable, ``NaN`` among that. A fraction such as 0.5 counts as 1."""
    return df.withColumn(into, (number_or_zero(F.col(label)) != 0).cast("int"))


def multiclass_label(df: DataFrame, label: str, binary: str | None = None, into: str = "y_true") -> DataFrame:
    """The class name as label; the binary label goes, so that it cannot leak."""
    kept = df.drop(binary) if binary else df
    named = kept.withColumn(into, F.coalesce(F.col(label).cast("string"), F.lit("nan")))
    return named.drop(label) if label != into else named


def attacker_label(df: DataFrame, attacker: str, source: str = "saddr", into: str = "y_true") -> DataFrame:
    """1 for flows from one attacker address."""
    return df.withColumn(into, F.coalesce((F.col(source) == attacker.strip()).cast("int"), F.lit(0)))


def attackers_label(df: DataFrame, attackers: DataFrame, address: str, source: str = "saddr",
                    into: str = "y_true") -> DataFrame:
    """1 for flows from any listed address."""
    marks = fitted(attackers.select(F.col(address).alias(source), F.lit(1).alias(into)).distinct())
    return df.join(marks, source, "left").withColumn(into, F.coalesce(F.col(into), F.lit(0)))


def phase_label(df: DataFrame, y_true: int, attack_type: str) -> DataFrame:
    """One constant label for a whole capture phase."""
    return df.withColumns({"y_true": F.lit(y_true), "attack_type": F.lit(attack_type)})


def label_from_type(df: DataFrame, kind: str = "attack_type") -> DataFrame:
    """``y_true`` from the phase name where it is missing: benign is 0, all else 1."""
    derived = F.when(F.col(kind) == "benign", 0).otherwise(1)
    return df.withColumn("y_true", F.coalesce(F.col("y_true"), derived) if "y_true" in df.columns else derived)


def family_label(df: DataFrame, name: str, into: str = "attack_type") -> DataFrame:
    """Family by the longest matching name prefix, so each name gets exactly one; null if none matches."""
    choice = None
    for prefix in sorted(FAMILY_PREFIXES, key=len, reverse=True):
        hit = F.startswith(F.col(name), F.lit(prefix + "_"))
        family = FAMILY_PREFIXES[prefix]
        choice = F.when(hit, family) if choice is None else choice.when(hit, family)
    return df.withColumn(into, choice)


def class_weights(df: DataFrame, classes: Sequence, label: str = "y_true", into: str = "weight") -> DataFrame:
    """Balanced weights ``n / (classes · n_class)`` from one counting pass."""
    counts = df.agg(F.count(F.lit(1)).alias("n"),
                    *[F.sum((F.col(label) == c).cast("int")).alias(f"n_{i}") for i, c in enumerate(classes)])
    choice = None
    for i, c in enumerate(classes):
        value = F.col("n") / (F.lit(float(len(classes))) * F.greatest(F.col(f"n_{i}"), F.lit(1)))
        choice = F.when(F.col(label) == c, value) if choice is None else choice.when(F.col(label) == c, value)
    return (attach(df, counts.withColumnsRenamed({c: f"__{c}" for c in counts.columns}), [])
            .withColumnsRenamed({f"__{c}": c for c in counts.columns})
            .withColumn(into, choice).drop(*counts.columns))
