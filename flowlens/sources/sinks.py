"""Writing prediction tables, reports and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.relational import require_columns
from flowlens.schemas import PRED_COLUMNS


def prediction_table(df: DataFrame) -> DataFrame:
    """The prediction contract: ``y_true`` int, ``y_score`` double, ``y_pred`` int, and the optional keys."""
    require_columns(df, ["y_true", "y_score", "y_pred"])
    kinds = {"y_true": "int", "y_score": "double", "y_pred": "int", "attack_type": "string"}
    return df.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c)
                       for c in PRED_COLUMNS if c in df.columns])


def write_predictions(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    prediction_table(df).write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Headered CSV, as many files as the table has partitions."""
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per row; nested structs stay nested and nulls are kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
