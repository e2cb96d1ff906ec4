"""Spark ML stages that fit exactly what the feature operators fit, and are saved with the pipeline they stand in.

A pipeline is ``FeatureColumns`` (the stored feature list), the imputers, the scaler, one-hot encoding and a classifier. All stages but
the first work on that stage's own columns, so the columns of a scored table stay as they are. A fitted value is one number or
text for each column of the schema; it is a parameter of the model, hence in its JSON.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.relational import finite
from flowlens.operators import features as FT

PREFIX = "__f_"


def own(columns: Sequence[str]) -> list[str]:
    """Names of the pipeline's own copies of feature columns."""
    return [f"{PREFIX}{c}" for c in columns]


class _Columns(Params):
    """``columns``: the columns a stage works on."""

    columns: Param = Param(Params._dummy(), "columns", "columns the stage works on", TypeConverters.toListString)

    def __init__(self, columns: Sequence[str] | None = None):
        super().__init__()
        if columns is not None:
            self._set(columns=list(columns))

    def names(self) -> list[str]:
        return self.getOrDefault(self.columns)


class FeatureColumns(Transformer, Params, DefaultParamsReadable, DefaultParamsWritable):
    """The feature list of a model: its columns as numbers or text, under names of the pipeline's own.

    Numbers come by ``try_cast``, so garbage counts as missing, and missing or non-finite values are null. A column that the table
    lacks is missing in every row: with ``absent="null"`` the imputers fill it, with ``absent="default"`` it is 0 or ``unk``.
    """

    numeric: Param = Param(Params._dummy(), "numeric", "number columns", TypeConverters.toListString)
    categorical: Param = Param(Params._dummy(), "categorical", "text columns", TypeConverters.toListString)
    absent: Param = Param(Params._dummy(), "absent", "null or default", TypeConverters.toString)

    def __init__(self, numeric: Sequence[str] | None = None, categorical: Sequence[str] = (), absent: str = "default"):
        super().__init__()
        if absent not in ("null", "default"):
            raise ValueError(f"absent must be null or default, not {absent}")
        if numeric is not None:
            self._set(numeric=list(numeric), categorical=list(categorical), absent=absent)

    def lists(self) -> tuple[list[str], list[str]]:
        return self.getOrDefault(self.numeric), self.getOrDefault(self.categorical)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        numeric, categorical = self.lists()
        fill = self.getOrDefault(self.absent) == "default"
        have = set(dataset.columns)

        def number(name: str):
            if name in have:
                return finite(F.col(f"`{name}`").try_cast("double"))
            return F.lit(0.0 if fill else None).cast("double")

        def text(name: str):
            if name in have:
                return F.col(f"`{name}`").cast("string")
            return F.lit("unk" if fill else None).cast("string")

        return dataset.withColumns({PREFIX + c: number(c) for c in numeric} | {PREFIX + c: text(c) for c in categorical})


class _Fitted(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    def values(self) -> dict:
        return dict(zip(self.names(), self.getOrDefault(self.fitted)))


class _Numbers(_Fitted):
    fitted: Param = Param(Params._dummy(), "fitted", "a number for each column", TypeConverters.toListFloat)

    def __init__(self, columns: Sequence[str] | None = None, fitted: Sequence[float] | None = None):
        super().__init__(columns)
        if fitted is not None:
            self._set(fitted=list(fitted))


class MedianImputer(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Missing numbers become the exact median of the training rows; 0 where a column has no value at all."""

    def _fit(self, dataset: DataFrame) -> MedianImputerModel:
        found = {r["feature"]: r["median"] for r in FT.fit_medians(dataset, self.names()).collect()}
        return MedianImputerModel(self.names(), [found[c] for c in self.names()])


class MedianImputerModel(_Numbers):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.values().items()})


class ModeImputer(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Missing text becomes the most frequent value of the training rows, the smallest among equals; ``unk`` where a
    column has no value at all."""

    def _fit(self, dataset: DataFrame) -> ModeImputerModel:
        found = {r["feature"]: r["mode"] for r in FT.fit_modes(dataset, self.names()).collect()}
        return ModeImputerModel(self.names(), [found.get(c, "unk") for c in self.names()])


class ModeImputerModel(_Fitted):
    fitted: Param = Param(Params._dummy(), "fitted", "a text for each column", TypeConverters.toListString)

    def __init__(self, columns: Sequence[str] | None = None, fitted: Sequence[str] | None = None):
        super().__init__(columns)
        if fitted is not None:
            self._set(fitted=list(fitted))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.values().items()})


class PopulationScaler(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Numbers divided by the population standard deviation of the training rows, not centred; constant columns by 1."""

    def _fit(self, dataset: DataFrame) -> PopulationScalerModel:
        found = {r["feature"]: r["scale"] for r in FT.fit_scales(dataset, self.names()).collect()}
        return PopulationScalerModel(self.names(), [found[c] for c in self.names()])


class PopulationScalerModel(_Numbers):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({c: F.col(c) / F.lit(v) for c, v in self.values().items()})
