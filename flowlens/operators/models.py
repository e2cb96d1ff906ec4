"""Classifiers on Spark ML, from feature columns to a prediction table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators import metrics as M
from flowlens.operators.cells import Boosted, BoostedInTask, Logistic, Perceptron
from flowlens.operators.forest import Forest
from flowlens.operators.stages import (PREFIX, FeatureColumns, MedianImputer, MedianImputerModel, ModeImputer,
                                       ModeImputerModel, PopulationScaler, PopulationScalerModel, own)
from flowlens.operators.staged import best_prefix
from flowlens.session import saved


def logistic(iterations: int = 200, weight: str | None = None, **params) -> Logistic:
    model = Logistic(featuresCol="features", labelCol="y_true", maxIter=iterations, **params)
    return model.setWeightCol(weight) if weight else model


def forest(trees: int = 200, depth: int = 10, seed: int = 7, **params) -> Forest:
    return Forest(featuresCol="features", labelCol="y_true", numTrees=trees, maxDepth=depth, seed=seed, **params)


def boosted(rounds: int = 100, depth: int = 6, rate: float = 0.05, subsample: float = 0.8, seed: int = 7,
            **params) -> Boosted:
    return BoostedInTask(featuresCol="features", labelCol="y_true", maxIter=rounds, maxDepth=depth, stepSize=rate,
                         subsamplingRate=subsample, seed=seed, **params)


def perceptron(inputs: int, classes: int = 2, hidden: Sequence[int] = (256, 128), iterations: int = 50,
               seed: int = 7, **params) -> Perceptron:
    return Perceptron(featuresCol="features", labelCol="y_true", layers=[inputs, *hidden, classes], maxIter=iterations, seed=seed, **params)


def preparation(numeric: Sequence[str], categorical: Sequence[str] = (), scaled: bool = True,
                absent: str = "default") -> list:
    """Stages from columns to ``features``: numbers with missing ones at the median, divided by their deviation if
    ``scaled``; text with missing values at the most frequent one, then one-hot (unseen values all zero)."""
    numbers, texts = own(numeric), own(categorical)
    indexed, hot = [f"{c}__index" for c in texts], [f"{c}__hot" for c in texts]
    stages: list = [FeatureColumns(numeric, categorical, absent)]
    if numeric:
        stages += [MedianImputer(numbers), *([PopulationScaler(numbers)] if scaled else [])]
    if categorical:
        stages += [ModeImputer(texts),
                   StringIndexer(inputCols=texts, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"),
                   OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True)]
    return [*stages, VectorAssembler(inputCols=[*numbers, *hot], outputCol="features", handleInvalid="error")]


def fit(train: DataFrame, classifier: Estimator, numeric: Sequence[str], categorical: Sequence[str] = (),
        scaled: bool = True, absent: str = "default") -> PipelineModel:
    """Everything from raw columns to scores in one model, fitted on the training rows alone."""
    return Pipeline(stages=[*preparation(numeric, categorical, scaled, absent), classifier]).fit(train)


def feature_list(model: PipelineModel) -> tuple[list[str], list[str]]:
    """Number and text columns that a fitted or loaded pipeline was made for."""
    return next(s for s in model.stages if isinstance(s, FeatureColumns)).lists()


def score(model: PipelineModel, rows: DataFrame, keep: Sequence[str] = ("row_id", "y_true")) -> DataFrame:
    """Prediction table: ``keep``, the probability of class 1 and the decision at 0.5."""
    scored = model.transform(rows).withColumn("y_score", vector_to_array("probability")[1])
    return scored.select(*keep, "y_score", (F.col("y_score") >= 0.5).cast("int").alias("y_pred"))


def predictions(model: PipelineModel, rows: DataFrame, keep: Sequence[str] = ("row_id", "y_true")) -> DataFrame:
    """The prediction table written once, so that no later pass over it runs the model again."""
    return saved(score(model, rows, keep))


def classify(model: PipelineModel, rows: DataFrame, keep: Sequence[str] = ("row_id", "y_true")) -> DataFrame:
    """Most likely class of a model with several classes."""
    return model.transform(rows).select(*keep, F.col("prediction").cast("int").alias("y_pred"))


def fitted_values(model: PipelineModel) -> tuple[dict, dict]:
    """What stands in for missing values, by feature, and the scale of the numbers."""
    fills, scales = {}, {}
    for stage in model.stages:
        if isinstance(stage, (MedianImputerModel, ModeImputerModel)):
            fills |= {c.removeprefix(PREFIX): v for c, v in stage.values().items()}
        elif isinstance(stage, PopulationScalerModel):
            scales |= {c.removeprefix(PREFIX): v for c, v in stage.values().items()}
    return fills, scales


def score_new(model: PipelineModel, rows: DataFrame, keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """Score a table that may lack features of the model's own list: absent numbers are 0, absent text is ``unk``."""
    return score(model, rows, keep)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def compare(train: DataFrame, test: DataFrame, classifiers: Mapping[str, Estimator], numeric: Sequence[str],
            categorical: Sequence[str] = (), keep: Sequence[str] = ("row_id", "y_true")) -> DataFrame:
    """Prediction tables of several classifiers in one, under ``model``."""
    out = None
    for name, classifier in classifiers.items():
        part = predictions(fit(train, classifier, numeric, categorical), test, keep).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no classifier given")
    return out


def model_report(scored: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    """PR-AUC, FPR at 95 % TPR and accuracy per group."""
    curve = M.summary(M.score_curve(scored, groups), groups).select(
        *groups, "pr_auc", F.col("fpr_at_tpr95").alias("fpr95"))
    return curve.join(M.accuracy(scored, groups), list(groups))


def best_by_validation(train: DataFrame, val: DataFrame, build: Callable[[int], Estimator], grid: Sequence[int],
                       numeric: Sequence[str], categorical: Sequence[str] = ()) -> tuple[int, PipelineModel, DataFrame]:
    """The setting with the best validation average precision; the smaller one among equals.

    Returns the setting, its model and the table ``setting, pr_auc``. Only that table, one row per
    setting, comes to the driver.
    """
    models = {setting: fit(train, build(setting), numeric, categorical) for setting in grid}
    scored = None
    for setting, model in models.items():
        part = predictions(model, val, ["y_true"]).withColumn("setting", F.lit(setting))
        scored = part if scored is None else scored.unionByName(part)
    table = M.summary(M.score_curve(scored, ["setting"]), ["setting"]).select("setting", "pr_auc")
    best = table.orderBy(F.col("pr_auc").desc(), "setting").first()
    return best["setting"], models[best["setting"]], table


def best_rounds(model: PipelineModel, val: DataFrame) -> tuple[int, PipelineModel, DataFrame]:
    """Of a fitted pipeline that ends in a boosted classifier: the round with the best validation average precision (the
    earliest among equals), the pipeline up to that round, and ``round, pr_auc`` for all, without fitting again."""
    *before, classifier = model.stages
    best, short, table = best_prefix(classifier, PipelineModel(before).transform(val))
    return best, PipelineModel([*before, short]), table
