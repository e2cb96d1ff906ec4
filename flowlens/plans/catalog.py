"""All registered queries."""

from __future__ import annotations

import importlib
import pkgutil

from pyspark.sql import DataFrame, SparkSession

from flowlens import plans
from flowlens.operators import metrics as M
from flowlens.plans import views as V
from flowlens.plans.registry import ORACLES, QUERIES, rounded

for _module in pkgutil.iter_modules(plans.__path__):
    if _module.name.startswith("q_"):
        importlib.import_module(f"flowlens.plans.{_module.name}")

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Curve metrics per kind of profile: one score curve for all of them."""
    rows = V.scored_fine(spark, folder)
    return rounded(M.summary(M.score_curve(rows, ["profile"]), ["profile"], targets=(0.90, 0.95, 0.99),
                             budgets=(0.01, 0.05)))
