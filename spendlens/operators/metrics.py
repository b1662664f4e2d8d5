"""Regression metrics as aggregates (O-55, O-65): the same numbers as
``RegressionEvaluator``, from any (label, prediction) frame, computed with the mean
first (two passes) rather than the one-pass form that loses digits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regression_metrics(df: DataFrame, label: str = "cltv_log", prediction: str = "prediction") -> DataFrame:
    """``(n, rmse, r2, mae)`` over the rows of ``df``."""
    y, p = F.col(label), F.col(prediction)
    mean_y = df.select(F.avg(label)).scalar()
    # The centred label is projected before the aggregate (a subquery result may
    # not appear inside an aggregate's arguments).
    d = df.select((y - p).alias("_e"), (y - mean_y).alias("_c"))
    e, c = F.col("_e"), F.col("_c")
    return d.agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.lit(1.0) - F.sum(e * e) / F.sum(c * c)).alias("r2"),
        F.avg(F.abs(e)).alias("mae"),
    )
