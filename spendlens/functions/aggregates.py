"""Aggregate expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import ColumnOrName, col


def pearson(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Pearson correlation over the rows where both values are present
    (pairwise-complete, as pandas computes it). A constant column gives null
    (pandas: NaN) instead of a division error under ANSI mode."""
    x, y = col(a), col(b)
    px, py = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_samp(px, py), F.sqrt(F.var_samp(px) * F.var_samp(py)))
