"""Top-N ranking and overlap: O-44..46.

Top-N over the whole frame is ``orderBy(...).limit(n)``, planned as
TakeOrderedAndProject: every task keeps its own n best, one task merges
n x tasks rows. Top-N per group (per fold) must not send a whole group to one
task, so it runs in two rounds: first per (group, salt) slice, then per group over
at most n x salts survivors; the union of slice winners always contains the
group's winners, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import hash_unit
from ..session import checkpointed

TOP_N = 100


def _order(score: str, id_col: str) -> list[Column]:
    return [F.col(score).desc_nulls_last(), F.col(id_col).asc()]


def top_n(df: DataFrame, score: str, n: int = TOP_N, id_col: str = "customer_unique_id") -> DataFrame:
    """O-44: the ``n`` rows with the highest ``score``; ties broken by id.
    ``(id, score, rank)``; the rank window runs over the n result rows only."""
    best = df.select(id_col, score).orderBy(*_order(score, id_col)).limit(n)
    return best.withColumn("rank", F.row_number().over(W.orderBy(*_order(score, id_col))).cast("bigint"))


def top_n_overlap(
    df: DataFrame,
    true_col: str,
    pred_col: str,
    n: int = TOP_N,
    id_col: str = "customer_unique_id",
) -> DataFrame:
    """O-45: how many of the true top-n ids are also in the predicted top-n."""
    a = df.select(id_col, true_col).orderBy(*_order(true_col, id_col)).limit(n).select(id_col)
    b = df.select(id_col, pred_col).orderBy(*_order(pred_col, id_col)).limit(n).select(id_col)
    return a.intersect(b).agg(F.count(F.lit(1)).alias("overlap")).select(
        F.lit(n).alias("top_n"), "overlap"
    )


def top_n_per_group(
    df: DataFrame,
    group: Sequence[str],
    score: str,
    n: int = TOP_N,
    id_col: str = "customer_unique_id",
    salts: int | None = None,
) -> DataFrame:
    """Exact top-n per group in two rounds (see module doc). Adds ``rank``.
    ``salts`` defaults to the shuffle partition count, so a group's first round
    spreads over as many tasks as the cluster shuffles into."""
    g = list(group)
    order = _order(score, id_col)
    if salts is None and n <= int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        # Spark keeps a task's n best of each group ahead of the exchange
        ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(*g).orderBy(*order)))
        return ranked.where(F.col("rank") <= n)
    salts = salts or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    salted = df.withColumn("_salt", hash_unit(id_col, "salt") % salts)
    first = salted.withColumn("_r", F.row_number().over(W.partitionBy(*g, "_salt").orderBy(*order)))
    survivors = first.where(F.col("_r") <= n).drop("_r", "_salt")
    ranked = survivors.withColumn("rank", F.row_number().over(W.partitionBy(*g).orderBy(*order)))
    return ranked.where(F.col("rank") <= n)


def top_n_overlap_by_fold(
    df: DataFrame,
    true_col: str,
    pred_col: str,
    fold_col: str = "fold",
    n: int = TOP_N,
    id_col: str = "customer_unique_id",
) -> DataFrame:
    """O-46: per fold, the overlap of true and predicted top-n ids, with the mean
    over folds on every row: ``(fold, overlap, mean_overlap)``."""
    # Read three times; the rows are spread evenly, so that no task sorts more than its share.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    df = checkpointed(df.select(fold_col, id_col, true_col, pred_col).repartition(parts, id_col))
    t = top_n_per_group(df.select(fold_col, id_col, true_col), [fold_col], true_col, n, id_col).select(
        fold_col, id_col
    )
    p = top_n_per_group(df.select(fold_col, id_col, pred_col), [fold_col], pred_col, n, id_col).select(
        fold_col, id_col
    )
    folds = df.select(fold_col).distinct()
    per_fold = (
        folds.join(t.join(p, [fold_col, id_col]).groupBy(fold_col).agg(F.count(F.lit(1)).alias("_o")), fold_col, "left")
        .select(fold_col, F.coalesce(F.col("_o"), F.lit(0)).cast("double").alias("overlap"))
    )
    # One row per fold: a bounded frame, so a global window is fine here.
    return per_fold.withColumn("mean_overlap", F.avg("overlap").over(W.partitionBy(F.lit(0))))
