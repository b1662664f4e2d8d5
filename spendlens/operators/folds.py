"""Sampling and folds: O-60..62.

Row membership comes from an md5 hash of the id and a seed, so it does not depend
on partitioning or task retries (``randomSplit`` does). The contiguous folds need
each row's position in key order; it is computed without a global window (which
would put every row in one task): a range-partitioned sort, a per-partition count
(one row per partition), prefix sums over those counts, and a join back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import hash_unit
from ..session import checkpointed

SEED = 42
TEST_SHARE = 0.2
K_SHUFFLED = 5
K_CONTIGUOUS = 3
_SPLIT_RESOLUTION = 10000


def train_test_split(
    df: DataFrame, id_col: str = "customer_unique_id", test_share: float = TEST_SHARE, seed: int = SEED
) -> DataFrame:
    """O-60: adds ``split`` = 'test' for a ``test_share`` of ids, else 'train'."""
    bucket = hash_unit(id_col, seed) % _SPLIT_RESOLUTION
    cut = int(round(test_share * _SPLIT_RESOLUTION))
    return df.withColumn("split", F.when(bucket < cut, F.lit("test")).otherwise(F.lit("train")))


def kfold_assign(df: DataFrame, id_col: str = "customer_unique_id", k: int = K_SHUFFLED, seed: int = SEED) -> DataFrame:
    """O-61: shuffled k-fold: ``fold`` in 0..k-1 from a second slice of the id hash."""
    return df.withColumn("fold", (hash_unit(id_col, seed, start=9) % k).cast("int"))


def row_index(df: DataFrame, order_by: Sequence[str], name: str = "row_index") -> DataFrame:
    """0-based position of every row in ``order_by`` order (ties must not occur)."""
    ordered = df.orderBy(*order_by).withColumn("_mid", F.monotonically_increasing_id())
    # Materialise once so both uses below see the same partitioning and ids.
    ordered = checkpointed(ordered)
    part = F.shiftright(F.col("_mid"), 33)
    counts = ordered.groupBy(part.alias("_pid")).agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_start"))
    # One row per partition: a bounded frame, so a global window and a broadcast are safe.
    offsets = counts.select(
        "_pid", "_start", (F.sum("_cnt").over(W.orderBy("_pid")) - F.col("_cnt")).alias("_offset")
    )
    joined = ordered.join(F.broadcast(offsets), part == F.col("_pid"))
    return joined.select(
        *df.columns, (F.col("_offset") + F.col("_mid") - F.col("_start")).alias(name)
    )


def kfold_contiguous(df: DataFrame, order_by: Sequence[str] = ("customer_unique_id",), k: int = K_CONTIGUOUS) -> DataFrame:
    """O-62: unshuffled k-fold: contiguous blocks in key order, the first ``n mod k``
    folds one row longer (SQL ``ntile(k)``). ``fold`` in 1..k."""
    idx = row_index(df, list(order_by), "_i")
    n = idx.select(F.count(F.lit(1))).scalar()
    q = F.floor(n / k).cast("bigint")
    r = (n % k).cast("bigint")
    big = r * (q + 1)
    i = F.col("_i")
    fold = F.when(i < big, F.floor(i / (q + 1)) + 1).otherwise(r + F.floor((i - big) / q) + 1)
    return idx.withColumn("fold", fold.cast("int")).drop("_i")
