"""The flagship query: modelling frame of every customer, top 100 by realised value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, rank
from ..sources.fixtures import TEST_CUTOFF, fixture_tables
from . import pipeline


def flagship(spark: SparkSession, sf_dir: str, n: int = 100) -> DataFrame:
    mf = pipeline.modeling_frame(fixture_tables(spark, sf_dir), TEST_CUTOFF)
    best = rank.top_n(mf, "actual_cltv", n, features.KEY)
    return best.join(mf.drop("actual_cltv"), features.KEY).orderBy("rank").select(
        "rank", features.KEY, "actual_cltv", *features.FEATURES, F.round("cltv_log", 6).alias("cltv_log")
    )
