"""Connected components of an edge list that stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

MAX_ROUNDS = 60


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v): for every node u that is not the smallest of its component, the smallest v.

    ``edges`` has long columns u, v; loops, repeats and either direction are fine. Large-star
    and small-star rounds: each node joins its larger, then its smaller neighbours to the
    smallest one it sees. A hub costs one partial minimum per task before its shuffle, and
    the joins that follow can be split by the adaptive skew join. Rounds are checkpointed.
    """
    large, small = F.greatest("u", "v"), F.least("u", "v")
    now = checkpointed(edges.where("u <> v").select(large.alias("u"), small.alias("v")).distinct())
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            return now
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        grown = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        grown = grown.where("u <> v").distinct()
        least = grown.groupBy("u").agg(F.min("v").alias("m"))
        pulled = grown.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpointed(pulled.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(now)
        if state == before:
            return now
    raise RuntimeError("components did not settle")
