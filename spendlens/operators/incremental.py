"""Per-period states that are merged instead of recomputed: features (O-32..43) and
quantile sketches (O-19, O-27).

A period (by default a month of purchases) is reduced once to a small state and written as
one partition of a table. A later call adds or replaces the periods it is given and reads no
other facts; results for any cutoff or span of periods merge the states.

* Features: sums, counts, first and last purchase per customer merge as they are. Purchase
  times of different periods differ, so their distinct counts add up; the distinct
  categories are kept as a set (bounded by the number of categories). A cutoff inside a
  period takes that period's head from the facts, and only that.
* Quantiles: a KLL sketch per period and column. A merged sketch has the rank error of a
  single one; ``rank_error`` states it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import money_sum
from ..session import checkpointed
from . import features as FE
from . import profile as P
from . import quantiles as Q

PERIOD = "MONTH"
SKETCH_K = 4096


def period_of(ts: Column, period: str = PERIOD) -> Column:
    """First day of the period that holds the time."""
    return F.to_date(F.date_trunc(period, ts))


def _write(state: DataFrame, store: str) -> None:
    """Replace the periods of ``state`` in the table, leave the others."""
    writer = state.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("period").parquet(store)


# ---------------------------------------------------------------- features


def _state(rows: DataFrame, weight: str | None, keys: Sequence[str]) -> DataFrame:
    """One row per key: the mergeable aggregates behind the ten features."""
    w, ts = FE._w(weight), F.col(FE.TS)
    return rows.groupBy(*keys).agg(
        F.max(ts).alias("last"),
        F.min(ts).alias("first"),
        F.count_distinct(ts).alias("times"),
        F.sum(money_sum("total_price", w)).alias("monetary"),
        F.sum(F.when(F.col("order_item_id").isNotNull(), w)).alias("items"),
        F.sum(money_sum("price", w)).alias("price_sum"),
        F.sum(F.when(F.col("price").isNotNull(), w)).alias("price_n"),
        F.collect_set("product_category_name_english").alias("categories"),
        F.sum(w).alias("rows"),
    )


def update_features(
    sales: DataFrame, store: str, weight: str | None = None, since=None, until=None, period: str = PERIOD
) -> None:
    """Add the periods of the sales rows in [since, until) (all if not given) to the table,
    or replace them. ``since`` and ``until`` should be the bounds of periods: a period is
    replaced as a whole. Rows without a purchase time belong to no period."""
    ts = F.col(FE.TS)
    rows = sales.where(ts.isNotNull())
    rows = rows if since is None else rows.where(ts >= FE._cutoff(since))
    rows = rows if until is None else rows.where(ts < FE._cutoff(until))
    _write(_state(rows.withColumn("period", period_of(ts, period)), weight, ["period", FE.KEY]), store)


def _merged(states: DataFrame) -> DataFrame:
    """States of several periods -> the aggregates per customer."""
    return states.groupBy(FE.KEY).agg(
        F.max("last").alias("_last"),
        F.min("first").alias("_first"),
        F.sum("times").alias("frequency"),
        F.sum("monetary").alias("_monetary"),
        F.sum("items").alias("total_items"),
        F.sum("price_sum").alias("_price_sum"),
        F.sum("price_n").alias("_price_n"),
        F.size(F.array_distinct(F.flatten(F.collect_list("categories")))).cast("bigint").alias("category_count"),
        F.sum("rows").alias("_rows"),
    )


def _cut(spark: SparkSession, store: str, cutoff, sales: DataFrame | None, weight, period: str, before: bool) -> DataFrame:
    """States of all periods wholly on one side of the cutoff, and of what the cutoff's own
    period has on that side, from the facts."""
    c, ts = FE._cutoff(cutoff), F.col(FE.TS)
    start = period_of(c, period)
    stored = spark.read.parquet(store)
    at_bound = spark.range(1).select(c == start.cast("timestamp_ntz")).first()[0]
    if before:
        whole = stored.where(F.col("period") < start)
    else:
        whole = stored.where(F.col("period") >= start if at_bound else F.col("period") > start)
    whole = whole.drop("period")
    if at_bound:
        return whole
    if sales is None:
        raise ValueError("a cutoff inside a period needs the sales rows of that period")
    own = sales.where((ts >= start.cast("timestamp_ntz")) & (period_of(ts, period) == start))
    own = own.where(ts < c) if before else own.where(ts >= c)
    return whole.unionByName(_state(own, weight, [FE.KEY]))


def features_at(
    spark: SparkSession, store: str, cutoff, sales: DataFrame | None = None, weight: str | None = None, period: str = PERIOD
) -> DataFrame:
    """``features.customer_features`` of the rows before the cutoff, from the states. ``sales``
    is read for the cutoff's own period only, and not at all where the cutoff bounds one."""
    agg = checkpointed(_merged(_cut(spark, store, cutoff, sales, weight, period, before=True)))
    return FE._finish(agg, agg.select(F.max("_last")).scalar())


def realized_from(
    spark: SparkSession, store: str, cutoff, sales: DataFrame | None = None, weight: str | None = None, period: str = PERIOD
) -> DataFrame:
    """``features.realized_value`` of the rows on or after the cutoff, from the states."""
    states = _cut(spark, store, cutoff, sales, weight, period, before=False)
    spent = F.coalesce(F.sum("monetary"), F.lit(0)).cast("double").alias("actual_cltv")
    return states.where(F.col(FE.KEY).isNotNull()).groupBy(FE.KEY).agg(spent)


# ---------------------------------------------------------------- quantile sketches


def rank_error(k: int = SKETCH_K) -> float:
    """Largest distance between the wanted and the true normalized rank of a sketched
    quantile, at 99 % confidence (the published error of the KLL sketch of size k)."""
    return 2.296 / k**0.9021


def update_sketches(
    df: DataFrame, columns: Sequence[str], store: str, ts: str = FE.TS, since=None, until=None, k: int = SKETCH_K, period: str = PERIOD
) -> None:
    """Add or replace the sketches of the periods in [since, until): one row per period and
    column (period, column_name, n, lo, hi, sketch); columns without values have none."""
    rows = df.where(F.col(ts).isNotNull())
    rows = rows if since is None else rows.where(F.col(ts) >= FE._cutoff(since))
    rows = rows if until is None else rows.where(F.col(ts) < FE._cutoff(until))
    aggs: list[Column] = []
    for j, c in enumerate(columns):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{j}"), F.min(x).alias(f"lo{j}"), F.max(x).alias(f"hi{j}"), F.kll_sketch_agg_double(x, k).alias(f"s{j}")]
    wide = rows.groupBy(period_of(F.col(ts), period).alias("period")).agg(*aggs)
    cells = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"n{j}").alias("n"), F.col(f"lo{j}").alias("lo"), F.col(f"hi{j}").alias("hi"), F.col(f"s{j}").alias("sketch"))
        for j, c in enumerate(columns)
    ]
    _write(wide.select("period", F.inline(F.array(*cells))).where("n > 0"), store)


def sketched_quantiles(spark: SparkSession, store: str, probs: Sequence[float], periods: Column | None = None) -> DataFrame:
    """``(column_name, p, q)`` over the stored periods (or those where ``periods`` holds), within
    ``rank_error``; the least and the greatest value are exact. Reads no facts."""
    state = spark.read.parquet(store)
    state = state if periods is None else state.where(periods)
    merged = state.groupBy("column_name").agg(
        F.kll_merge_agg_double("sketch").alias("sketch"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    ps = F.array(*[F.lit(float(x)) for x in probs])
    found = merged.select("column_name", "lo", "hi", F.kll_sketch_get_quantile_double("sketch", ps).alias("q"))
    each = found.select("column_name", "lo", "hi", F.inline(F.arrays_zip(ps.alias("p"), F.col("q").alias("q"))))
    q = F.when(F.col("p") <= 0, F.col("lo")).when(F.col("p") >= 1, F.col("hi")).otherwise(F.col("q"))
    return each.select("column_name", "p", q.alias("q"))


def sketched_limits(
    spark: SparkSession, store: str, lower_q: float = P.CAP_QUANTILES[0], upper_q: float = P.CAP_QUANTILES[1], periods: Column | None = None
) -> DataFrame:
    """``profile.outlier_limits`` from the stored sketches."""
    return P._iqr_limits(sketched_quantiles(spark, store, [lower_q, upper_q], periods), lower_q, upper_q)


def rank_check(df: DataFrame, found: DataFrame, columns: Sequence[str], slack: float) -> DataFrame:
    """Whether each sketched quantile's true ranks come within ``slack`` of the wanted one:
    ``(column_name, p, n, within_bound)``. One pass; ``found`` has a row per column and p."""
    long = Q.to_long(df, columns)
    n = F.count(F.lit(1))
    below, upto = F.count_if(F.col("value") < F.col("q")), F.count_if(F.col("value") <= F.col("q"))
    # A row per column and probability: a proven bound, safe to broadcast.
    joined = long.join(F.broadcast(found), "column_name").groupBy("column_name", "p")
    counts = joined.agg(n.alias("n"), below.alias("below"), upto.alias("upto"))
    fits = (F.col("below") <= (F.col("p") + slack) * F.col("n")) & (F.col("upto") >= (F.col("p") - slack) * F.col("n"))
    return counts.select("column_name", "p", "n", fits.alias("within_bound"))
