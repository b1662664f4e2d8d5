"""Customer features before a cutoff and value realised after it: O-11, O-31..43.

The source computes six group-bys on the same key and joins them back; here all
features come from one ``groupBy(customer).agg(...)``: one shuffle, with map-side
partial aggregation, so a customer holding a third of all rows is pre-reduced in
every task before anything moves. The two distinct counts are planned by Spark as
an expand + two-level aggregate, which also spreads a hot customer over tasks.

Every aggregate takes an optional row multiplicity (``weight``), so the same code
runs on the literal payment fan-out frame (weight 1) and on ``weighted_sales``
(weight = payment rows per order) with identical results.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import elapsed_days, flag, log_target, money_sum
from ..session import checkpointed

KEY = "customer_unique_id"
TS = "order_purchase_timestamp"
FEATURES = (
    "recency",
    "frequency",
    "monetary",
    "avg_order_value",
    "total_items",
    "avg_item_price",
    "category_count",
    "tenure_days",
    "purchase_interval",
    "is_repeat_customer",
)
LABEL = "cltv_log"

DEFAULT_CUTOFF = "2018-01-01"


def _cutoff(cutoff: str | dt.datetime | dt.date) -> Column:
    return F.lit(str(cutoff)).cast("timestamp_ntz")


def cutoff_split(df: DataFrame, cutoff=DEFAULT_CUTOFF, ts: str = TS) -> tuple[DataFrame, DataFrame]:
    """O-11: rows before the cutoff, rows on/after it; a null timestamp is in neither.
    Both are plain filters and reach the scan (and partition pruning when the sales
    data is partitioned by date)."""
    c = _cutoff(cutoff)
    return df.where(F.col(ts) < c), df.where(F.col(ts) >= c)


def _w(weight: str | None) -> Column:
    return F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")


def _when(cond: Column | None, value: Column) -> Column:
    return value if cond is None else F.when(cond, value)


#: Aggregates behind each feature; the ones of ``frequency`` are always needed.
_NEEDS = {
    "recency": ("_last",),
    "frequency": ("frequency",),
    "monetary": ("_monetary",),
    "avg_order_value": ("_monetary",),
    "total_items": ("total_items",),
    "avg_item_price": ("_price_sum", "_price_n"),
    "category_count": ("category_count",),
    "tenure_days": ("_first", "_last"),
    "purchase_interval": ("_first", "_last", "_rows"),
    "is_repeat_customer": ("frequency",),
}


def _aggregates(weight: str | None, cond: Column | None = None, wanted: Sequence[str] = FEATURES) -> list[Column]:
    """Per-customer aggregates behind the wanted features, over the rows where ``cond``
    holds (all rows if None)."""
    w = _w(weight)
    ts = F.col(TS)
    has_price = F.col("price").isNotNull()
    every = {
        "_last": F.max(_when(cond, ts)),
        "_first": F.min(_when(cond, ts)),
        "frequency": F.count_distinct(_when(cond, ts)),
        "_monetary": F.sum(_when(cond, money_sum("total_price", w))),
        "total_items": F.sum(_when(cond, F.when(F.col("order_item_id").isNotNull(), w))),
        "_price_sum": F.sum(_when(cond, money_sum("price", w))),
        "_price_n": F.sum(_when(cond, F.when(has_price, w))),
        "category_count": F.count_distinct(_when(cond, F.col("product_category_name_english"))),
        "_rows": F.sum(_when(cond, w)),
    }
    needed = {"frequency", *(a for f in wanted for a in _NEEDS[f])}
    return [c.alias(name) for name, c in every.items() if name in needed]


def _finish(
    agg: DataFrame, reference_date: Column | None, extra: tuple[str, ...] = (), wanted: Sequence[str] = FEATURES
) -> DataFrame:
    """Derive the wanted features from the raw aggregates (narrow, per row). The null
    key group is dropped here, after it took part in the reference date."""
    monetary = F.coalesce(F.col("_monetary"), F.lit(0)).cast("double")
    tenure = elapsed_days("_first", "_last")
    rows = F.col("_rows")
    every = {
        "recency": lambda: elapsed_days(F.col("_last"), reference_date),
        "frequency": lambda: F.col("frequency"),
        "monetary": lambda: monetary,
        "avg_order_value": lambda: monetary / F.col("frequency"),
        "total_items": lambda: F.coalesce(F.col("total_items"), F.lit(0)).cast("bigint"),
        "avg_item_price": lambda: F.when(
            F.col("_price_n") > 0, F.col("_price_sum").cast("double") / F.col("_price_n").cast("double")
        ),
        "category_count": lambda: F.col("category_count"),
        "tenure_days": lambda: tenure,
        "purchase_interval": lambda: F.when(rows > 1, tenure.cast("double") / (rows - 1).cast("double")).otherwise(F.lit(0.0)),
        "is_repeat_customer": lambda: flag(F.col("frequency") > 1),
    }
    kept = agg.where(F.col(KEY).isNotNull() & (F.col("frequency") > 0))
    return kept.select(KEY, *[every[f]().alias(f) for f in wanted], *extra)


def reference_date(train: DataFrame, ts: str = TS) -> Column:
    """O-31: latest purchase time on the train side, as a scalar subquery (computed
    once, no join)."""
    return train.select(F.max(ts)).scalar()


def customer_features(train: DataFrame, weight: str | None = None, wanted: Sequence[str] = FEATURES) -> DataFrame:
    """O-32..39, O-42, O-43: one row per customer with the ten model features, or those
    ``wanted``: only their aggregates are computed, and only their columns read.

    ``train`` is the cleaned sales frame before the cutoff with ``total_price``.
    Null customer keys are dropped (a pandas group-by drops them) but their rows
    still count for the reference date, which is the maximum over all train rows:
    it is taken from the aggregate itself (max of per-customer maxima). The
    aggregate (one row per customer) is then checkpointed, so the sales rows are read
    once and the reference date is a scan of the small table (a scalar subquery
    over the un-materialised plan would be re-planned and re-join the facts). Without
    recency there is no reference date and nothing to checkpoint.
    """
    agg = train.groupBy(KEY).agg(*_aggregates(weight, wanted=wanted))
    if "recency" not in wanted:
        return _finish(agg, None, wanted=wanted)
    agg = checkpointed(agg)
    return _finish(agg, agg.select(F.max("_last")).scalar(), wanted=wanted)


def rfm(train: DataFrame, weight: str | None = None) -> DataFrame:
    """O-36: recency, frequency, monetary and average order value."""
    return customer_features(train, weight, ("recency", "frequency", "monetary", "avg_order_value"))


def realized_value(test: DataFrame, weight: str | None = None) -> DataFrame:
    """O-40: spend per customer on/after the cutoff (a sum of nothing is 0)."""
    return (
        test.where(F.col(KEY).isNotNull())
        .groupBy(KEY)
        .agg(F.coalesce(F.sum(money_sum("total_price", _w(weight))), F.lit(0)).cast("double").alias("actual_cltv"))
    )


def modeling_frame(sales: DataFrame, cutoff=DEFAULT_CUTOFF, weight: str | None = None) -> DataFrame:
    """O-41: features before the cutoff ⋈ realised value after it, ``actual_cltv > 0``,
    ``cltv_log = log1p(actual_cltv)``.

    Built in a single pass: one group-by over all cleaned rows with the train
    aggregates conditioned on ``ts < cutoff`` and the realised value on
    ``ts >= cutoff``. The inner join of the source becomes the two filters
    ``frequency > 0`` and ``actual_cltv > 0``; no second aggregation, no join shuffle.
    """
    c = _cutoff(cutoff)
    ts = F.col(TS)
    before, after = ts < c, ts >= c
    w = _w(weight)
    agg = checkpointed(
        sales.where(ts.isNotNull())
        .groupBy(KEY)
        .agg(*_aggregates(weight, before), F.sum(F.when(after, money_sum("total_price", w))).alias("_after"))
    )
    ref = agg.select(F.max("_last")).scalar()
    feats = _finish(agg, ref, extra=("_after",))
    # actual_cltv > 0 implies the customer has rows after the cutoff (inner join).
    return (
        feats.withColumn("actual_cltv", F.coalesce(F.col("_after"), F.lit(0)).cast("double"))
        .where(F.col("actual_cltv") > 0)
        .withColumn(LABEL, log_target("actual_cltv"))
        .drop("_after")
    )
