"""Row and column cleaning: O-05, O-07, O-09, O-10, O-20, O-21.

Every operator is a narrow transformation (no shuffle) except where limits are
computed first (O-20 takes them from ``profile.outlier_limits``: one aggregate, one
row, joined back as a broadcast of a proven single row).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import line_total
from . import profile

# Fixed values of the source pipeline: the columns whose nulls drop a row, in the
# order it applies them (first the purchase time, later product text fields, the
# English category and the approval time).
PURCHASE_TS = "order_purchase_timestamp"
ROW_DROP_COLUMNS = (
    "order_purchase_timestamp",
    "product_name_lenght",
    "product_description_lenght",
    "product_photos_qty",
    "product_category_name_english",
    "order_approved_at",
)
DELIVERY_DATE_COLUMNS = ("order_delivered_carrier_date", "order_delivered_customer_date")
IMPUTE_COLUMNS = ("product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """O-05."""
    return df.drop(*cols)


def with_total_price(df: DataFrame, price: str = "price", multiplier: str = "order_item_id") -> DataFrame:
    """O-07: ``total_price = price * order_item_id`` (null price -> null)."""
    return df.withColumn("total_price", line_total(price, multiplier))


def null_rows(df: DataFrame, column: str, n: int | None = 5, order_by: Sequence[str] = ()) -> DataFrame:
    """O-09: rows where ``column`` is null; first ``n`` in ``order_by`` order when given
    (Spark rows have no inherent order, so a preview needs a key)."""
    out = df.where(F.col(column).isNull())
    if n is not None:
        if order_by:
            out = out.orderBy(*order_by)
        out = out.limit(n)
    return out


def drop_null_rows(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """O-10: drop rows with a null in any of ``subset``. Expressed as a filter so
    Catalyst pushes each ``isNotNull`` through the joins to the scans."""
    cond: Column = F.lit(True)
    for c in subset:
        cond = cond & F.col(c).isNotNull()
    return df.where(cond)


def source_row_drops(df: DataFrame) -> DataFrame:
    """All row drops of the source pipeline (the only cleaning that reaches the
    customer features)."""
    return drop_null_rows(df, ROW_DROP_COLUMNS)


def winsorize(
    df: DataFrame,
    columns: Sequence[str],
    lower_q: float = 0.25,
    upper_q: float = 0.75,
    exact: bool = True,
    weight: str | None = None,
) -> DataFrame:
    """O-20: cap each column at its IQR limits: below low -> low, above up -> up,
    null stays null (``least/greatest`` would turn null into a limit). ``weight`` names a
    column of row multiplicities that the limits count.

    All limits come from one aggregate (one row) that is cross-referenced as a
    scalar, so no join and no per-column pass is needed.
    """
    if not columns:
        return df
    limits = profile.outlier_limits(df, columns, lower_q, upper_q, exact=exact, wide=True, weight=weight)
    # One scalar subquery (a struct of all limits), reused by every reference.
    s = limits.select(F.struct(*[F.col(c) for c in limits.columns])).scalar()
    out = []
    for name in df.columns:
        if name in columns:
            low, up = s[f"{name}__low"], s[f"{name}__up"]
            v = F.col(name)
            out.append(F.when(v < low, low).when(v > up, up).otherwise(v).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def fill_delivery_dates(df: DataFrame, columns: Sequence[str] = DELIVERY_DATE_COLUMNS) -> DataFrame:
    """O-21: the source writes integer 0 into null delivery timestamps. A Spark
    column has one type, so the timestamp stays null, ``<col>_missing`` flags the
    fill, and ``<col>_filled`` carries the literal form (timestamp text or '0')."""
    out = df
    for c in columns:
        out = out.withColumn(f"{c}_missing", F.col(c).isNull().cast("int")).withColumn(
            f"{c}_filled",
            F.coalesce(F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss"), F.lit("0")),
        )
    return out
