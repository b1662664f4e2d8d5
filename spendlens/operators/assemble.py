"""O-13..16: join the six tables into one sales frame.

Join order is authored for scale (Catalyst does not reorder joins without
statistics): orders meet customers first (the smaller fact table shuffles on
``customer_id``), then payments and items join on ``order_id`` so both big tables
shuffle once on the same key and the two sort-merge joins share one partitioning.
Products and categories are dimension tables, joined to each other first; whether
the result is broadcast is left to Spark's size checks (static plan statistics, then the measured size under AQE),
with a sort-merge join beyond the threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Tables

CUSTOMER_COLS = ("customer_id", "customer_unique_id", "customer_state")


def _order_side(t: Tables) -> DataFrame:
    return t.orders.join(t.customers, "customer_id")


def _with_categories(df: DataFrame, categories: DataFrame) -> DataFrame:
    """O-16: left join on a nullable key. pandas matches a null key with a null key;
    SQL equality does not, hence ``<=>``."""
    cat = categories.withColumnRenamed("product_category_name", "_cat_key")
    joined = df.join(cat, df["product_category_name"].eqNullSafe(cat["_cat_key"]), "left")
    return joined.drop("_cat_key")


def _products(t: Tables) -> DataFrame:
    """Products with their translation: the two dimension tables meet first, so the
    left join runs on the small side and the fact rows join once. Same rows as
    joining the translation after the inner product join."""
    return _with_categories(t.products, t.categories)


def _ordered(df: DataFrame, t: Tables, payment_cols: bool) -> DataFrame:
    """Column order of the source's chained merges: customers, orders, payments,
    items, products, translation."""
    first = [c for c in t.customers.columns]
    seen = set(first)
    order = list(first)
    parts = [t.orders] + ([t.payments] if payment_cols else []) + [t.items, t.products, t.categories]
    for part in parts:
        for c in part.columns:
            if c not in seen and c in df.columns:
                seen.add(c)
                order.append(c)
    order += [c for c in df.columns if c not in seen]
    return df.select(*order)


def denormalize(t: Tables, payment_fanout: bool = True, facts: dict[str, DataFrame] | None = None) -> DataFrame:
    """O-13..16: customers ⋈ orders ⋈ payments ⋈ items ⋈ products ⟕ categories.

    ``payment_fanout=True`` reproduces the source: an order with p payment rows and
    i items yields p·i rows. ``False`` keeps orders that have a payment (semi-join)
    without multiplying rows and without payment columns. ``facts`` may give orders (with
    their customers), payments and items as stored in buckets of the order id.
    """
    facts = facts or {"orders": _order_side(t), "payments": t.payments, "items": t.items}
    base, payments = facts["orders"], facts["payments"]
    if payment_fanout:
        base = base.join(payments, "order_id")
    else:
        base = base.join(payments.select("order_id"), "order_id", "left_semi")
    df = base.join(facts["items"], "order_id").join(_products(t), "product_id")
    return _ordered(df, t, payment_fanout)


def product_sales(t: Tables) -> DataFrame:
    """Products that occur in the fan-out frame, with ``sales_rows`` = how many of its
    rows carry them (one translation row per category). Payments and items are counted
    before they meet the products, with partial aggregation in every task, so a
    best-selling product is one row per task."""
    pay = t.payments.groupBy("order_id").agg(F.count(F.lit(1)).alias("payment_rows"))
    orders = _order_side(t).select("order_id").join(pay, "order_id")
    sold = orders.join(t.items.select("order_id", "product_id"), "order_id")
    counts = sold.groupBy("product_id").agg(F.sum("payment_rows").alias("sales_rows"))
    return t.products.join(counts, "product_id")


def weighted_sales(t: Tables) -> DataFrame:
    """The fan-out frame in compact form: one row per (order, item) with
    ``payment_rows`` = how many copies of that row the source's join produces.

    Payments are reduced to a count per order before the join (map-side partial
    aggregation), so the fan-out is never materialised; every sum or count over the
    fan-out rows equals the weighted sum over these rows.
    """
    pay = t.payments.groupBy("order_id").agg(F.count(F.lit(1)).alias("payment_rows"))
    df = _order_side(t).join(pay, "order_id").join(t.items, "order_id").join(_products(t), "product_id")
    return _ordered(df, t, True)
