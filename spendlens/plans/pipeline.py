"""End-to-end compositions of the operators (the source's batch script and its
minimal pipeline), each a ``DataFrame -> DataFrame`` plan that Catalyst optimises
as a whole."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assemble, clean, explain, features, folds, model, rank
from ..session import checkpointed
from ..sources.tables import Tables


def cleaned_sales(t: Tables, weighted: bool = True) -> DataFrame:
    """Joined sales rows after the source's row drops, with ``total_price``.

    ``weighted=True`` keeps one row per (order, item) with ``payment_rows`` as its
    multiplicity; ``False`` materialises the payment fan-out like the source.
    Winsorising and k-NN imputation act on product size columns that no feature
    reads, so they are not part of this plan (same features, far cheaper).
    """
    base = assemble.weighted_sales(t) if weighted else assemble.denormalize(t, payment_fanout=True)
    return clean.with_total_price(clean.source_row_drops(base))


def profiled_sales(t: Tables) -> DataFrame:
    """The fan-out frame as the source profiles it: rows without a purchase time are
    dropped before any profile, limit, cap or imputation."""
    return clean.drop_null_rows(assemble.denormalize(t), ["order_purchase_timestamp"])


def product_sales(t: Tables) -> DataFrame:
    """The products of ``profiled_sales`` with ``sales_rows``, their number of rows there."""
    dated = clean.drop_null_rows(t.orders, ["order_purchase_timestamp"])
    return assemble.product_sales(replace(t, orders=dated))


def capped_products(t: Tables, columns: Sequence[str]) -> DataFrame:
    """``product_sales`` with ``columns`` capped at the limits of the sales frame.
    Product columns depend on the product only, so limits, caps and imputation run on
    one row per product and its count, not on every sales row."""
    return clean.winsorize(product_sales(t), columns, weight="sales_rows")


def sales_with_products(t: Tables, products: DataFrame) -> DataFrame:
    """``profiled_sales`` with the product table replaced (capped, imputed)."""
    return profiled_sales(replace(t, products=products))


def weight_column(weighted: bool) -> str | None:
    return "payment_rows" if weighted else None


def train_features(
    t: Tables, cutoff=features.DEFAULT_CUTOFF, weighted: bool = True, wanted: Sequence[str] = features.FEATURES
) -> DataFrame:
    sales = cleaned_sales(t, weighted)
    train, _ = features.cutoff_split(sales, cutoff)
    return features.customer_features(train, weight_column(weighted), wanted)


def modeling_frame(t: Tables, cutoff=features.DEFAULT_CUTOFF, weighted: bool = True) -> DataFrame:
    return features.modeling_frame(cleaned_sales(t, weighted), cutoff, weight_column(weighted))


def minimal_study(frame: DataFrame, preset: model.Preset, k: int = 5, top_n: int = rank.TOP_N) -> dict[str, DataFrame]:
    """The source's minimal pipeline after its features, in one call: RMSE of ``k`` shuffled
    folds (``cv``), the top-n overlap (``overlap``), attributions of every row
    (``shap_values``), their means (``importance``) and ten rows by key (``sample``). The
    folds' models and the one of all rows are fitted at the same time."""
    df = folds.kfold_assign(frame, k=k)
    parts = [df.where(F.col("fold") != i) for i in range(k)] + [frame]
    *fold_models, final = model.in_parallel(lambda rows: model.fit(rows, preset), parts)
    cv = None
    for i, m in enumerate(fold_models):
        row = model.holdout_metrics(m, df.where(F.col("fold") == i)).select(F.lit(i).alias("fold"), "rmse")
        cv = row if cv is None else cv.unionByName(row)
    scored = model.score(final, frame)
    shap = checkpointed(explain.shap_values(frame, final))
    return {
        "cv": cv,
        "overlap": rank.top_n_overlap(scored, "actual_cltv", "prediction", top_n, features.KEY),
        "shap_values": shap,
        "importance": explain.shap_importance(shap),
        "sample": model.score(final, frame.orderBy(features.KEY).limit(10)),
    }
