"""Sources (CSV round trip, fixture views) and a sample of registered queries
against their DuckDB oracle on the smallest fixture."""

import os
import tempfile

import pytest

import __spark_entry__ as E
from spendlens.plans import catalog
from spendlens.sources import tables as TB
from spendlens.sources.fixtures import FIXTURE_SQL, fixture_tables
from tools.check_oracle import duck, rows_of

from .conftest import SF_SMALL


def test_fixture_views_equal_sql(spark):
    con = duck(SF_SMALL)
    t = fixture_tables(spark, SF_SMALL).as_dict()
    names = dict(zip(["customers", "orders", "payments", "items", "products", "categories"], FIXTURE_SQL))
    for name, view in names.items():
        sdf = t[name].toPandas()
        ddf = con.sql(FIXTURE_SQL[view]).df()
        assert sorted(sdf.columns) == sorted(ddf.columns), name
        assert rows_of(sdf) == rows_of(ddf), name


def test_csv_round_trip_with_declared_schema(spark):
    t = fixture_tables(spark, SF_SMALL)
    cast = {}
    for name, df in t.as_dict().items():
        schema = TB.SCHEMAS[name]
        cols = []
        for f in schema.fields:
            if f.name in df.columns:
                cols.append(df[f.name].cast(f.dataType).alias(f.name))
            else:
                cols.append(__import__("pyspark.sql.functions", fromlist=["lit"]).lit(None).cast(f.dataType).alias(f.name))
        cast[name] = df.select(*cols)
    out = tempfile.mkdtemp(prefix="spendlens-csv-")
    TB.write_tables(TB.Tables(**cast), out, fmt="csv")
    back = TB.read_tables(spark, out, fmt="csv")
    for name, df in back.as_dict().items():
        assert df.schema == TB.SCHEMAS[name]
        assert df.count() == cast[name].count()
        assert df.exceptAll(cast[name]).count() == 0


ORACLE_SAMPLE = [
    "scan_tables",
    "denormalized",
    "payment_fanout",
    "customer_features",
    "modeling_frame",
    "top_customers",
    "outlier_check",
    "quantile_profile",
    "histogram",
    "boxplot_stats",
    "kfold_contiguous",
    "top_n_overlap_by_fold",
    "regression_metrics",
]


@pytest.mark.parametrize("name", ORACLE_SAMPLE)
def test_query_matches_oracle(spark, name):
    con = duck(SF_SMALL)
    sdf = E.queries()[name](spark, SF_SMALL).toPandas()
    ddf = con.sql(E.oracle_sql()[name]).df()
    assert sorted(sdf.columns) == sorted(ddf.columns)
    assert len(sdf) == len(ddf)
    assert rows_of(sdf) == rows_of(ddf)


def test_every_query_has_a_check():
    assert set(E.oracle_sql()) <= set(E.queries())
    # model fitting and attribution are checked by invariants (test_explain, test_models);
    # queries added by other modules bring their own tests
    assert set(catalog.QUERIES) - set(catalog.ORACLE) <= {
        "fit_linear", "fit_forest", "fit_boosted", "fit_boosted_deep", "score_customers", "model_comparison",
        "cv_rmse", "grid_search", "out_of_fold", "out_of_fold_overlap", "shap_values", "shap_importance",
        "shap_dependence", "tuned_top_customers", "minimal_pipeline",
    }
