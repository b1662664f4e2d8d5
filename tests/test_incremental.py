"""States per period, sketches, stored buckets, quarantine and binned density."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlens.operators import assemble, features, incremental, profile
from spendlens.plans import pipeline
from spendlens.sources import colocated, tables
from spendlens.sources.fixtures import fixture_tables

from .conftest import SF_SMALL


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("weighted", [True, False])
def test_features_from_states(spark, tmp_path, weighted):
    t = fixture_tables(spark, SF_SMALL)
    sales = pipeline.cleaned_sales(t, weighted).checkpoint()
    weight, store = pipeline.weight_column(weighted), str(tmp_path / "state")
    incremental.update_features(sales, store, weight, until="1999-07-01")
    incremental.update_features(sales, store, weight, since="1999-07-01")
    for cutoff in ("1999-07-01", "2000-01-01", "2000-02-11"):
        train, test = features.cutoff_split(sales, cutoff)
        own = None if cutoff.endswith("-01") else sales.where(F.date_format(features.TS, "yyyy-MM") == cutoff[:7])
        got = incremental.features_at(spark, store, cutoff, own, weight)
        assert _rows(got) == _rows(features.customer_features(train, weight))
        spent = incremental.realized_from(spark, store, cutoff, own, weight)
        assert _rows(spent) == _rows(features.realized_value(test, weight))
    with pytest.raises(ValueError):
        incremental.features_at(spark, store, "2000-02-11", None, weight)
    # a period sent again is replaced, not added twice; older periods are not read
    incremental.update_features(sales.where("order_purchase_timestamp >= '2000-01-01'"), store, weight, since="2000-01-01", until="2000-02-01")
    train, _ = features.cutoff_split(sales, "2000-02-01")
    assert _rows(incremental.features_at(spark, store, "2000-02-01", None, weight)) == _rows(features.customer_features(train, weight))


def test_sketches_add_a_period_and_keep_their_bound(spark, tmp_path):
    rng = np.random.default_rng(4)
    n, store = 60_000, str(tmp_path / "sketches")
    a = np.concatenate([rng.lognormal(size=n // 2), rng.normal(50, 1, n // 2)])
    b = rng.integers(0, 20, n)
    month = rng.integers(1, 7, n)
    rows = [(f"2000-{m:02d}-1{i % 9}", float(x), int(y) if i % 3 else None) for i, (m, x, y) in enumerate(zip(month, a, b))]
    df = spark.createDataFrame(rows, "d string, a double, b int").withColumn("ts", F.col("d").cast("timestamp_ntz")).checkpoint()
    k, probs = 256, [0.0, 0.05, 0.25, 0.5, 0.75, 0.99, 1.0]
    incremental.update_sketches(df, ["a", "b"], store, "ts", until="2000-06-01", k=k)
    incremental.update_sketches(df.where("ts >= '2000-06-01'"), ["a", "b"], store, "ts", since="2000-06-01", k=k)
    slack = incremental.rank_error(k)
    assert 0.01 < slack < 0.02
    for where, keep in ((None, F.lit(True)), (F.col("period") >= "2000-03-01", F.col("ts") >= "2000-03-01")):
        found = incremental.sketched_quantiles(spark, store, probs, where)
        check = incremental.rank_check(df.where(keep), found, ["a", "b"], slack).collect()
        assert len(check) == 14 and all(r["within_bound"] for r in check)
    found = {(r["column_name"], r["p"]): r["q"] for r in incremental.sketched_quantiles(spark, store, [0.0, 1.0]).collect()}
    assert (found["a", 0.0], found["a", 1.0]) == (a.min(), a.max())
    exact = {r["column_name"]: r for r in profile.outlier_limits(df, ["a"]).collect()}["a"]
    limits = {r["column_name"]: r for r in incremental.sketched_limits(spark, store).collect()}["a"]
    lo, hi = np.quantile(a, [0.25 - slack, 0.25 + slack])
    assert lo <= limits["q1"] <= hi and abs(limits["iqr"] / exact["iqr"] - 1) < 0.05


def test_stored_buckets_join_without_exchange(spark, tmp_path):
    t = fixture_tables(spark, SF_SMALL)
    base = str(tmp_path / "facts")
    colocated.write_colocated(t, base, 6)
    for table in spark.catalog.listTables():  # as a new session would find the files
        if table.name.startswith("colocated_"):
            spark.sql(f"drop table {table.name}")
    facts = colocated.read_colocated(spark, base)
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for fanout in (True, False):
            got = colocated.denormalize_colocated(t, facts, fanout)
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(order_id" not in plan
            want = assemble.denormalize(t, fanout)
            assert "hashpartitioning(order_id" in want._jdf.queryExecution().executedPlan().toString()
            assert got.columns == want.columns and _rows(got) == _rows(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)


def test_quarantine(spark, tmp_path):
    empty = {n: spark.createDataFrame([], tables.SCHEMAS[n]) for n in tables.TABLE_NAMES}
    items = [("o1", 1, "p1", "s", None, 10.5, 1.0), ("o2", 2, "p2", None, None, None, 2.0)]
    empty["items"] = spark.createDataFrame(items, tables.SCHEMAS["items"])
    tables.write_tables(tables.Tables(**empty), str(tmp_path), "csv")
    folder = tmp_path / tables.CSV_FILES["items"]
    header = "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\n"
    (folder / "damaged.csv").write_text(
        header + "o3,3,p3,s,2018-01-01 00:00:00,5.0,1.0\no4,x,p4,s,2018-01-01 00:00:00,5.0,1.0\n"
        "o5,5,p5\no6,6,p6,s,2018-01-01 00:00:00,5.0,1.0,9,9\no7,7,p7,s,yesterday,5.0,1.0\n"
    )
    for n in tables.TABLE_NAMES:  # an empty frame may write no file
        (tmp_path / tables.CSV_FILES[n] / "none.csv").write_text(",".join(f.name for f in tables.SCHEMAS[n]) + "\n")
    good, bad, counts = tables.read_with_quarantine(spark, str(tmp_path))
    assert sorted(r["order_id"] for r in good.items.collect()) == ["o1", "o2", "o3"]
    assert sorted(r["order_id"] for r in good.items.select("order_id").collect()) == ["o1", "o2", "o3"]  # pruned columns too
    reasons = {r["record"][:2]: (r["table_name"], r["file_name"], r["reason"]) for r in bad.collect()}
    assert reasons == {
        "o4": ("items", "damaged.csv", "order_item_id is no int"),
        "o5": ("items", "damaged.csv", "fewer than 7 fields"),
        "o6": ("items", "damaged.csv", "more than 7 fields"),
        "o7": ("items", "damaged.csv", "shipping_limit_date is no timestamp_ntz"),
    }
    by_file = {r["file_name"]: r for r in counts.where("table_name = 'items' and n_rows > 0").collect()}
    assert (by_file["damaged.csv"]["n_good"], by_file["damaged.csv"]["n_bad"]) == (1, 4)
    assert sum(r["n_rows"] for r in by_file.values()) == 7 and all(r["n_rows"] == r["n_good"] + r["n_bad"] for r in by_file.values())
    assert good.customers.count() == 0


def test_binned_density_stays_within_its_bound(spark):
    rng = np.random.default_rng(9)
    rows = [(float(x), float(y) if i % 5 else None, int(w)) for i, (x, y, w) in enumerate(zip(rng.lognormal(size=4000), rng.normal(size=4000), rng.integers(1, 4, 4000)))]
    df = spark.createDataFrame(rows, "a double, b double, w long").withColumn("c", F.lit(1.0)).repartition(4)
    for weight in (None, "w"):
        exact = {(r["column_name"], r["point"]): r["density"] for r in profile.kde_curve(df, ["a", "b"], digits=12, weight=weight).collect()}
        for cells in (256, 4096):
            got = profile.binned_density(df, ["a", "b", "c"], weight=weight, cells=cells).collect()
            assert len(got) == len(exact) == 400
            worst = max(abs(r["density"] - exact[r["column_name"], r["point"]]) / r["error_bound"] for r in got)
            assert worst < 1
            peak = {c: max(d for (x, _), d in exact.items() if x == c) for c in "ab"}
            if cells == 4096:
                assert all(r["error_bound"] < 0.01 * peak[r["column_name"]] for r in got)
    assert profile.binned_density(df.where("a is null"), ["a"]).collect() == []
