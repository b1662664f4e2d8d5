"""Semantic unit tests on tiny literal frames (null handling, day arithmetic,
quantiles, histogram edges, folds, ranking, k-NN imputation)."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spendlens.functions.scalars import elapsed_days
from spendlens.operators import clean, features, folds, impute, profile, quantiles, rank
from spendlens.operators.assemble import _with_categories


def _ts(s):
    return dt.datetime.fromisoformat(s)


def _sales(spark, rows):
    schema = (
        "customer_unique_id bigint, order_purchase_timestamp timestamp_ntz, order_item_id int, price double, "
        "product_category_name_english string, payment_rows bigint"
    )
    df = spark.createDataFrame(rows, schema)
    return clean.with_total_price(df)


def test_elapsed_days_is_floor_of_duration(spark):
    df = spark.createDataFrame([(_ts("2024-01-01 23:00:00"), _ts("2024-01-02 01:00:00"))], "a timestamp_ntz, b timestamp_ntz")
    r = df.select(elapsed_days("a", "b").alias("d"), F.datediff("b", "a").alias("cal")).first()
    assert r["d"] == 0 and r["cal"] == 1


def test_features_null_key_and_single_row(spark):
    rows = [
        (1, _ts("2017-01-01 10:00:00"), 1, 10.0, "A", 1),
        (1, _ts("2017-01-05 09:00:00"), 2, None, "B", 2),
        (2, _ts("2017-02-01 00:00:00"), 1, 5.0, None, 1),
        (None, _ts("2017-03-01 00:00:00"), 1, 1.0, "A", 1),  # latest row, null key
    ]
    out = {r["customer_unique_id"]: r for r in features.customer_features(_sales(spark, rows), "payment_rows").collect()}
    assert set(out) == {1, 2}  # null key dropped
    c1, c2 = out[1], out[2]
    # reference date comes from the null-key row (2017-03-01)
    assert c1["recency"] == (dt.datetime(2017, 3, 1) - dt.datetime(2017, 1, 5, 9)).days
    assert c1["frequency"] == 2
    assert c1["monetary"] == 10.0  # null price contributes nothing
    assert c1["total_items"] == 3  # weights: 1 + 2
    assert c1["avg_item_price"] == 10.0
    assert c1["category_count"] == 2
    assert c1["tenure_days"] == 3
    assert c1["purchase_interval"] == 3 / 2  # 3 fan-out rows
    assert c1["is_repeat_customer"] == 1
    assert c2["purchase_interval"] == 0.0 and c2["is_repeat_customer"] == 0 and c2["category_count"] == 0


def test_weighted_equals_fanout(spark):
    rows = [
        (1, _ts("2017-01-01 10:00:00"), 1, 10.0, "A", 3),
        (1, _ts("2017-01-02 10:00:00"), 2, 4.5, "B", 1),
        (2, _ts("2017-01-03 00:00:00"), 1, None, "C", 2),
    ]
    weighted = features.customer_features(_sales(spark, rows), "payment_rows")
    expanded = [r for r in rows for _ in range(r[5])]
    literal = features.customer_features(_sales(spark, [(*r[:5], 1) for r in expanded]))
    assert sorted(weighted.collect()) == sorted(literal.collect())


def test_null_safe_category_join(spark):
    prods = spark.createDataFrame([(1, "x"), (2, None)], "product_id int, product_category_name string")
    cats = spark.createDataFrame([("x", "X"), (None, "NONE")], "product_category_name string, product_category_name_english string")
    got = {r["product_id"]: r["product_category_name_english"] for r in _with_categories(prods, cats).collect()}
    assert got == {1: "X", 2: "NONE"}


def test_winsorize_keeps_nulls_and_caps(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    out = [r["x"] for r in clean.winsorize(df, ["x"]).collect()]
    s = pd.Series([v for v in vals if v is not None])
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    up = q3 + 1.5 * (q3 - q1)
    assert None in out
    assert max(v for v in out if v is not None) == up


@pytest.mark.parametrize("seed", [0, 1])
def test_quantiles_match_numpy_with_hot_values(spark, seed):
    rng = np.random.default_rng(seed)
    a = np.concatenate([rng.normal(size=300), np.full(400, 0.25), rng.integers(0, 5, 50).astype(float)])
    df = spark.createDataFrame([(float(v), "k" if i % 3 else "j") for i, v in enumerate(a)], "x double, g string")
    probs = [0.0, 0.05, 0.2, 0.25, 0.5, 0.75, 0.8, 0.95, 0.99, 1.0]
    got = {r["p"]: r["q"] for r in quantiles.column_quantiles(df, ["x"], probs).collect()}
    for p in probs:
        assert got[p] == np.quantile(a, p)  # bit-identical linear interpolation
    long = df.select("g", F.col("x").alias("value"))
    per = {(r["g"], r["p"]): r["q"] for r in quantiles.quantiles(long, [0.5], keys=["g"]).collect()}
    for g in ("j", "k"):
        sub = np.array([v for i, v in enumerate(a) if (i % 3 == 0) == (g == "j")])
        assert per[(g, 0.5)] == np.quantile(sub, 0.5)


def test_outlier_defaults(spark):
    assert profile.CAP_QUANTILES == (0.25, 0.75) and profile.CHECK_QUANTILES == (0.20, 0.80)
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 1000]], "x double")
    r = profile.outlier_check(df, ["x"]).first()
    assert r["has_outlier"] and r["n_outliers"] == 1


def test_histogram_right_edge_and_constant(spark):
    df = spark.createDataFrame([(0.0, 5.0), (0.5, 5.0), (3.0, 5.0)], "x double, c double")
    h = {(r["column_name"], r["bin"]): r["count"] for r in profile.histogram(df, ["x", "c"], bins=3).collect()}
    assert h[("x", 0)] == 2 and h[("x", 2)] == 1  # max lands in the last bin
    assert h[("c", 1)] == 3  # constant column: range widened by 0.5, value in the middle bin


def test_kfold_contiguous_is_ntile(spark):
    n, k = 23, 3
    df = spark.range(n).withColumnRenamed("id", "customer_unique_id").repartition(5)
    got = {r["customer_unique_id"]: r["fold"] for r in folds.kfold_contiguous(df, k=k).collect()}
    sizes = [n // k + (1 if i < n % k else 0) for i in range(k)]
    want, start = {}, 0
    for f, s in enumerate(sizes, 1):
        for i in range(start, start + s):
            want[i] = f
        start += s
    assert got == want


def test_split_and_folds_are_stable(spark):
    df = spark.range(2000).withColumnRenamed("id", "customer_unique_id")
    a = folds.train_test_split(df.repartition(7)).groupBy("split").count().collect()
    b = folds.train_test_split(df.repartition(3)).groupBy("split").count().collect()
    assert sorted(a) == sorted(b)
    share = {r["split"]: r["count"] for r in a}["test"] / 2000
    assert 0.15 < share < 0.25
    f = folds.kfold_assign(df).groupBy("fold").count().collect()
    assert sorted(r["fold"] for r in f) == [0, 1, 2, 3, 4]


def test_top_n_per_group_matches_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 500), "customer_unique_id": np.arange(500), "s": rng.integers(0, 20, 500)})
    df = spark.createDataFrame(pdf)
    got = {(r["g"], r["customer_unique_id"]) for r in rank.top_n_per_group(df, ["g"], "s", 7, salts=4).collect()}
    want = set()
    for g, part in pdf.groupby("g"):
        best = part.sort_values(["s", "customer_unique_id"], ascending=[False, True]).head(7)
        want |= {(g, i) for i in best["customer_unique_id"]}
    assert got == want


def _knn_reference(x: np.ndarray, k: int) -> np.ndarray:
    """Brute-force k-NN imputation (nan-Euclidean, uniform weights; ties by value)."""
    n, m = x.shape
    out = x.copy()
    means = np.nanmean(x, axis=0)
    for i in range(n):
        for c in range(m):
            if not np.isnan(x[i, c]):
                continue
            cands = []
            for j in range(n):
                if np.isnan(x[j, c]):
                    continue
                common = ~np.isnan(x[i]) & ~np.isnan(x[j])
                p = common.sum()
                if p == 0:
                    continue
                ss = 0.0
                for d in range(m):
                    if common[d]:
                        ss += (x[i, d] - x[j, d]) * (x[i, d] - x[j, d])
                dist = math.sqrt(float(m) / p * ss)
                key = tuple((0, 0.0) if np.isnan(v) else (1, v) for v in x[j])
                cands.append((dist, key, x[j, c]))
            if not cands:
                out[i, c] = means[c]
                continue
            cands.sort(key=lambda t: (t[0], t[1]))
            vals = [t[2] for t in cands[:k]]
            out[i, c] = sum(vals) / len(vals)
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_knn_matches_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    n, m = 60, 4
    x = rng.integers(0, 6, size=(n, m)).astype(float)  # many exact ties
    x[rng.random((n, m)) < 0.2] = np.nan
    x[0] = np.nan  # a row with nothing present -> column means
    x[1] = [np.nan, 1.0, np.nan, np.nan]
    want = _knn_reference(x, 5)
    cols = [f"c{j}" for j in range(m)]
    rows = [(i, *[None if np.isnan(v) else float(v) for v in x[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "rid int, " + ", ".join(f"{c} double" for c in cols))
    got = impute.knn_impute(df, cols).orderBy("rid").toPandas()[cols].to_numpy()
    assert np.allclose(got, want, atol=1e-9)


@pytest.mark.parametrize("leaf", [1, 7, 64])
def test_knn_search_visits_few_leaves_and_is_exact(spark, leaf, monkeypatch):
    """Small leaves, sliced leaves, ties and weights, against all distances."""
    monkeypatch.setattr(impute, "SLICE", 20)
    rng = np.random.default_rng(leaf)
    a = np.round(np.concatenate([rng.normal(size=(300, 3)), rng.normal(size=(60, 3)) * 0.01, np.zeros((5, 3))]), 2)
    a[rng.random(a.shape) < 0.15] = np.nan
    weight = rng.integers(1, 4, len(a))
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], int(w)) for i, (r, w) in enumerate(zip(a, weight))]
    df = spark.createDataFrame(rows, "rid int, a double, b double, c double, w long").repartition(3)
    got = impute.knn_impute(df, ["a", "b", "c"], weight="w", leaf=leaf).orderBy("rid").toPandas()[["a", "b", "c"]].to_numpy()
    for i, r in enumerate(a):
        for j in np.flatnonzero(np.isnan(r)):
            both = ~np.isnan(a) & ~np.isnan(r)
            n = both.sum(axis=1)
            dist = np.sqrt(3.0 / np.maximum(n, 1) * np.where(both, (a - r) ** 2, 0.0).sum(axis=1))
            ok = np.flatnonzero((n > 0) & ~np.isnan(a[:, j]))
            if not len(ok):
                want = np.average(a[~np.isnan(a[:, j]), j], weights=weight[~np.isnan(a[:, j])])
            else:
                ties = np.where(np.isnan(a), -np.inf, a)
                ok = ok[np.lexsort((ties[ok, 2], ties[ok, 1], ties[ok, 0], dist[ok]))]
                want = np.repeat(a[ok, j], weight[ok])[:5].mean()
            assert abs(got[i, j] - want) < 1e-9, (i, j)


def test_median_tree_balances_and_bounds_hold():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(900, 2)), np.full((100, 2), 3.0)])
    splits = impute.median_tree(x, 4)
    at = impute.tree_leaves(x, splits, 4)
    assert at.min() >= 0 and at.max() < 16 and np.bincount(at).max() <= 200
    rows = []
    for n in np.unique(at):
        part = x[at == n]
        rows.append({"leaf": n, "_pat": 3, "weight": len(part), **{f"lo{j}": part[:, j].min() for j in (0, 1)}, **{f"hi{j}": part[:, j].max() for j in (0, 1)}})
    leaves = impute._Leaves(rows, 2, 5)
    q = rng.normal(size=(50, 2)) * 2
    q[::5, 1] = np.nan
    least, most = leaves.bounds(q, 0)
    within, visited = leaves.limit(most), 0
    for i, r in enumerate(q):
        both = ~np.isnan(r)
        dist = np.sqrt(2 / both.sum() * ((x[:, both] - r[both]) ** 2).sum(axis=1))
        for n, row in enumerate(rows):
            d = dist[at == row["leaf"]]
            assert least[i, n] - 1e-12 <= d.min() and d.max() <= most[i, n] + 1e-12
        assert np.sort(dist)[4] <= within[i] + 1e-12
        visited += (least[i] <= np.sort(dist)[4]).sum()
    assert visited / 50 < 5


def test_knn_fewer_donors_than_k(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, None), (3.0, 5.0)], "a double, b double")
    got = [r["b"] for r in impute.knn_impute(df, ["a", "b"]).collect()]
    assert sorted(got) == [1.0, 3.0, 5.0]  # mean of the two donors


@pytest.mark.parametrize("max_targets", [quantiles.MAX_TARGETS, 0])
def test_quantiles_per_key_match_numpy(spark, max_targets):
    """Radix selection, and range sorting when the wanted ranks are too many to send."""
    rng = np.random.default_rng(7)
    a = np.concatenate([rng.normal(size=2000).round(2), np.full(1500, 1.5), rng.integers(0, 20, 500).astype(float)])
    rows = [(float(v), "k" if i % 3 else "j", i % 2) for i, v in enumerate(a)]
    df = spark.createDataFrame(rows, "value double, g string, h int").repartition(5)
    probs = [0.0, 0.25, 0.6, 0.75, 1.0]
    found = quantiles.quantiles(df, probs, keys=["g", "h"], max_targets=max_targets).collect()
    got = {(r["g"], r["h"], r["p"]): r["q"] for r in found}
    assert len(got) == 20
    for g, h, p in got:
        assert got[g, h, p] == np.quantile([v for v, x, y in rows if (x, y) == (g, h)], p)


def test_order_bits():
    a = np.array([-np.inf, -1e300, -2.5, -2.5 + 1e-15, -5e-324, 0.0, 5e-324, 1e-300, 1.0, np.nextafter(1, 2), 1e308, np.inf])
    bits = quantiles.order_bits(a)
    assert (bits[1:] > bits[:-1]).all()
    assert (quantiles.from_order_bits(bits) == a).all()
    assert quantiles.order_bits(np.array([-0.0])) == quantiles.order_bits(np.array([0.0]))
    assert quantiles.order_bits(np.array([np.nan])) > bits[-1] and np.isnan(quantiles.from_order_bits(quantiles.order_bits(np.array([-np.nan])))[0])


def test_quantiles_of_odd_values(spark):
    rng = np.random.default_rng(3)
    a = np.concatenate([rng.normal(size=500) * 10.0 ** rng.integers(-300, 300, 500), [0.0, -0.0, 5e-324, -5e-324] * 3, np.full(300, -7.25)])
    rows = [(None if i % 17 == 0 else float(v), None if i % 4 == 0 else i % 4, i % 5) for i, v in enumerate(a)]
    df = spark.createDataFrame(rows, "value double, g int, w long").repartition(4)
    probs = [0.01, 0.3, 0.5, 0.99]
    got = {(r["g"], r["p"]): r["q"] for r in quantiles.quantiles(df, probs, keys=["g"], weight="w").collect()}
    assert {g for g, _ in got} == {None, 1, 2, 3}  # a null key is a key
    for (g, p), q in got.items():
        assert q == np.quantile(np.repeat(*zip(*[(v, w) for v, x, w in rows if x == g and v is not None])), p)
    assert quantiles.quantiles(df.where("value is null"), probs, keys=["g"]).collect() == []
    none = quantiles.column_quantiles(df.where("value is null"), ["value", "g"], [0.5]).collect()
    assert [(r["column_name"], r["q"]) for r in none] == [("g", 2.0)]
    whole = quantiles.quantiles(df, [0.5], weight="w").collect()
    assert whole[0]["q"] == np.quantile(np.repeat(*zip(*[(v, w) for v, _, w in rows if v is not None])), 0.5)


def test_boxplot_moves_no_value(spark):
    """A hot group: what is exchanged is counts and per-group sums, never the values."""
    rng = np.random.default_rng(1)
    a = np.concatenate([rng.normal(size=3000), rng.normal(size=60) * 50]).round(3)
    rows = [("hot" if i % 10 else ["x", None][i // 10 % 2], float(v)) for i, v in enumerate(a)]
    df = spark.createDataFrame(rows, "customer_state string, freight_value double").repartition(6)
    box = profile.boxplot_stats(df)
    got = {r["customer_state"]: r for r in box.collect()}
    for g in ("hot", "x", None):
        v = np.array([x for s, x in rows if s == g])
        q1, q2, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        r = got[g]
        assert (r["q1"], r["median"], r["q3"]) == (q1, q2, q3)
        assert (r["whisker_low"], r["whisker_high"], r["n"], r["n_fliers"]) == (inside.min(), inside.max(), len(v), len(v) - len(inside))
    plan = box._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():  # the join side of the values is not exchanged before its aggregate
        if "Exchange hashpartitioning" in line:
            assert "freight_value" not in line and "value#" not in line.split("hashpartitioning")[1]
