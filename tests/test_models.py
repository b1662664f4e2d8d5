"""Invariants of the model operators (their outputs have no SQL oracle)."""

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from spendlens.operators import folds, metrics, model, rank, tuning
from spendlens.operators.features import FEATURES, KEY, LABEL
from spendlens.plans import pipeline
from spendlens.sources.fixtures import TEST_CUTOFF, fixture_tables

from .conftest import SF_SMALL

QUICK = model.Preset("boosted", {"maxIter": 3, "maxDepth": 2})


def _frame(spark):
    return model.prepare(pipeline.modeling_frame(fixture_tables(spark, SF_SMALL), TEST_CUTOFF))


def test_linear_is_least_squares(spark):
    frame = _frame(spark)
    m = model.fit(frame, model.Preset("linear"))
    coef = {r["feature"]: r["coefficient"] for r in model.coefficients(spark, m).collect()}
    pdf = frame.toPandas()
    x = np.column_stack([pdf[list(FEATURES)].to_numpy(float), np.ones(len(pdf))])
    beta, *_ = np.linalg.lstsq(x, pdf[LABEL].to_numpy(float), rcond=None)
    fitted = x @ beta
    ours = x @ np.array([coef[f] for f in FEATURES] + [coef["intercept"]])
    assert np.allclose(ours, fitted, atol=1e-6)


def test_sql_metrics_equal_evaluator(spark):
    frame = _frame(spark)
    scored = model.score(model.fit(frame, QUICK), frame)
    ours = metrics.regression_metrics(scored).first()
    ev = RegressionEvaluator(labelCol=LABEL, predictionCol="prediction")
    assert abs(ours["rmse"] - ev.setMetricName("rmse").evaluate(scored)) < 1e-9
    assert abs(ours["r2"] - ev.setMetricName("r2").evaluate(scored)) < 1e-9


def test_out_of_fold_and_cv(spark):
    frame = _frame(spark)
    oof = model.out_of_fold(frame, QUICK, k=3)
    assert oof.count() == frame.count()
    assert oof.select(KEY).distinct().count() == frame.count()
    per_fold = rank.top_n_overlap_by_fold(oof, "actual_cltv", "pred_cltv", "fold", 10, KEY).collect()
    assert len(per_fold) == 3 and all(0 <= r["overlap"] <= 10 for r in per_fold)
    cv = model.cv_rmse(frame, QUICK, k=3).collect()
    assert len(cv) == 3 and abs(np.mean([r["rmse"] for r in cv]) - cv[0]["mean_rmse"]) < 1e-12


GRID = {"maxIter": [2, 4], "maxDepth": [1, 2], "subsamplingRate": [0.7, 1.0]}


def test_rounds_are_read_off_one_curve(spark):
    """A fit of fewer rounds has the error that the longer fit has after so many rounds."""
    df = folds.kfold_contiguous(_frame(spark), k=2).coalesce(1).checkpoint()  # sums in one order
    train, held = df.where("fold <> 1"), df.where("fold = 1")
    for rate in (0.7, 1.0):
        long = model.Preset("boosted", {"maxIter": 6, "maxDepth": 3, "subsamplingRate": rate})
        curve = tuning.held_out_curve(model.fit(train, long), long, held)
        assert len(curve) == 6
        for rounds in (1, 3, 6):
            short = model.Preset("boosted", {**long.params, "maxIter": rounds})
            alone = model.holdout_metrics(model.fit(train, short), held).first()["rmse"]
            assert abs(alone - curve[rounds - 1]) < 1e-9


def test_grid_is_carried_on(spark, tmp_path, monkeypatch):
    frame, store = _frame(spark), str(tmp_path / "fits")
    fits = []
    real = tuning.fit

    def counted(df, preset, *rest):
        fits.append(preset.params)
        if len(fits) == 4:
            raise RuntimeError("driver lost")
        return real(df, preset, *rest)

    monkeypatch.setattr(tuning, "fit", counted)
    with pytest.raises(RuntimeError):
        tuning.tune(frame, QUICK, store, GRID, k=3, parallelism=1)
    kept = tuning.finished(spark, store).count()
    assert kept == 3  # one parameter set with its three folds
    table = tuning.tuning_table(frame, QUICK, store, GRID, k=3)
    assert table.count() == 8 and table.where("mean_rmse is not null").count() == 2
    del fits[:]
    monkeypatch.setattr(tuning, "fit", lambda df, preset, *rest: fits.append(preset.params) or real(df, preset, *rest))
    assert tuning.tune(frame, QUICK, store, GRID, k=3, max_shapes=1) == 6
    assert tuning.tune(frame, QUICK, store, GRID, k=3) == 0
    assert len(fits) == 9 and all(p["maxIter"] == 4 for p in fits)  # 4 sets x 3 folds, 3 were kept
    rows = tuning.tuning_table(frame, QUICK, store, GRID, k=3).collect()
    assert [r["folds_done"] for r in rows] == [3] * 8
    best = [r for r in rows if r["is_best"]]
    assert len(best) == 1 and best[0]["mean_rmse"] == min(r["mean_rmse"] for r in rows)
    df = folds.kfold_contiguous(frame, k=3)
    for r in rows[:3]:
        params = {**QUICK.params, "maxIter": int(r["maxIter"]), "maxDepth": int(r["maxDepth"]), "subsamplingRate": float(r["subsamplingRate"])}
        each = [model.holdout_metrics(real(df.where(F.col("fold") != i), model.Preset("boosted", params)), df.where(F.col("fold") == i)).first()["rmse"] for i in (1, 2, 3)]
        assert abs(np.mean(each) / r["mean_rmse"] - 1) < 0.01  # ties between splits fall either way
    other = frame.limit(50)
    assert tuning.tuning_table(other, QUICK, store, GRID, k=3).where("folds_done > 0").count() == 0


def test_best_point_is_refitted(spark, tmp_path):
    frame = _frame(spark)
    grid = {"maxIter": [2, 3], "maxDepth": [1, 2]}
    table, best = tuning.grid_search(frame, QUICK, grid, k=3, store=str(tmp_path / "fits"))
    point = table.where("is_best").first()
    assert len(model.final_model(best).trees) == int(point["maxIter"])
    top = tuning.top_customers(best, frame, 20).orderBy("rank").collect()
    scored = sorted(model.score(best, frame).collect(), key=lambda r: (-r["predicted_cltv"], r[KEY]))[:20]
    real = {r[KEY] for r in sorted(frame.collect(), key=lambda r: (-r["actual_cltv"], r[KEY]))[:20]}
    assert [(r["rank"], r[KEY], r["in_realised_top"]) for r in top] == [(i + 1, r[KEY], r[KEY] in real) for i, r in enumerate(scored)]
    forest = model.Preset("forest", {"numTrees": 2})
    table, _ = tuning.grid_search(frame, forest, {"maxDepth": [1, 3]}, k=2, store=str(tmp_path / "forest"))
    assert table.where("mean_rmse is not null").count() == 2


def test_presets_run_whole(spark):
    """300 rounds of depth 7, on the fewest rows that fill such trees."""
    assert [model.PRESETS[n].params["maxIter"] for n in ("boosted", "boosted_deep")] == [300, 500]
    assert len(tuning.fit_shapes(model.PRESETS["boosted"], model.TUNING_GRID)) == 96
    assert len(tuning.grid_points(model.TUNING_GRID)) == 192
    rng = np.random.default_rng(0)
    rows = [(str(i), *map(float, v), float(np.sin(9 * v[0]) + v[1] * v[2])) for i, v in enumerate(rng.random((300, len(FEATURES))))]
    names = ", ".join(f"{f} double" for f in FEATURES)
    frame = spark.createDataFrame(rows, f"{KEY} string, {names}, {LABEL} double").coalesce(1).checkpoint()
    trees = model.final_model(model.fit(frame, model.PRESETS["boosted"])).trees
    assert len(trees) == 300 and max(t.depth for t in trees) == 7


def test_comparison_overlap_bounds(spark):
    frame = _frame(spark)
    presets = {"linear": model.Preset("linear"), "boosted": QUICK}
    rows = model.model_comparison(frame, presets, top_n=20).collect()
    assert {r["model"] for r in rows} == set(presets)
    assert all(0 <= r["top_n_overlap"] <= 20 for r in rows)
    split = folds.train_test_split(frame)
    assert split.where(F.col("split") == "test").count() + split.where(F.col("split") == "train").count() == frame.count()


def test_minimal_study(spark):
    frame = _frame(spark)
    study = pipeline.minimal_study(frame, QUICK, k=3, top_n=20)
    cv = {r["fold"]: r["rmse"] for r in study["cv"].collect()}
    want = {r["fold"]: r["rmse"] for r in model.cv_rmse(frame, QUICK, k=3).collect()}
    assert cv.keys() == want.keys() and all(abs(cv[i] / want[i] - 1) < 0.01 for i in cv)
    assert 0 <= study["overlap"].first()["overlap"] <= 20
    assert study["shap_values"].count() == frame.count() * len(FEATURES)
    assert study["importance"].count() == len(FEATURES)
    assert [r[KEY] for r in study["sample"].collect()] == sorted(r[KEY] for r in frame.select(KEY).collect())[:10]


def test_few_rows_have_few_partitions(spark):
    """However many partitions the session shuffles into."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = spark.range(100).select(F.col("id").cast("string").alias(KEY), *[F.rand(1).alias(f) for f in FEATURES])
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        frame = model.prepare(rows)
        assert frame.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism and frame.count() == 100
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_shorter_preset_shares_the_longer_fit(spark, monkeypatch):
    frame = _frame(spark).coalesce(1).checkpoint()  # sums in one order
    fits, real = [], model.fit
    monkeypatch.setattr(model, "fit", lambda df, preset, *rest: fits.append(preset) or real(df, preset, *rest))
    long = model.Preset("boosted", {**QUICK.params, "maxIter": 6})
    presets = {"long": long, "linear": model.Preset("linear"), "short": QUICK}
    rows = {r["model"]: r for r in model.model_comparison(frame, presets, top_n=20).collect()}
    assert list(rows) == list(presets) and len(fits) == 2 and QUICK not in fits
    split = folds.train_test_split(frame)
    for name in ("long", "short"):
        alone = real(split.where("split = 'train'"), presets[name])
        m = model.holdout_metrics(alone, split.where("split = 'test'")).first()
        assert abs(rows[name]["rmse"] - m["rmse"]) < 1e-9 and abs(rows[name]["r2"] - m["r2"]) < 1e-9
    cut = model.first_rounds(real(frame, long), 3)
    assert np.allclose(model.final_model(cut).featureImportances.toArray(), model.final_model(real(frame, QUICK)).featureImportances.toArray())


def test_first_point_is_refitted_beside_its_folds(spark, tmp_path, monkeypatch):
    frame, store = _frame(spark).coalesce(1).checkpoint(), str(tmp_path / "fits")
    fits, real = [], tuning.fit
    monkeypatch.setattr(tuning, "fit", lambda df, preset, *rest: fits.append(preset.params) or real(df, preset, *rest))
    best = tuning.tuned_model(frame, QUICK, store, GRID, k=3)
    point = tuning.tuning_table(frame, QUICK, store, GRID, k=3).where("is_best").first()
    assert len(fits) == 4 and all(p["maxIter"] == 4 for p in fits)  # three folds and all rows
    assert model.final_model(best).getNumTrees == int(point["maxIter"])
    params = {**QUICK.params, "maxIter": int(point["maxIter"]), "maxDepth": int(point["maxDepth"]), "subsamplingRate": float(point["subsamplingRate"])}
    alone = {r[KEY]: r["prediction"] for r in model.score(real(frame, model.Preset("boosted", params)), frame).collect()}
    assert all(abs(alone[r[KEY]] - r["prediction"]) < 1e-9 for r in model.score(best, frame).collect())
    del fits[:]
    tuning.tuned_model(frame, QUICK, store, GRID, k=3)
    assert len(fits) == 1  # a scored point is only refitted


def test_top_n_by_group_keeps_the_best_of_each_task(spark):
    rows = [(str(i), i % 3, float(i * 7919 % 1000) if i % 11 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "customer_unique_id string, g int, s double").repartition(4)
    best = rank.top_n_per_group(df, ["g"], "s", 15)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "_salt" not in plan  # the best of each task alone are exchanged
    order = lambda r: (r[2] is None, -(r[2] or 0.0), r[0])
    want = {(r[0], g, i + 1) for g in range(3) for i, r in enumerate(sorted((r for r in rows if r[1] == g), key=order)[:15])}
    assert {(r[0], r["g"], r["rank"]) for r in best.collect()} == want
    salted = rank.top_n_per_group(df, ["g"], "s", 15, salts=4)
    assert {(r[0], r["g"], r["rank"]) for r in salted.collect()} == want


def test_sample_of_the_minimal_study_is_scored_alone(spark):
    study = pipeline.minimal_study(_frame(spark), model.Preset("forest", {"numTrees": 2, "maxDepth": 2}), k=2, top_n=5)
    plan = study["sample"]._jdf.queryExecution().executedPlan().toString()
    assert plan.index("UDF(") < plan.index("TakeOrderedAndProject")  # the ten rows come first
    assert "UDF(" not in plan[plan.index("TakeOrderedAndProject") :]


def test_folds_are_fitted_on_few_partitions(spark, tmp_path, monkeypatch):
    """However many partitions the rows are sorted into for the contiguous folds."""
    frame = _frame(spark).coalesce(2).checkpoint()
    laid, real = [], tuning.fit
    monkeypatch.setattr(tuning, "fit", lambda df, *rest: laid.append((df.rdd.getNumPartitions(), df.count())) or real(df, *rest))
    monkeypatch.setattr(tuning.FO, "kfold_contiguous", lambda df, k, real=folds.kfold_contiguous: real(df, k=k).repartition(12, KEY))
    tuning.tune(frame, model.Preset("linear"), str(tmp_path / "fits"), {"regParam": [0.0]}, k=3)
    assert sorted(p for p, _ in laid) == [2, 2, 2] and sum(n for _, n in laid) == 2 * frame.count()
