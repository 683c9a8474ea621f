import math

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from panelweave.operators import metrics, models, search


@pytest.fixture(scope="module")
def rows(spark):
    """120 rows with two informative predictors and one that is noise."""
    rng = np.random.default_rng(11)
    x = rng.uniform(0, 10, size=(120, 3))
    y = 50 + 3 * x[:, 0] - 2 * x[:, 1] + np.where(x[:, 0] > 5, 20, 0) + rng.normal(size=120)
    data = [(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "k bigint, a double, b double, c double, y double").coalesce(1)
    df = df.persist()
    df.count()
    return df


PREDICTORS = ["a", "b", "c"]


def split(rows):
    return rows.where("k % 4 > 0"), rows.where("k % 4 = 0")


def rmse(df, prediction="prediction"):
    return metrics.regression_metrics(df, "y", prediction).collect()[0]["rmse"]


def test_exact_line(spark):
    df = spark.createDataFrame([(float(x), 2.0 * x + 1) for x in range(10)], "x double, y double")
    model = models.linear_regression(["x"], "y", regParam=0.0).fit(df)
    report = {(r["measure"], r["name"]): r["value"] for r in models.linear_report(spark, model).collect()}
    assert report["coefficient", "x"] == pytest.approx(2.0)
    assert report["intercept", None] == pytest.approx(1.0)
    assert report["train_r2", None] == pytest.approx(1.0)
    assert report["train_rmse", None] == pytest.approx(0.0, abs=1e-9)


def test_least_squares_equals_numpy(rows):
    train, test = split(rows)
    model = models.linear_regression(PREDICTORS, "y", regParam=0.0).fit(train)
    data = np.array([[r[c] for c in (*PREDICTORS, "y")] for r in train.collect()])
    design = np.column_stack([data[:, :3], np.ones(len(data))])
    wanted = np.linalg.lstsq(design, data[:, 3], rcond=None)[0]
    assert list(model.stages[-1].coefficients) == pytest.approx(list(wanted[:3]))
    assert model.stages[-1].intercept == pytest.approx(wanted[3])


def test_linear_settings_are_the_published_ones(rows):
    linear = models.linear_regression(PREDICTORS, "y").fit(rows).stages[-1]
    assert [linear.getOrDefault(p) for p in ("maxIter", "regParam", "elasticNetParam")] == [100, 0.3, 0.8]


def test_report_rows(spark, rows):
    model = models.linear_regression(PREDICTORS, "y").fit(rows)
    report = models.linear_report(spark, model).collect()
    measures = [r["measure"] for r in report]
    assert measures[:3] == ["coefficient"] * 3 and "objective" in measures
    summary = model.stages[-1].summary
    assert {r["measure"]: r["value"] for r in report}["iterations"] == summary.totalIterations
    scored = model.transform(rows)
    assert {r["measure"]: r["value"] for r in report}["train_rmse"] == pytest.approx(rmse(scored))


def test_metrics_equal_the_evaluator(rows):
    train, test = split(rows)
    scored = models.decision_tree(PREDICTORS, "y").fit(train).transform(test)
    row = metrics.regression_metrics(scored, "y").collect()[0]
    for name in ("rmse", "r2"):
        wanted = RegressionEvaluator(labelCol="y", metricName=name).evaluate(scored)
        assert row[name] == pytest.approx(wanted)


def test_feature_vector_order_and_missing_values(spark):
    df = spark.createDataFrame([("k", 1.0, 2.0, 9.0)], "k string, a double, b double, y double")
    table = models.feature_vector(df, ["b", "a"], "y", "k")
    assert table.columns == ["k", "features", "y"]
    assert list(table.collect()[0]["features"]) == [2.0, 1.0]
    missing = spark.createDataFrame([("k", None, 2.0, 9.0)], df.schema)
    with pytest.raises(Exception, match="null"):
        models.feature_vector(missing, ["b", "a"], "y", "k").collect()


def test_models_chain_without_a_join(rows):
    train, test = split(rows)
    linear = models.linear_regression(PREDICTORS, "y", "LR_prediction").fit(train)
    tree = models.decision_tree(PREDICTORS, "y", "DT_prediction").fit(train)
    scored = models.predict(test, linear, tree)
    assert {"k", "LR_prediction", "DT_prediction", "features"} <= set(scored.columns)
    assert "Join" not in scored._jdf.queryExecution().optimizedPlan().toString()
    alone = {r["k"]: r["DT_prediction"] for r in tree.transform(test).collect()}
    assert {r["k"]: r["DT_prediction"] for r in scored.collect()} == alone


def test_trees_beat_the_line_on_a_step(rows):
    train, test = split(rows)
    line = rmse(models.linear_regression(PREDICTORS, "y").fit(train).transform(test))
    boosted = rmse(models.boosted_trees(PREDICTORS, "y").fit(train).transform(test))
    forest = rmse(models.random_forest(PREDICTORS, "y", maxDepth=8).fit(train).transform(test))
    assert boosted < line and forest < line


def test_parameter_report(spark, rows):
    tree = models.decision_tree(PREDICTORS, "y", maxDepth=7).fit(rows)
    report = {r["param"]: r for r in models.parameter_report(spark, {"DT": tree}).collect()}
    assert set(report) == set(models.TREE_PARAMS)
    assert report["maxDepth"]["value"] == "7" and report["maxDepth"]["doc"]
    assert report["maxBins"]["value"] == "32" and report["minInstancesPerNode"]["value"] == "1"


# --- grids ---


def test_grid_points_and_table_agree(spark):
    grid = {"maxDepth": [1, 2], "stepSize": [0.1, 0.2, 0.3]}
    points = search.grid_points(grid)
    assert len(points) == 6 and points[1] == {"maxDepth": 1, "stepSize": 0.2}
    table = search.grid_table(spark, grid)
    assert sorted(tuple(r) for r in table.collect()) == sorted(tuple(p.values()) for p in points)


def test_full_grid_sizes():
    assert len(search.grid_points(search.TREE_GRID_FULL)) == 27
    assert len(search.grid_points(search.BOOSTED_GRID_FULL)) == 729


def test_random_points_are_distinct_and_repeatable():
    points = search.sample_points(search.BOOSTED_GRID_FULL, 100, seed=1)
    assert len({tuple(p.items()) for p in points}) == 100
    assert points == search.sample_points(search.BOOSTED_GRID_FULL, 100, seed=1)
    assert points != search.sample_points(search.BOOSTED_GRID_FULL, 100, seed=2)
    every = search.grid_points(search.BOOSTED_GRID_FULL)
    assert all(p in every for p in points)
    assert search.sample_points(search.TREE_GRID_FULL, 100) == search.grid_points(search.TREE_GRID_FULL)


# --- sweeps ---


def test_sweep_scores_each_point_and_keeps_the_best(rows):
    train, test = split(rows)
    plan = models.decision_tree(PREDICTORS, "y")
    points = search.grid_points({"maxDepth": [1, 4], "minInstancesPerNode": [1, 30]})
    found = search.sweep(plan, train, test, points)
    table = {(r["maxDepth"], r["minInstancesPerNode"]): r["rmse"] for r in found.table.collect()}
    for point in points:
        alone = models.decision_tree(PREDICTORS, "y", **point).fit(train).transform(test)
        assert table[tuple(point.values())] == pytest.approx(rmse(alone))
    assert table[tuple(found.best.values())] == min(table.values())
    assert rmse(found.model.transform(test)) == pytest.approx(min(table.values()))


@pytest.mark.parametrize("metric", ["rmse", "r2"])
def test_boosting_shares_a_fit_between_iteration_counts(rows, metric, monkeypatch):
    train, test = split(rows)
    plan = models.boosted_trees(PREDICTORS, "y", subsamplingRate=0.8, seed=5)
    points = search.grid_points({"maxDepth": [2, 3], "maxIter": [2, 4, 7]})
    fits = []
    fit = search._fit
    monkeypatch.setattr(search, "_fit", lambda *a: fits.append(a[2]) or fit(*a))
    found = search.sweep(plan, train, test, points, metric=metric)
    assert len(fits) <= 3  # one per depth, one more if the best has fewer iterations
    for r in found.table.collect():
        alone = models.boosted_trees(
            PREDICTORS, "y", subsamplingRate=0.8, seed=5, maxDepth=r["maxDepth"], maxIter=r["maxIter"]
        ).fit(train).transform(test)
        assert r[metric] == pytest.approx(metrics.regression_metrics(alone, "y").collect()[0][metric])


def test_sweep_takes_mixed_numbers_and_unpersists(spark, rows):
    train, test = split(rows)
    plan = models.boosted_trees(PREDICTORS, "y", maxIter=2, maxDepth=2)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    found = search.sweep(plan, train, test, [{"stepSize": 1}, {"stepSize": 0.5}])
    assert dict(found.table.dtypes) == {
        "stepSize": "double",
        "rmse": "double",
        "best": "boolean",
    }
    assert [r["best"] for r in found.table.collect()].count(True) == 1
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_sweep_of_any_estimator(rows):
    train, test = split(rows)
    plan = models.linear_regression(PREDICTORS, "y")
    found = search.sweep(plan, train, test, search.grid_points({"regParam": [0.0, 50.0]}), metric="r2")
    assert found.best == {"regParam": 0.0}


def test_undefined_scores_raise(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "x double, y double")
    with pytest.raises(ValueError, match="undefined|rmse or r2"):
        search.sweep(models.linear_regression(["x"], "y"), df, df, [{"regParam": 0.0}], metric="mae")


# --- folds and cross-validation ---


@pytest.mark.parametrize("n, folds", [(9, 3), (10, 3), (11, 3), (7, 2)])
def test_folds_are_contiguous_blocks(spark, n, folds):
    df = spark.range(n).select((F.col("id") * 7 % n if math.gcd(7, n) == 1 else F.col("id")).alias("k"))
    found = [r["fold"] for r in sorted(search.kfold_blocks(df, "k", folds).collect())]
    wanted = [f for f, block in enumerate(np.array_split(np.arange(n), folds)) for _ in block]
    assert found == wanted


def test_hash_folds_are_even_and_repeatable(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    found = {r["k"]: r["fold"] for r in search.kfold_hash(df, "k", 3).collect()}
    assert found == {r["k"]: r["fold"] for r in search.kfold_hash(df.repartition(5), "k", 3).collect()}
    sizes = [list(found.values()).count(f) for f in range(3)]
    assert sum(sizes) == 3000 and min(sizes) > 900


def test_too_few_rows_for_the_folds(spark):
    with pytest.raises(ValueError, match="cannot make"):
        search.kfold_blocks(spark.range(2).withColumnRenamed("id", "k"), "k", 3)


def test_cross_validation_scores_held_out_folds(rows):
    placed = search.kfold_blocks(rows, "k", 3)
    plan = models.linear_regression(PREDICTORS, "y")
    found = search.cross_validate(plan, placed, [{"regParam": 0.0}, {"regParam": 20.0}])
    for r in found.table.collect():
        scores = []
        for f in range(3):
            model = models.linear_regression(PREDICTORS, "y", regParam=r["regParam"]).fit(placed.where(F.col("fold") != f))
            held_out = model.transform(placed.where(F.col("fold") == f))
            scores.append(metrics.regression_metrics(held_out, "y").collect()[0]["r2"])
        assert [r[f"r2_fold{f}"] for f in range(3)] == pytest.approx(scores)
        assert r["mean_r2"] == pytest.approx(sum(scores) / 3)
    assert found.best == {"regParam": 0.0}
    whole = models.linear_regression(PREDICTORS, "y", regParam=0.0).fit(rows)
    assert list(found.model.stages[-1].coefficients) == pytest.approx(list(whole.stages[-1].coefficients))


def test_forest_search_modes(rows):
    plan = models.random_forest(PREDICTORS, "y", numTrees=2, maxDepth=3)
    plain = search.forest_search(plan, rows, "k")
    assert plain.stages[-1].getNumTrees == 2
    grid = {"maxDepth": [1, 2, 3]}
    assert search.forest_search(plan, rows, "k", grid, search="Grid").table.count() == 3
    drawn = search.forest_search(plan, rows, "k", grid, search="Random", n_iter=2, assign=search.kfold_hash)
    assert drawn.table.count() == 2 and set(drawn.best) == {"maxDepth"}


def test_seeded_forest_repeats_on_a_fixed_layout(rows):
    plan = models.random_forest(PREDICTORS, "y", numTrees=3, maxDepth=4)
    scores = []
    for parts in (2, 5):
        train = models.repeatable(rows.repartition(parts), "k", 3)
        scores.append([r["prediction"] for r in plan.fit(train).transform(rows).orderBy("k").collect()])
    assert scores[0] == pytest.approx(scores[1])


def test_sweep_leaves_a_persisted_input_persisted(rows):
    train, test = split(rows)
    columns = [*PREDICTORS, "y"]
    mine = train.select(*columns).persist()
    search.sweep(models.linear_regression(PREDICTORS, "y"), mine, test, [{"regParam": 0.0}])
    assert mine.storageLevel.useMemory
    mine.unpersist()


def dotted(rows):
    names = {"a": "AG.LND", "b": "SP POP", "c": "NY`GDP", "y": "EN.ATM", "k": "row.key"}
    return rows.withColumnsRenamed(names)


@pytest.mark.parametrize(
    "make", [models.linear_regression, models.decision_tree, models.boosted_trees, models.random_forest]
)
def test_names_with_dots_fit_as_plain_ones_do(rows, make):
    train, test = split(rows)
    plain = make(PREDICTORS, "y").fit(train).transform(test)
    model = make(["AG.LND", "SP POP", "NY`GDP"], "EN.ATM").fit(dotted(train))
    scored = models.predict(dotted(test).drop("EN.ATM"), model)
    expected = {r["k"]: r["prediction"] for r in plain.collect()}
    assert {r["row.key"]: r["prediction"] for r in scored.collect()} == pytest.approx(expected)


def test_names_with_dots_in_reports_and_feature_tables(spark, rows):
    df = dotted(rows)
    model = models.linear_regression(["AG.LND", "SP POP"], "EN.ATM").fit(df)
    report = models.linear_report(spark, model).where("measure = 'coefficient'").collect()
    assert [r["name"] for r in report] == ["AG.LND", "SP POP"]
    table = models.feature_vector(df, ["NY`GDP"], "EN.ATM", "row.key")
    assert table.columns == ["row.key", "features", "EN.ATM"]
    assert models.repeatable(df, "row.key", 3).count() == 120


def test_names_with_dots_in_searches(rows):
    features, points = ["AG.LND", "SP POP", "NY`GDP"], search.grid_points({"maxDepth": [1, 3]})
    train, test = split(rows)
    plain = search.sweep(models.decision_tree(PREDICTORS, "y"), train, test, points)
    plan = models.decision_tree(features, "EN.ATM")
    found = search.sweep(plan, dotted(train), dotted(test), points)
    assert found.table.collect() == plain.table.collect()
    boosted = models.boosted_trees(features, "EN.ATM", maxDepth=2)
    steps = search.grid_points({"maxIter": [1, 3]})
    shared = search.sweep(boosted, dotted(train), dotted(test), steps).table.collect()
    assert shared[1]["rmse"] < shared[0]["rmse"]
    for assign in (search.kfold_blocks, search.kfold_hash):
        grid = {"maxDepth": [1, 3], "numTrees": [1]}
        plain = search.forest_search(
            models.random_forest(PREDICTORS, "y", bootstrap=False), rows, "k", grid, assign=assign
        )
        found = search.forest_search(
            models.random_forest(features, "EN.ATM", bootstrap=False),
            dotted(rows),
            "row.key",
            grid,
            assign=assign,
        )
        assert found.best == plain.best
        for a, b in zip(found.table.collect(), plain.table.collect()):
            assert list(a) == pytest.approx(list(b))


def test_a_stored_model_scores_alike(spark, rows, tmp_path):
    dotted = rows.withColumnRenamed("y", "the.label")
    for make in (models.linear_regression, models.decision_tree, models.boosted_trees):
        plan = make(PREDICTORS, "the.label", "guess")
        model = plan.fit(dotted)
        models.save_model(model, str(tmp_path / "m"), "the.label")
        loaded = models.load_model(spark, str(tmp_path / "m"))
        assert (loaded.label, loaded.prediction, loaded.features) == ("the.label", "guess", PREDICTORS)
        unlabelled = dotted.drop("the.label")
        assert loaded.score(unlabelled).select("k", "guess").collect() == model.transform(unlabelled).select("k", "guess").collect()
        with pytest.raises(ValueError, match="no such columns"):
            loaded.score(dotted.drop("b"))


def test_a_stored_plan_fits_alike(spark, rows, tmp_path):
    dotted = rows.withColumnRenamed("y", "the.label")
    plan = models.decision_tree(PREDICTORS, "the.label", maxDepth=3)
    models.save_plan(plan, str(tmp_path / "p"))
    loaded = models.load_plan(spark, str(tmp_path / "p"))
    assert loaded.label == "the.label"
    assert loaded.fit(dotted).transform(dotted).select("prediction").collect() == plan.fit(dotted).transform(dotted).select("prediction").collect()


@pytest.mark.parametrize("make", [models.decision_tree, models.random_forest])
def test_how_deep_trees_are_grown_changes_no_tree(rows, make):
    plain = {"cacheNodeIds": False, "maxMemoryInMB": 256}
    ours = make(PREDICTORS, "y", maxDepth=12).fit(rows)
    spark_s = make(PREDICTORS, "y", maxDepth=12, **plain).fit(rows)
    assert ours.stages[-1].toDebugString.split("\n")[1:] == spark_s.stages[-1].toDebugString.split("\n")[1:]


def test_depths_of_a_sweep_share_a_fit(rows, monkeypatch):
    train, test = split(rows)
    plan = models.decision_tree(PREDICTORS, "y")
    points = search.grid_points({"maxDepth": [0, 1, 3, 4, 9, 30], "minInstancesPerNode": [1, 4]})
    fit, fitted = search._fit, []

    def counted(plan, train, point):
        fitted.append(point)
        return fit(plan, train, point)

    monkeypatch.setattr(search, "_fit", counted)
    found = search.sweep(plan, train, test, points)
    assert len([p for p in fitted if p != found.best]) <= 2 and len(fitted) <= 3
    each = [rmse(fit(plan, train, point).transform(test)) for point in points]
    assert [r["rmse"] for r in found.table.collect()] == pytest.approx(each, rel=1e-12)
    assert rmse(found.model.transform(test)) == pytest.approx(min(each))
