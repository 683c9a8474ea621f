"""The SQL checks of sweeps, searches and comparisons turn red when a model is broken."""

import numpy as np
import pytest

import __spark_entry__ as contract
from checking import compare, connect
from panelweave.operators import models, search

SF_DIR = "/root/testdata/sf0.001"


def differences(spark, name):
    query, sql = contract.queries()[name], contract.oracle_sql()[name]
    return compare(spark, connect(SF_DIR), query, sql, SF_DIR)


@pytest.mark.parametrize(
    "name",
    ["dtree_sweep_depths", "gbt_sweep_stumps", "grid_search_depths", "random_search_depths"],
)
def test_ignored_parameters_are_seen(spark, monkeypatch, name):
    monkeypatch.setattr(search, "_fit", lambda plan, train, point: plan.fit(train))
    assert differences(spark, name)


@pytest.mark.parametrize("name", ["dtree_sweep_depths", "grid_search_depths"])
def test_swapped_points_are_seen(spark, monkeypatch, name):
    fit = search._fit
    swapped = {1: 2, 2: 1, 0: 30, 30: 0}
    monkeypatch.setattr(
        search, "_fit", lambda plan, train, p: fit(plan, train, {"maxDepth": swapped[p["maxDepth"]]})
    )
    assert differences(spark, name)


@pytest.mark.parametrize(
    "name", ["model_residuals_unlike", "model_compare_unlike", "study_from_files"]
)
def test_a_tree_in_place_of_boosting_is_seen(spark, monkeypatch, name):
    def one_tree(features, label, prediction, maxIter, **settings):
        return models.decision_tree(features, label, prediction, **settings)

    monkeypatch.setattr(models, "boosted_trees", one_tree)
    assert differences(spark, name)


def test_a_forest_predicts_the_mean_of_its_trees(spark):
    rng = np.random.default_rng(5)
    data = [(float(x), float(y), float(x * y + e)) for x, y, e in rng.normal(size=(60, 3))]
    df = spark.createDataFrame(data, "x double, z double, y double").coalesce(1)
    model = models.random_forest(["x", "z"], "y", numTrees=4, maxDepth=4).fit(df)
    rows = model.transform(df).collect()
    trees = model.stages[-1].trees
    each = np.array([[tree.predict(r["features"]) for tree in trees] for r in rows])
    assert np.allclose(each.mean(1), [r["prediction"] for r in rows])
    assert np.abs(each - each[:, :1]).max() > 0.1  # bootstrap samples make the trees differ
