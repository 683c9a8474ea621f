"""Trees that try every split: against brute force, and the queries that use them."""

import numpy as np
import pytest

import __spark_entry__ as contract
from panelweave.functions.storage import scratch_path
from panelweave.operators import models

FEATURES = ["a", "b"]


def brute_split(x, y, least=1):
    """``(gain, feature, threshold)`` of the best split, over all midpoints."""
    best = (0.0, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for threshold in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= threshold
            if min(low.sum(), (~low).sum()) < least:
                continue
            gain = y.var() * len(y) - y[low].var() * low.sum() - y[~low].var() * (~low).sum()
            if gain > best[0] + 1e-9:
                best = (gain, f, threshold)
    return best


def brute_tree(x, y, points, depth, least=1):
    """Predictions for ``points`` of a tree grown by :func:`brute_split`."""
    gain, f, threshold = brute_split(x, y, least) if depth else (0.0, None, None)
    if f is None:
        return np.full(len(points), y.mean())
    low, there = x[:, f] <= threshold, points[:, f] <= threshold
    out = np.empty(len(points))
    out[there] = brute_tree(x[low], y[low], points[there], depth - 1, least)
    out[~there] = brute_tree(x[~low], y[~low], points[~there], depth - 1, least)
    return out


@pytest.fixture(scope="module")
def table(spark):
    """500 rows; few of them stand beyond a step that lies between two quantiles."""
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=500), rng.integers(0, 200, size=500).astype(float)
    y = np.where(a > np.sort(a)[-6], 100.0, 0.0) + np.where(b > 183, 7.0, 0.0) + rng.normal(size=500)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, y)], "a double, b double, y double")
    return df.persist(), np.column_stack([a, b]), y


def predictions(model, df):
    return np.array([r["prediction"] for r in model.transform(df).select("prediction").collect()])


@pytest.mark.parametrize("depth, least", [(0, 1), (1, 1), (2, 1), (3, 1), (3, 20)])
def test_tree_equals_brute_force(table, depth, least):
    df, x, y = table
    plan = models.decision_tree(FEATURES, "y", exact=True, maxDepth=depth, minInstancesPerNode=least)
    assert predictions(plan.fit(df), df) == pytest.approx(brute_tree(x, y, x, depth, least))


def test_quantile_candidates_miss_the_split(table):
    df, x, y = table
    wanted = brute_tree(x, y, x, 1)
    binned = models.decision_tree(FEATURES, "y", maxDepth=1).fit(df)
    assert np.abs(predictions(binned, df) - wanted).max() > 1


def test_boosting_equals_brute_force_and_is_stored(spark, table):
    df, x, y = table
    plan = models.boosted_trees(FEATURES, "y", exact=True, maxDepth=1, maxIter=3, stepSize=0.5)
    model = plan.fit(df)
    wanted = brute_tree(x, y, x, 1)
    errors = [np.mean((wanted - y) ** 2)]
    for _ in range(2):
        wanted = wanted + 0.5 * brute_tree(x, 2 * (y - wanted), x, 1)
        errors.append(np.mean((wanted - y) ** 2))
    assert predictions(model, df) == pytest.approx(wanted)
    features = model.stages[0].transform(df)
    assert model.stages[-1].evaluateEachIteration(features, "squared") == pytest.approx(errors)
    path = scratch_path(spark, "exact")
    models.save_model(model, path, "y")
    assert predictions(models.load_model(spark, path).model, df) == pytest.approx(wanted)


def test_awkward_rows(spark):
    schema = "a double, b double, y double"
    plan = models.decision_tree(FEATURES, "y", exact=True, maxDepth=3)
    # Neighbours without a number between them are still told apart.
    close = spark.createDataFrame([(1.0, 0.0, 1.0), (float(np.nextafter(1.0, 2.0)), 0.0, 2.0)], schema)
    assert sorted(predictions(plan.fit(close), close)) == [1.0, 2.0]
    same = spark.createDataFrame([(1.0, 2.0, 3.0)] * 4, schema)
    assert list(predictions(plan.fit(same), same)) == [3.0] * 4
    with pytest.raises(ValueError, match="no rows"):
        plan.fit(same.limit(0))
    with pytest.raises(Exception, match="label is missing"):
        plan.fit(spark.createDataFrame([(1.0, 2.0, None)], schema))
    with pytest.raises(ValueError, match="maxDepth"):
        models.decision_tree(FEATURES, "y", exact=True, maxDepth=11).fit(same)


WHOLE = [
    "dtree_splits",
    "dtree_sweep_depths",
    "gbt_sweep_stumps",
    "model_residuals_unlike",
    "model_compare_unlike",
    "study_from_files",
]


@pytest.mark.parametrize("name", WHOLE)
def test_checks_search_all_values(name):
    assert "_band" not in contract.oracle_sql()[name]
