"""Parameter sweeps, cross-validated searches and fold assignment."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import (
    DecisionTreeRegressionModel,
    DecisionTreeRegressor,
    GBTRegressor,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.functions.expressions import named, reference
from panelweave.functions.storage import scratch_dir, scratch_path
from panelweave.operators.exact_trees import ExactBoosting
from panelweave.operators.fit_pool import FitPool
from panelweave.operators.models import PanelPipeline
from panelweave.operators.ranking import ordinal_index

# The grids of the sweeps, first the full ones, then those in use.
TREE_GRID_FULL = {"maxDepth": [10, 20, 30], "maxBins": [32, 34, 36], "minInstancesPerNode": [1, 2, 3]}
TREE_GRID = {"maxDepth": [20], "maxBins": [36], "minInstancesPerNode": [1]}
BOOSTED_GRID_FULL = {
    **TREE_GRID_FULL,
    "maxIter": [20, 25, 30],
    "stepSize": [0.05, 0.1, 0.2],
    "subsamplingRate": [0.4, 0.8, 1.0],
}
BOOSTED_GRID = {
    "maxDepth": [5],
    "maxBins": [32],
    "minInstancesPerNode": [1],
    "maxIter": [20],
    "stepSize": [0.1],
    "subsamplingRate": [1.0],
}

Point = dict[str, object]


@dataclass
class Search:
    """Scores per grid point as a table, and the best point fitted."""

    table: DataFrame
    best: Point
    model: PipelineModel


def grid_points(grid: Mapping[str, Sequence]) -> list[Point]:
    """Every combination, the last parameter varying fastest."""
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def sample_points(grid: Mapping[str, Sequence], n: int = 100, seed: int = 42) -> list[Point]:
    """``n`` different combinations at random; a grid no larger than that is taken whole."""
    total = math.prod(len(values) for values in grid.values())
    if total <= n:
        return grid_points(grid)
    points = []
    for index in sorted(random.Random(seed).sample(range(total), n)):
        point = {}
        for name in reversed(list(grid)):
            index, at = divmod(index, len(grid[name]))
            point[name] = grid[name][at]
        points.append({name: point[name] for name in grid})
    return points


def grid_table(spark: SparkSession, grid: Mapping[str, Sequence]) -> DataFrame:
    """The combinations as a table, one column per parameter."""
    table = spark.range(1).select()
    for name, values in grid.items():
        table = table.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return table


def only(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The table with just these columns, in this order."""
    return df if df.columns == list(columns) else df.select(*columns)


@contextmanager
def kept(*tables: DataFrame) -> Iterator[None]:
    """Hold tables in memory or on disk meanwhile, but for those already held."""
    held = [df for df in tables if df.storageLevel == StorageLevel.NONE]
    for df in held:
        df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield
    finally:
        for df in held:
            df.unpersist()


def _fit(plan: Pipeline, train: DataFrame, point: Point) -> PipelineModel:
    estimator = plan.getStages()[-1]
    return plan.fit(train, {estimator.getParam(name): value for name, value in point.items()})


def _grown_by(plan: Pipeline) -> str | None:
    """The parameter with which a model grows: a larger value's model contains the smaller one's.

    Boosting adds trees one by one, and a tree is split level by level.
    """
    estimator = plan.getStages()[-1]
    if isinstance(estimator, (GBTRegressor, ExactBoosting)):
        return "maxIter"
    return "maxDepth" if isinstance(estimator, DecisionTreeRegressor) else None


def _jobs(plan: Pipeline, points: Sequence[Point]) -> list[list[Point]]:
    """Points that one fit can score together: those that differ in how far the model grows alone."""
    grown = _grown_by(plan)
    if grown is None:
        return [[point] for point in points]
    shared: dict[tuple, list[Point]] = {}
    for point in points:
        rest = tuple((name, value) for name, value in point.items() if name != grown)
        shared.setdefault(rest, []).append(point)
    return list(shared.values())


def _reach(plan: Pipeline, point: Point) -> int:
    """How far the point's model grows."""
    grown = _grown_by(plan)
    return point.get(grown, plan.getStages()[-1].getOrDefault(grown))


def _cut_predictions(
    spark: SparkSession, tree: DecisionTreeRegressionModel, depths: Sequence[int]
) -> DataFrame:
    """``(leaf, at0, at1, ...)``: what the tree, cut off at each depth, predicts where a leaf is.

    That is the prediction of the leaf's forebear at that depth, read from the stored
    tree. The driver holds the tree's nodes, as it does when it grows them.
    """
    path = scratch_path(spark, "tree")
    tree.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    nodes = nodes.select("id", "prediction", "leftChild", "rightChild").toPandas().sort_values("id")
    low, high = nodes["leftChild"].to_numpy(), nodes["rightChild"].to_numpy()
    shown = [nodes["prediction"].to_numpy(copy=True) for _ in depths]
    level, parents = 0, np.flatnonzero(low[:1] >= 0)
    while len(parents):
        for depth, values in zip(depths, shown):
            if level >= depth:
                values[low[parents]] = values[high[parents]] = values[parents]
        children = np.concatenate([low[parents], high[parents]])
        level, parents = level + 1, children[low[children] >= 0]
    # Nodes are numbered with the left branch before the right one, and so are leaves.
    leaves = np.flatnonzero(low < 0)
    rows = zip(range(len(leaves)), *(values[leaves].tolist() for values in shown))
    fields = ", ".join(f"at{i} double" for i in range(len(depths)))
    return spark.createDataFrame([(float(leaf), *row) for leaf, *row in rows], f"leaf double, {fields}")


def _errors_by_depth(
    plan: Pipeline, model: PipelineModel, test: DataFrame, depths: Sequence[int]
) -> list[float]:
    """The mean squared error of the tree as it is, for the largest depth, and cut off at the others."""
    estimator, tree = plan.getStages()[-1], model.stages[-1]
    label, prediction = F.col(estimator.getLabelCol()), F.col(estimator.getPredictionCol())
    cuts = sorted(set(depths) - {max(depths)})
    features = PipelineModel(model.stages[:-1]).transform(test)
    scored = tree.transform(features, {tree.leafCol: "leaf"}).select(
        "leaf", label.alias("y"), prediction.alias("whole")
    )
    if cuts:
        scored = scored.join(_cut_predictions(test.sparkSession, tree, cuts), "leaf")
    column = {depth: f"at{i}" for i, depth in enumerate(cuts)} | {max(depths): "whole"}
    squares = [F.avg(F.pow(F.col(column[d]) - F.col("y"), F.lit(2.0))).alias(f"e{i}") for i, d in enumerate(depths)]
    return [math.nan if e is None else e for e in scored.agg(*squares).head()]


def _score_job(
    plan: Pipeline, train: DataFrame, test: DataFrame, job: list[Point], metric: str
) -> tuple[list[float], PipelineModel]:
    """Fit once and score every point of the job on ``test``."""
    estimator = plan.getStages()[-1]
    label = estimator.getLabelCol()
    if len(job) == 1:
        model = _fit(plan, train, job[0])
        evaluator = RegressionEvaluator(
            labelCol=label, predictionCol=estimator.getPredictionCol(), metricName=metric
        )
        return [evaluator.evaluate(model.transform(test))], model
    reach = [_reach(plan, point) for point in job]
    model = _fit(plan, train, job[reach.index(max(reach))])
    if _grown_by(plan) == "maxDepth":
        errors = _errors_by_depth(plan, model, test, reach)
    else:
        features = PipelineModel(model.stages[:-1]).transform(test)
        squared = model.stages[-1].evaluateEachIteration(features, "squared")
        errors = [squared[n - 1] for n in reach]
    if metric == "rmse":
        return [math.sqrt(e) for e in errors], model
    spread = test.agg(F.var_pop(label)).head()[0]
    return [1 - e / spread if spread else float("nan") for e in errors], model


def _rank(score: float, metric: str) -> float:
    """Smaller is better; an undefined score is worst.

    Nine digits count: sums over tasks differ in the last ones from run to run, and
    points that are equal but for those are ties, which go to the earlier point.
    """
    if math.isnan(score):
        return math.inf
    score = float(f"{score:.9g}")
    return score if metric == "rmse" else -score


def _check_metric(metric: str) -> None:
    if metric not in ("rmse", "r2"):
        raise ValueError("metric must be rmse or r2")


def _inputs(plan: Pipeline) -> list[str]:
    return [*plan.getStages()[0].getInputCols(), plan.getStages()[-1].getLabelCol()]


def prepared(plan: Pipeline, df: DataFrame, *more: str) -> DataFrame:
    """Just the columns that a fit reads, and any more by their exact names."""
    df = plan.labelled(df) if isinstance(plan, PanelPipeline) else df
    return only(df, list(dict.fromkeys([*_inputs(plan), *map(reference, more)])))


def _scores(
    plan: Pipeline,
    train: DataFrame,
    test: DataFrame,
    points: Sequence[Point],
    metric: str,
    parallelism: int,
    pool: FitPool | None,
) -> tuple[list[float], int, PipelineModel | None]:
    """One score per point, the best point's index, and its model if a fit ended there.

    Fits run side by side, each a distributed job; only the best model so far
    is kept. One that fails stops the others.
    """
    _check_metric(metric)
    scratch_dir(train.sparkSession)  # boosting cuts its lineage there
    train, test = prepared(plan, train), prepared(plan, test)
    index = {id(point): i for i, point in enumerate(points)}
    jobs = _jobs(plan, points)
    scores = [math.nan] * len(points)
    best, best_model = (math.inf, len(points)), None
    with kept(train, test):

        def score(job: list[Point]) -> tuple[list[Point], list[float], PipelineModel]:
            return job, *_score_job(plan, train, test, job, metric)

        with nullcontext(pool) if pool else FitPool(train.sparkSession, parallelism) as fits:
            for job, found, model in fits.run(score, jobs):
                longest = max(_reach(plan, p) for p in job) if len(job) > 1 else None
                for point, score in zip(job, found):
                    at = index[id(point)]
                    scores[at] = score
                    if (_rank(score, metric), at) < best:
                        best = (_rank(score, metric), at)
                        whole = longest is None or _reach(plan, point) == longest
                        best_model = model if whole else None
    if math.isinf(best[0]):
        raise ValueError(f"{metric} is undefined at every grid point")
    return scores, best[1], best_model


def _result_table(
    spark: SparkSession, points: Sequence[Point], scores: Mapping[str, Sequence[float]], best: int
) -> DataFrame:
    """Parameters and scores, one row per grid point; ``best`` marks the chosen one."""
    fields = []
    for name in points[0]:
        kinds = {type(point[name]) for point in points}
        if kinds <= {int, float}:
            kind = T.DoubleType() if float in kinds else T.LongType()
        else:
            kind = T.BooleanType() if kinds == {bool} else T.StringType()
        fields.append(T.StructField(name, kind))
    convert = {T.DoubleType: float, T.LongType: int, T.BooleanType: bool, T.StringType: str}
    rows = [
        [convert[type(f.dataType)](point[f.name]) for f in fields]
        + [column[i] for column in scores.values()]
        + [i == best]
        for i, point in enumerate(points)
    ]
    fields += [T.StructField(name, T.DoubleType()) for name in scores]
    fields.append(T.StructField("best", T.BooleanType()))
    return spark.createDataFrame(rows, T.StructType(fields))


def sweep(
    plan: Pipeline,
    train: DataFrame,
    test: DataFrame,
    points: Sequence[Point],
    metric: str = "rmse",
    parallelism: int = 4,
    pool: FitPool | None = None,
) -> Search:
    """Fit each point on ``train``, score it on ``test``; keep the best one for use.

    Fits take turns in ``pool``, which several sweeps may share, or in one of
    ``parallelism`` threads.

    Pass a validation slice as ``test`` to keep the final holdout out of the
    choice. The table has the parameters, the metric and ``best``, one row per point.
    """
    points = [dict(p) for p in points]
    scores, best, model = _scores(plan, train, test, points, metric, parallelism, pool)
    table = _result_table(train.sparkSession, points, {metric: scores}, best)
    return Search(table, points[best], model or _fit(plan, train, points[best]))


def kfold_blocks(df: DataFrame, key: str, folds: int = 3, name: str = "fold") -> DataFrame:
    """Assign contiguous, near-equal blocks of rows in key order to folds.

    The first ``n % folds`` blocks have one row more than the others.
    """
    placed = ordinal_index(df, key, "_position")
    n = placed.count()
    size, larger = divmod(n, folds)
    if size == 0:
        raise ValueError(f"{n} rows cannot make {folds} folds")
    position = F.col("_position")
    edge = larger * (size + 1)
    fold = F.when(position < edge, F.floor(position / (size + 1))).otherwise(
        larger + F.floor((position - edge) / size)
    )
    return placed.withColumn(name, fold.cast("int")).drop("_position")


def kfold_hash(df: DataFrame, key: str, folds: int = 3, name: str = "fold") -> DataFrame:
    """Assign rows to folds by a hash of their key: repeatable, and without a shuffle."""
    return df.withColumn(name, F.pmod(F.xxhash64(named(key)), F.lit(folds)).cast("int"))


def cross_validate(
    plan: Pipeline,
    df: DataFrame,
    points: Sequence[Point],
    fold: str = "fold",
    folds: int = 3,
    metric: str = "r2",
    parallelism: int = 4,
) -> Search:
    """Score each point on every fold after fitting on the others; refit the best on all.

    The table has the parameters, the score per fold and ``mean_<metric>``.
    """
    _check_metric(metric)
    scratch_dir(df.sparkSession)
    points = [dict(p) for p in points]
    inputs = _inputs(plan)
    rows = prepared(plan, df, fold)
    index = {id(point): i for i, point in enumerate(points)}
    scores = [[math.nan] * len(points) for _ in range(folds)]
    # Every fit reads the one stored table; folds and points share the pool.
    with kept(rows):

        def score(task: tuple[int, list[Point]]) -> tuple[int, list[Point], list[float]]:
            f, job = task
            train, test = rows.where(named(fold) != f), rows.where(named(fold) == f)
            found, _ = _score_job(plan, only(train, inputs), only(test, inputs), job, metric)
            return f, job, found

        tasks = [(f, job) for f in range(folds) for job in _jobs(plan, points)]
        with FitPool(df.sparkSession, parallelism) as fits:
            for f, job, found in fits.run(score, tasks):
                for point, value in zip(job, found):
                    scores[f][index[id(point)]] = value
        if any(math.isinf(min(_rank(value, metric) for value in part)) for part in scores):
            raise ValueError(f"{metric} is undefined at every grid point")
        means = [sum(part) / folds for part in zip(*scores)]
        best = min(range(len(points)), key=lambda i: (_rank(means[i], metric), i))
        if math.isnan(means[best]):
            raise ValueError(f"{metric} is undefined at every grid point")
        model = _fit(plan, only(rows, inputs), points[best])
    columns = {f"{metric}_fold{f}": part for f, part in enumerate(scores)}
    table = _result_table(df.sparkSession, points, {**columns, f"mean_{metric}": means}, best)
    return Search(table, points[best], model)


def forest_search(
    plan: Pipeline,
    df: DataFrame,
    key: str,
    grid: Mapping[str, Sequence] | None = None,
    search: str = "Random",
    n_iter: int = 100,
    folds: int = 3,
    seed: int = 42,
    parallelism: int = 4,
    assign: Callable[[DataFrame, str, int], DataFrame] = kfold_blocks,
) -> Search | PipelineModel:
    """A plain fit without a grid; else a random or grid search by cross-validated R2.

    ``assign`` puts rows in folds: blocks in key order, or ``kfold_hash``, which
    needs no sort and suits large tables.
    """
    if not grid:
        return plan.fit(df)
    points = sample_points(grid, n_iter, seed) if search == "Random" else grid_points(grid)
    placed = assign(df, key, folds)
    return cross_validate(plan, placed, points, folds=folds, parallelism=parallelism)
