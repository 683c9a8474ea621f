"""Regression trees that try every split between neighbouring values, at any size.

Spark's own trees try at most ``maxBins`` split points a predictor, quantiles where it
has more values. These try all of them: rows shrink to one cell per (node, predictor,
value), and the sums left of each value come from running sums within blocks of
neighbouring values and the totals of the blocks before, so no predictor's values meet
in one task. Only the best split of each node comes to the driver. A tree is applied as
one expression, so it is meant to be shallow.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (
    HasFeaturesCol,
    HasLabelCol,
    HasMaxIter,
    HasPredictionCol,
    HasStepSize,
)
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.expressions import named
from panelweave.functions.storage import materialize

#: The expression of a tree has up to two to the power of its depth branches.
DEEPEST = 10


def _walk(node: dict, x: Column, leaf: Callable[[dict], Column]) -> Column:
    """``leaf`` of the leaf that a row falls into."""
    if "feature" not in node:
        return leaf(node)
    low, high = _walk(node["low"], x, leaf), _walk(node["high"], x, leaf)
    return F.when(x[node["feature"]] <= node["threshold"], low).otherwise(high)


def _fitted(trees: list[dict], x: Column) -> Column:
    """The weighted sum of the trees' predictions."""
    total = F.lit(0.0)
    for tree in trees:
        total = total + F.lit(tree["weight"]) * _walk(tree, x, lambda leaf: F.lit(leaf["value"]))
    return total


def _split_points(rows: DataFrame) -> DataFrame:
    """``(f, v, block, next)``: each predictor's values, their neighbours above, and blocks of them."""
    blocks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = rows.select(F.posexplode("x").alias("f", "v")).distinct()
    placed = materialize(
        values.repartitionByRange(blocks, "f", "v").withColumn("block", F.spark_partition_id()),
        "split-values",
    )
    above = F.lead("first").over(Window.partitionBy("f").orderBy("block"))
    edges = placed.groupBy("f", "block").agg(F.min("v").alias("first"))
    inside = F.lead("v").over(Window.partitionBy("f", "block").orderBy("v"))
    found = placed.withColumn("inside", inside).join(
        edges.select("f", "block", above.alias("above")), ["f", "block"]
    )
    return materialize(
        found.select("f", "v", "block", F.coalesce("inside", "above").alias("next")), "split-points"
    )


def _best_splits(
    rows: DataFrame, points: DataFrame, node: Column, target: Column, least: int
) -> DataFrame:
    """``(node, best)``: per node the split that leaves the least squared error.

    Equally good ones go to the first predictor, then the smallest value.
    """
    cells = (
        rows.select(node.alias("node"), target.alias("t"), F.posexplode("x").alias("f", "v"))
        .where("node IS NOT NULL")
        .groupBy("node", "f", "v")
        .agg(F.count("t").alias("n"), F.sum("t").alias("s"))
        .join(points, ["f", "v"])
    )
    whole = Window.partitionBy("node", "f")
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cells.groupBy("node", "f", "block").agg(F.sum("n").alias("bn"), F.sum("s").alias("bs"))
    blocks = blocks.select(
        "node",
        "f",
        "block",
        F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("n0"),
        F.coalesce(F.sum("bs").over(before), F.lit(0.0)).alias("s0"),
        F.sum("bn").over(whole).alias("nt"),
        F.sum("bs").over(whole).alias("st"),
    )
    upto = (
        Window.partitionBy("node", "f", "block")
        .orderBy("v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    sums = (
        cells.withColumns({"n1": F.sum("n").over(upto), "s1": F.sum("s").over(upto)})
        .join(blocks, ["node", "f", "block"])
        .withColumns({"nl": F.col("n0") + F.col("n1"), "sl": F.col("s0") + F.col("s1")})
        .withColumns({"nr": F.col("nt") - F.col("nl"), "sr": F.col("st") - F.col("sl")})
        .where((F.col("nl") >= least) & (F.col("nr") >= least))
    )
    low, high = F.col("sl") / F.col("nl"), F.col("sr") / F.col("nr")
    gain = F.col("nl") * F.col("nr") / F.col("nt") * (low - high) * (low - high)
    # Halfway, unless the two are so close that rounding gives the upper one.
    half = (F.col("v") + F.col("next")) / 2
    best = F.struct(
        (-gain).alias("loss"),
        "f",
        "v",
        F.when(half < F.col("next"), half).otherwise(F.col("v")).alias("threshold"),
        low.alias("low"),
        high.alias("high"),
        "nl",
        "nr",
    )
    return sums.groupBy("node").agg(F.min(best).alias("best")).where("best.loss < 0")


def _grow(rows: DataFrame, points: DataFrame, target: Column, depth: int, least: int) -> dict:
    """A tree as nested nodes, grown level by level."""
    x = F.col("x")
    least = max(least, 1)
    root: dict = {}
    growing = [root]
    for _ in range(depth):
        for i, node in enumerate(growing):
            node["id"] = i
        place = _walk(root, x, lambda leaf: F.lit(leaf.get("id")).cast("int"))
        found = {r["node"]: r["best"] for r in _best_splits(rows, points, place, target, least).collect()}
        following = []
        for i, node in enumerate(growing):
            del node["id"]
            if i not in found:
                continue
            best = found[i]
            node.update(
                feature=best["f"],
                threshold=best["threshold"],
                low={"value": best["low"]},
                high={"value": best["high"]},
            )
            following += [
                node[side] for side, n in (("low", best["nl"]), ("high", best["nr"])) if n >= 2 * least
            ]
        growing = following
        if not growing:
            break
    if "feature" not in root:
        root["value"] = rows.agg(F.avg(target)).head()[0]
        if root["value"] is None:
            raise ValueError("no rows to fit")
    return root


class _ExactParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", TypeConverters.toInt)
    minInstancesPerNode = Param(
        Params._dummy(), "minInstancesPerNode", "least rows of a leaf", TypeConverters.toInt
    )

    def _depth(self) -> int:
        depth = self.getOrDefault("maxDepth")
        if not 0 <= depth <= DEEPEST:
            raise ValueError(f"maxDepth must be 0 to {DEEPEST}")
        return depth

    @contextmanager
    def _rows(self, dataset: DataFrame) -> Iterator[DataFrame]:
        """``(x, y)`` of the dataset, held meanwhile."""
        y = named(self.getLabelCol()).cast("double")
        bad = y.isNull() | F.isnan(y)
        rows = dataset.select(
            vector_to_array(named(self.getFeaturesCol())).alias("x"),
            F.when(bad, F.raise_error(F.lit("a label is missing"))).otherwise(y).alias("y"),
        ).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            yield rows
        finally:
            rows.unpersist()

    def _model(self, trees: list[dict]) -> ExactTreesModel:
        model = ExactTreesModel()._set(trees=json.dumps(trees))
        return self._copyValues(model)


class ExactTree(Estimator, _ExactParams, DefaultParamsReadable, DefaultParamsWritable):
    """One regression tree."""

    @keyword_only
    def __init__(self, **settings):
        super().__init__()
        self._setDefault(maxDepth=5, minInstancesPerNode=1)
        self._set(**settings)

    def _fit(self, dataset: DataFrame) -> ExactTreesModel:
        depth, least = self._depth(), self.getOrDefault("minInstancesPerNode")
        with self._rows(dataset) as rows:
            tree = _grow(rows, _split_points(rows), F.col("y"), depth, least)
        return self._model([{**tree, "weight": 1.0}])


class ExactBoosting(
    Estimator, _ExactParams, HasMaxIter, HasStepSize, DefaultParamsReadable, DefaultParamsWritable
):
    """Boosting by squared error: each tree after the first is fitted to twice the error left."""

    @keyword_only
    def __init__(self, **settings):
        super().__init__()
        self._setDefault(maxDepth=5, minInstancesPerNode=1, maxIter=20, stepSize=0.1)
        self._set(**settings)

    def _fit(self, dataset: DataFrame) -> ExactTreesModel:
        depth, least = self._depth(), self.getOrDefault("minInstancesPerNode")
        trees: list[dict] = []
        with self._rows(dataset) as rows:
            points = _split_points(rows)
            for _ in range(self.getMaxIter()):
                left = 2 * (F.col("y") - _fitted(trees, F.col("x"))) if trees else F.col("y")
                tree = _grow(rows, points, left, depth, least)
                trees.append({**tree, "weight": float(self.getStepSize()) if trees else 1.0})
        return self._model(trees)


class ExactTreesModel(Model, _ExactParams, HasMaxIter, HasStepSize, DefaultParamsReadable, DefaultParamsWritable):
    """Trees, as JSON in the parameter ``trees``, and how their sum predicts."""

    trees = Param(Params._dummy(), "trees", "nested nodes of each tree", TypeConverters.toString)

    def _trees(self) -> list[dict]:
        return json.loads(self.getOrDefault("trees"))

    def _with_array(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn("_x", vector_to_array(named(self.getFeaturesCol())))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        predicted = _fitted(self._trees(), F.col("_x"))
        return self._with_array(dataset).withColumn(self.getPredictionCol(), predicted).drop("_x")

    def evaluateEachIteration(self, dataset: DataFrame, loss: str) -> list[float]:
        """The mean squared error of the first tree, the first two and so on, in one pass."""
        if loss != "squared":
            raise ValueError("loss must be squared")
        trees, label = self._trees(), named(self.getLabelCol())
        errors = [
            F.avg(F.pow(_fitted(trees[: i + 1], F.col("_x")) - label, F.lit(2.0))).alias(f"e{i}")
            for i in range(len(trees))
        ]
        return list(self._with_array(dataset).agg(*errors).head())
