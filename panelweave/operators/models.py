"""Regression models: Spark ML pipelines over panels.

Every fit is a pipeline of feature assembly and one estimator, so a fitted
model takes a panel as it is. Prediction columns have distinct names, so several
models score one table in a chain, without a join. Column names are taken
literally, so a panel pivoted by dotted indicator codes can be fitted.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame, SparkSession

from panelweave.functions.expressions import exact_name, named, reference
from panelweave.operators.exact_trees import ExactBoosting, ExactTree

FEATURES = "features"

# Settings of the linear fit.
LINEAR_SETTINGS = {"maxIter": 100, "regParam": 0.3, "elasticNetParam": 0.8}

# Settings of the forest fit. Ten trees grown as deep as Spark
# allows, every predictor at every split, bootstrap samples of full size.
FOREST_SETTINGS = {
    "numTrees": 10,
    "maxDepth": 30,
    "minInstancesPerNode": 1,
    "featureSubsetStrategy": "all",
    "subsamplingRate": 1.0,
    "bootstrap": True,
    "seed": 42,
}

# How trees that may be deep are grown; none of it changes a tree. Rows remember the
# node they are in, so the tree grown so far does not go to every task at each level
# (that memory is cut off by checkpoints), and a pass over the rows splits as many
# nodes as half a gigabyte of statistics allows.
DEEP_TREES = {"cacheNodeIds": True, "checkpointInterval": 10, "maxMemoryInMB": 512}

# Parameters that the reports list.
TREE_PARAMS = ("minInstancesPerNode", "maxDepth", "maxBins")
BOOSTED_PARAMS = ("minInstancesPerNode", "maxDepth", "maxBins", "maxIter", "stepSize", "subsamplingRate")


def feature_assembler(features: Sequence[str]) -> VectorAssembler:
    """Numeric columns -> one vector, in the given order; a missing value is an error."""
    return VectorAssembler(
        inputCols=[reference(f) for f in features], outputCol=FEATURES, handleInvalid="error"
    )


def feature_vector(df: DataFrame, features: Sequence[str], label: str, *keep: str) -> DataFrame:
    """The feature table: key columns, vector, label."""
    return feature_assembler(features).transform(df).select(
        *[named(c) for c in keep], FEATURES, named(label)
    )


def label_column(label: str) -> str:
    """Where an estimator finds the label: Spark ML takes plain names only for it."""
    if reference(label) == label:
        return label
    return "_label_" + "".join(c if c.isalnum() else "_" for c in label)


class PanelPipeline(Pipeline):
    """A pipeline that is fitted on a plainly named copy of a label with dots or spaces."""

    label: str

    def labelled(self, df: DataFrame) -> DataFrame:
        """The table with the label where the estimator finds it."""
        column = label_column(self.label)
        return df if column in df.columns else df.withColumn(column, named(self.label))

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        return super()._fit(self.labelled(dataset))


def pipeline(estimator: Estimator, features: Sequence[str], label: str) -> PanelPipeline:
    """Feature assembly and one estimator."""
    plan = PanelPipeline(stages=[feature_assembler(features), estimator])
    plan.label = label
    return plan


def _columns(label: str, prediction: str) -> dict[str, str]:
    return {
        "featuresCol": FEATURES,
        "labelCol": label_column(label),
        "predictionCol": prediction,
    }


def linear_regression(
    features: Sequence[str], label: str, prediction: str = "prediction", **settings
) -> Pipeline:
    """Elastic-net linear regression.

    With the few predictors of a panel Spark solves it from one pass that sums
    the cross-products, whatever ``maxIter`` is.
    """
    settings = {**LINEAR_SETTINGS, **settings}
    return pipeline(LinearRegression(**_columns(label, prediction), **settings), features, label)


def decision_tree(
    features: Sequence[str], label: str, prediction: str = "prediction", exact: bool = False, **settings
) -> Pipeline:
    """One regression tree, Spark's defaults unless set, grown by DEEP_TREES.

    With ``exact`` every value is a split candidate, however many there are: see ``exact_trees``.
    """
    if exact:
        return pipeline(ExactTree(**_columns(label, prediction), **settings), features, label)
    settings = {**DEEP_TREES, **settings}
    return pipeline(DecisionTreeRegressor(**_columns(label, prediction), **settings), features, label)


def boosted_trees(
    features: Sequence[str], label: str, prediction: str = "prediction", exact: bool = False, **settings
) -> Pipeline:
    """Gradient-boosted trees, Spark's defaults unless set; ``exact`` as in :func:`decision_tree`."""
    if exact:
        return pipeline(ExactBoosting(**_columns(label, prediction), **settings), features, label)
    return pipeline(GBTRegressor(**_columns(label, prediction), **settings), features, label)


def random_forest(
    features: Sequence[str], label: str, prediction: str = "prediction", **settings
) -> Pipeline:
    """A random forest; every setting that matters is explicit, see FOREST_SETTINGS."""
    settings = {**DEEP_TREES, **FOREST_SETTINGS, **settings}
    return pipeline(RandomForestRegressor(**_columns(label, prediction), **settings), features, label)


def predict(df: DataFrame, *models: PipelineModel) -> DataFrame:
    """Score one table with several models, each into its own prediction column."""
    for model in models:
        df = model.transform(df.drop(FEATURES))
    return df


def repeatable(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """The rows in a fixed layout, so that seeded row samples draw the same rows again."""
    return df.repartition(partitions, named(key)).sortWithinPartitions(named(key))


@dataclass
class Fitted:
    """A fitted pipeline and what it reads and writes, as it is stored."""

    model: PipelineModel
    label: str
    prediction: str

    @property
    def features(self) -> list[str]:
        return [exact_name(f) for f in self.model.stages[0].getInputCols()]

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with the prediction; the label need not be there."""
        missing = [name for name in self.features if name not in df.columns]
        if missing:
            raise ValueError(f"no such columns: {missing}")
        return predict(df, self.model)


def _write_about(spark: SparkSession, path: str, label: str, prediction: str) -> None:
    about = spark.createDataFrame([(label, prediction)], "label string, prediction string")
    about.coalesce(1).write.mode("overwrite").json(f"{path}/about")


def save_model(model: PipelineModel, path: str, label: str) -> None:
    """Store a fitted pipeline below ``path`` for other applications, in place of one there.

    The label's exact name is stored beside it, since Spark ML knows its plain copy only.
    """
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    _write_about(spark, path, label, model.stages[-1].getPredictionCol())


def load_model(spark: SparkSession, path: str) -> Fitted:
    about = spark.read.schema("label string, prediction string").json(f"{path}/about").head()
    return Fitted(PipelineModel.load(f"{path}/model"), about["label"], about["prediction"])


def save_plan(plan: PanelPipeline, path: str) -> None:
    """Store a pipeline that is yet to be fitted, label included."""
    Pipeline(stages=plan.getStages()).write().overwrite().save(f"{path}/plan")
    spark = SparkSession.getActiveSession()
    _write_about(spark, path, plan.label, plan.getStages()[-1].getPredictionCol())


def load_plan(spark: SparkSession, path: str) -> PanelPipeline:
    about = spark.read.schema("label string, prediction string").json(f"{path}/about").head()
    plan = PanelPipeline(stages=Pipeline.load(f"{path}/plan").getStages())
    plan.label = about["label"]
    return plan


def linear_report(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """``(measure, name, value)``: coefficients, intercept, training fit, iterations."""
    features = [exact_name(f) for f in model.stages[0].getInputCols()]
    linear = model.stages[-1]
    summary = linear.summary
    rows = [("coefficient", f, float(c)) for f, c in zip(features, linear.coefficients)]
    rows += [
        ("intercept", None, float(linear.intercept)),
        ("train_rmse", None, float(summary.rootMeanSquaredError)),
        ("train_r2", None, float(summary.r2)),
        ("iterations", None, float(summary.totalIterations)),
    ]
    rows += [("objective", str(i), float(v)) for i, v in enumerate(summary.objectiveHistory)]
    return spark.createDataFrame(rows, "measure string, name string, value double")


def parameter_report(
    spark: SparkSession, models: Mapping[str, PipelineModel], params: Iterable[str] = BOOSTED_PARAMS
) -> DataFrame:
    """``(model, param, value, doc)`` as the fitted models hold them."""
    wanted = set(params)
    rows = [
        (name, param.name, str(value), param.doc)
        for name, model in models.items()
        for param, value in model.stages[-1].extractParamMap().items()
        if param.name in wanted
    ]
    return spark.createDataFrame(rows, "model string, param string, value string, doc string")
