"""The whole study: indicator files in, residuals, scores and chart tables out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.storage import materialize, scratch_dir
from panelweave.operators import charts, metrics, models, panel, ranking, search
from panelweave.operators.fit_pool import FitPool
from panelweave.sources import indicators, lookups, tables

# Label, predictors in order, and the years to train and test on.
LABEL = "atmosphereCO2"
PREDICTORS = ("landForest", "populationTotal", "GDP", "populationUrban")
TRAIN_YEAR, TEST_YEAR = 2013, 2014

# The names of the charts' series, by model.
RESIDUE_SERIES, MAPE_SERIES = "{}_test_Residue", "{}_test_MAPE"


@dataclass
class Results:
    """Tables of a study; all lazy but the model fits behind them."""

    predictions: DataFrame
    residuals: DataFrame
    linear_report: DataFrame
    tree_sweep: DataFrame
    boosted_sweep: DataFrame
    parameters: DataFrame
    scores: DataFrame
    residual_chart: DataFrame
    relative_error_chart: DataFrame
    models: dict[str, PipelineModel] = field(default_factory=dict)

    def tables(self) -> dict[str, DataFrame]:
        return {n: v for n, v in vars(self).items() if isinstance(v, DataFrame)}


def read_panels(
    spark: SparkSession,
    paths: Sequence[str],
    lookup_path: str,
    codes: Mapping[str, str] = indicators.INDICATOR_CODES,
    train_year: int = TRAIN_YEAR,
    test_year: int = TEST_YEAR,
    file_years: Sequence[int] = tuple(range(indicators.FIRST_YEAR, indicators.LAST_YEAR + 1)),
) -> DataFrame:
    """Both years' panels, keyed by (entity, year), tagged with the entity type.

    The first indicator's file says which entities there are.
    """
    years = [train_year, test_year]
    wide = indicators.read_indicators(spark, list(paths), file_years)
    long = indicators.to_long(wide, years, keep_missing=True)
    rows = panel.pivot_panel(long, codes, years, carry=["entity_name"])
    tagged = panel.tag_entity_type(
        rows.withColumnRenamed("entity_name", "Country"),
        lookups.read_entity_types(spark, lookup_path),
        "Country",
        "CountryType",
    )
    return tagged.select("entity", "year", "Country", "CountryType", *codes)


def fit_models(
    train: DataFrame,
    test: DataFrame,
    label: str,
    predictors: Sequence[str],
    tree_grid: Mapping[str, Sequence] = search.TREE_GRID,
    boosted_grid: Mapping[str, Sequence] = search.BOOSTED_GRID,
    validation: DataFrame | None = None,
    parallelism: int = 4,
) -> tuple[dict[str, PipelineModel], DataFrame, DataFrame]:
    """Linear regression, swept tree and swept boosted trees, with the sweep tables.

    Grid points are scored on ``test`` unless a separate ``validation`` slice is
    given. The tables are read many times: pass stored ones, not long plans. All
    fits share ``parallelism`` threads, and one that fails stops the others.
    """
    scratch_dir(train.sparkSession)
    inputs = [*predictors, label]
    train = search.only(train, inputs)
    held_out = search.only(test if validation is None else validation, inputs)

    spark = train.sparkSession
    with search.kept(train, held_out), FitPool(spark, parallelism) as pool:

        def sweep(plan: Pipeline, grid: Mapping[str, Sequence]) -> search.Search:
            return search.sweep(plan, train, held_out, search.grid_points(grid), pool=pool)

        line = models.linear_regression(predictors, label, "LR_prediction")
        fits = [
            lambda: list(pool.run(line.fit, [train]))[0],
            lambda: sweep(models.decision_tree(predictors, label, "DT_prediction"), tree_grid),
            lambda: sweep(models.boosted_trees(predictors, label, "GBT_prediction"), boosted_grid),
        ]
        run = inheritable_thread_target(spark)(lambda fit: fit())
        # These threads wait; all fits of the three take turns in the one pool.
        with ThreadPool(len(fits)) as waiting:
            linear, tree, boosted = waiting.map(run, fits, chunksize=1)
    return {"LR": linear, "DT": tree.model, "GBT": boosted.model}, tree.table, boosted.table


def default_tree(
    train: DataFrame, test: DataFrame, label: str, predictors: Sequence[str]
) -> search.Search:
    """A tree with Spark's default settings, as a sweep of that one point."""
    plan = models.decision_tree(predictors, label, "DT_prediction")
    tree = plan.getStages()[-1]
    point = {name: tree.getOrDefault(name) for name in models.TREE_PARAMS}
    return search.sweep(plan, train, test, [point])


def residual_table(
    test: DataFrame, fitted: Mapping[str, PipelineModel], label: str
) -> DataFrame:
    """The test rows with predictions, residuals and relative errors of every model."""
    columns = {name: f"{name}_prediction" for name in fitted}
    scored = models.predict(test, *fitted.values())
    scored = metrics.add_residuals(scored, label, columns)
    return metrics.add_relative_errors(scored, label, columns)


def run_study(
    spark: SparkSession,
    paths: Sequence[str],
    lookup_path: str,
    codes: Mapping[str, str] = indicators.INDICATOR_CODES,
    label: str = LABEL,
    predictors: Sequence[str] = PREDICTORS,
    train_year: int = TRAIN_YEAR,
    test_year: int = TEST_YEAR,
    file_years: Sequence[int] = tuple(range(indicators.FIRST_YEAR, indicators.LAST_YEAR + 1)),
    tree_grid: Mapping[str, Sequence] = search.TREE_GRID,
    boosted_grid: Mapping[str, Sequence] = search.BOOSTED_GRID,
) -> Results:
    """Read, assemble, fit on one year, score on another."""
    both = read_panels(spark, paths, lookup_path, codes, train_year, test_year, file_years)
    both = panel.setup_panel(both, entity_type="Country", column="CountryType")
    both = materialize(both, "panel", partition_by=("year",))
    train, test = panel.holdout_split(both, train_year, test_year)

    fitted, tree_sweep, boosted_sweep = fit_models(
        train, test, label, predictors, tree_grid, boosted_grid
    )
    usual = default_tree(train, test, label, predictors)
    scored = residual_table(test, fitted, label)
    columns = {name: f"{name}_prediction" for name in fitted}
    placed = ranking.ordinal_index(scored.drop(models.FEATURES), "entity")
    return Results(
        predictions=scored.select("entity", "Country", label, *columns.values()),
        residuals=scored.drop("CountryType", *columns.values()),
        linear_report=models.linear_report(spark, fitted["LR"]),
        tree_sweep=tree_sweep.withColumn("default", F.lit(False)).unionByName(
            usual.table.withColumns({"best": F.lit(False), "default": F.lit(True)}),
            allowMissingColumns=True,
        ),
        boosted_sweep=boosted_sweep,
        parameters=models.parameter_report(
            spark, {"DT": fitted["DT"], "GBT": fitted["GBT"], "DT_default": usual.model}
        ),
        scores=metrics.model_metrics(scored, label, columns),
        residual_chart=charts.chart_series(
            placed, "position", {RESIDUE_SERIES.format(n): f"{n}_Res" for n in fitted}
        ),
        relative_error_chart=charts.chart_series(
            placed, "position", {MAPE_SERIES.format(n): f"{n}_MAPE" for n in ("DT", "GBT")}
        ),
        models=fitted,
    )


def write_results(results: Results, folder: str, fmt: str = "parquet") -> None:
    """Write every table of a study below ``folder``."""
    for name, table in results.tables().items():
        if fmt == "csv" and models.FEATURES in table.columns:
            table = table.drop(models.FEATURES)  # CSV has no vector type
        tables.write_table(table, f"{folder.rstrip('/')}/{name}", fmt)
