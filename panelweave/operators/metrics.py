"""Residuals and error metrics over prediction tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.functions.expressions import named, relative_error, residual


def add_residuals(df: DataFrame, label: str, predictions: Mapping[str, str]) -> DataFrame:
    """Add ``<name>_Res`` per model, ``predictions`` = ``{name: prediction column}``."""
    return df.withColumns(
        {f"{n}_Res": residual(named(p), named(label)) for n, p in predictions.items()}
    )


def add_relative_errors(df: DataFrame, label: str, predictions: Mapping[str, str]) -> DataFrame:
    """Add ``<name>_MAPE`` per model: signed, a fraction, one value per row."""
    return df.withColumns(
        {f"{n}_MAPE": relative_error(named(p), named(label)) for n, p in predictions.items()}
    )


def accuracy_metrics(
    df: DataFrame, label: str, prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """``(mae, mape, accuracy, zero_labels)``.

    MAPE is ``100 * mean(|error| / label)`` with the label's sign kept, accuracy
    is 100 less that. Rows with label 0 have no relative error; they are counted.
    """
    error = F.abs(residual(named(prediction), named(label)))
    mape = 100 * F.avg(F.try_divide(error, named(label)))
    return df.groupBy(*[named(c) for c in by]).agg(
        F.avg(error).alias("mae"),
        mape.alias("mape"),
        (100 - mape).alias("accuracy"),
        F.count(F.when(named(label) == 0, F.lit(1))).alias("zero_labels"),
    )


def regression_metrics(
    df: DataFrame, label: str, prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """``(n, rmse, r2)`` in one aggregation; R2 is NULL where the label is constant."""
    scored = df.where(named(label).isNotNull() & named(prediction).isNotNull())
    squared = F.pow(residual(named(prediction), named(label)), 2)
    spread = F.var_pop(named(label)) * F.count(F.lit(1))
    return scored.groupBy(*[named(c) for c in by]).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(squared)).alias("rmse"),
        (1 - F.try_divide(F.sum(squared), spread)).alias("r2"),
    )


def model_metrics(df: DataFrame, label: str, predictions: Mapping[str, str]) -> DataFrame:
    """``(model, n, rmse, r2)`` for several prediction columns, best first."""
    errors = F.array(
        *[F.struct(F.lit(n).alias("model"), named(p).alias("p")) for n, p in predictions.items()]
    )
    long = df.select(named(label).alias("y"), F.inline(errors))
    return regression_metrics(long, "y", "p", by=["model"]).orderBy("rmse", "model")
