"""Local frames in, previews and result tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from panelweave.functions.expressions import named, without_nan


def from_local(spark: SparkSession, frame, schema=None) -> DataFrame:
    """A pandas frame (or list of rows) the user holds as a table, NaN as NULL."""
    return without_nan(spark.createDataFrame(frame, schema))


def select_columns(df: DataFrame, **columns: Column | str) -> DataFrame:
    """A new table from chosen columns: ``name=column``."""
    chosen = [named(c).alias(n) if isinstance(c, str) else c.alias(n) for n, c in columns.items()]
    return df.select(*chosen)


def preview(df: DataFrame, *order: Column | str, n: int = 5) -> DataFrame:
    """The first ``n`` rows in a stated order."""
    return df.orderBy(*order).limit(n)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write a result from the executors as parquet, or as CSV with a header."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
