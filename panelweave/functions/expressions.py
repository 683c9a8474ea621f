"""Column expressions. All of them stay inside JVM code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    """A column name as it must be written to be taken literally."""
    return "`" + name.replace("`", "``") + "`"


def reference(name: str) -> str:
    """A column name as Spark ML's inputs take it: quoted only where it must be."""
    return name if name.replace("_", "a").isalnum() else quoted(name)


def exact_name(written: str) -> str:
    """The column name behind :func:`reference`."""
    return written[1:-1].replace("``", "`") if written.startswith("`") else written


def named(name: str) -> Column:
    """A column by its exact name, which may hold dots (indicator codes do) or spaces."""
    return F.col(quoted(name))


def nan_to_null(value: Column) -> Column:
    """NaN becomes NULL, so that missing values sort, count and drop in one way."""
    return F.when(~F.isnan(value), value)


def without_nan(df: DataFrame) -> DataFrame:
    """Apply :func:`nan_to_null` to every floating-point column."""
    floats = {
        f.name: nan_to_null(named(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(floats) if floats else df


def residual(prediction: Column, actual: Column) -> Column:
    """Signed error, prediction minus actual."""
    return prediction - actual


def relative_error(prediction: Column, actual: Column) -> Column:
    """Signed error as a fraction (not percent) of the actual; NULL where it is 0."""
    return F.try_divide(prediction - actual, actual)


def correlation(a: Column, b: Column) -> Column:
    """Pearson r over the rows where both are present; NULL if either is constant.

    ``corr`` raises on a constant column in ANSI mode, hence the spelled-out form. Sums
    over several tasks leave a constant column a spread of some last digits of its mean,
    which is none.
    """

    def spread(paired: Column) -> Column:
        found = F.stddev_pop(paired)
        return F.when(found > 1e-12 * F.abs(F.avg(paired)), found)

    return F.try_divide(
        F.covar_pop(a, b), spread(F.when(b.isNotNull(), a)) * spread(F.when(a.isNotNull(), b))
    )


def bin_bounds(low: Column, high: Column) -> tuple[Column, Column]:
    """Outer edges of a histogram: a constant column gets a range of width one."""
    flat = low == high
    return F.when(flat, low - 0.5).otherwise(low), F.when(flat, high + 0.5).otherwise(high)


def bin_edge(low: Column, high: Column, edge: Column, bins: int) -> Column:
    """Position of edge number ``edge`` out of ``bins + 1``."""
    return F.when(edge == bins, high).otherwise(low + edge * ((high - low) / F.lit(float(bins))))


def bin_index(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based equal-width bin; all bins are half open but the last, which is closed.

    The division can land one bin off an edge, so the guess is checked against
    the edges themselves. ``low`` and ``high`` come from :func:`bin_bounds`.
    """
    guess = F.least(F.floor((value - low) / (high - low) * bins), F.lit(bins - 1))
    below = value < bin_edge(low, high, guess, bins)
    above = (value >= bin_edge(low, high, guess + 1, bins)) & (guess < bins - 1)
    return (guess - below.cast("int") + above.cast("int")).cast("int")
