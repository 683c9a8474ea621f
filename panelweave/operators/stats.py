"""Column statistics. Whole-table by default, per group with ``by``.

Every statistic is one aggregation with map-side combining, so a group that
holds most of the rows is reduced before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.expressions import (
    bin_bounds,
    bin_edge,
    bin_index,
    correlation,
    named,
    quoted,
)
from panelweave.functions.storage import materialize


def _per_column(
    df: DataFrame,
    columns: Sequence[str],
    measures: Mapping[str, Callable[[str], Column]],
    by: Sequence[str] = (),
) -> DataFrame:
    """One aggregation over all columns, turned into one row per column (and group)."""
    aggregates = [
        measure(c).alias(f"_{i}_{name}")
        for i, c in enumerate(columns)
        for name, measure in measures.items()
    ]
    rows = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"_{i}_{n}").alias(n) for n in measures])
        for i, c in enumerate(columns)
    ]
    keys = [named(c) for c in by]
    return df.groupBy(*keys).agg(*aggregates).select(*keys, F.inline(F.array(*rows)))


def column_ranges(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(column, min, max, range)``."""
    return _per_column(
        df,
        columns,
        {
            "min": lambda c: F.min(named(c)),
            "max": lambda c: F.max(named(c)),
            "range": lambda c: F.max(named(c)) - F.min(named(c)),
        },
        by,
    )


def arg_extremes(
    df: DataFrame, entity: str, columns: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """``(column, arg_min, arg_max)``: the entity at each extreme, smallest key on ties."""

    def at_low(c: str) -> Column:
        return F.min(F.when(named(c).isNotNull(), F.struct(named(c), named(entity).alias("entity"))))["entity"]

    def at_high(c: str) -> Column:
        negated = (-named(c)).alias("negated")
        return F.min(F.when(named(c).isNotNull(), F.struct(negated, named(entity).alias("entity"))))["entity"]

    return _per_column(df, columns, {"arg_min": at_low, "arg_max": at_high}, by)


def describe_columns(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(column, count, mean, stddev, min, max)``, typed; ``count`` leaves out missing."""
    return _per_column(
        df,
        columns,
        {
            "count": lambda c: F.count(named(c)),
            "mean": lambda c: F.avg(named(c)),
            "stddev": lambda c: F.stddev_samp(named(c)),
            "min": lambda c: F.min(named(c)),
            "max": lambda c: F.max(named(c)),
        },
        by,
    )


# Columns beyond which an expression per pair is too large a plan.
WIDE = 40
# Partial sums that one task adds up at a time.
FAN_IN = 512


def _moment_rows(columns: int, means: Sequence[float]) -> Callable:
    """Per task: for each column i, the sums over j that its correlations need."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, columns, columns))
        seen = False
        for batch in batches:
            cells = np.stack(
                [one.cast(pa.float64()).to_numpy(zero_copy_only=False) for one in batch.columns], axis=1
            )
            there = ~np.isnan(cells)
            x = np.where(there, cells - means, 0.0)
            there = there.astype(float)
            # Over rows that have both: n, sum of x_i, sum of x_i squared, sum of x_i x_j.
            for held, part in zip(sums, (there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x)):
                held += part
            seen = seen or batch.num_rows > 0
        if seen:
            yield pa.RecordBatch.from_pydict(
                {
                    "i": pa.array(range(columns), pa.int32()),
                    "part": pa.array([TaskContext.get().partitionId()] * columns, pa.int32()),
                    "sums": pa.array([sums[:, i].tobytes() for i in range(columns)], pa.binary()),
                }
            )

    return add


def wide_correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(a, b, r)`` of any number of columns from blocks of moment sums.

    Each task multiplies its rows' matrices, so the plan does not grow with the pairs.
    A column's sums with all others are one row; they are added up by column,
    ``FAN_IN`` tasks at a time, then r is an expression over a row per pair. Values
    are taken from the column's mean, found in a pass before.
    """
    names = list(columns)
    numbers = df.select(*[named(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    means = numbers.agg(*[F.avg(F.when(~F.isnan(c), F.col(c))) for c in numbers.columns]).first()
    center = np.array([m or 0.0 for m in means])

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(one, np.float64) for one in rows["sums"].to_pylist())
        return pa.table({"i": rows["i"][:1], "part": rows["part"][:1], "sums": [total.tobytes()]})

    kind = "i int, part int, sums binary"
    sums = numbers.mapInArrow(_moment_rows(len(names), center), kind)
    for part in (F.floor(F.col("part") / FAN_IN).cast("int"), F.lit(0)):
        sums = sums.withColumn("part", part).groupBy("i", "part").applyInArrow(add, kind)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, held in zip(batch.column("i").to_pylist(), batch.column("sums").to_pylist()):
                n, own, squares, products = np.frombuffer(held, np.float64).reshape(4, -1)
                yield pa.RecordBatch.from_pydict(
                    {
                        "i": pa.array([i] * len(n), pa.int32()),
                        "j": pa.array(range(len(n)), pa.int32()),
                        "n": n,
                        "own": own,
                        "squares": squares,
                        "products": products,
                    }
                )

    numbers = "n double, own double, squares double, products double"
    cells = materialize(sums.mapInArrow(spread, f"i int, j int, {numbers}"), "moments")
    other = cells.select(
        F.col("i").alias("_j"), F.col("j").alias("_i"), F.col("own").alias("_own"), F.col("squares").alias("_squares")
    )
    pairs = cells.join(other, (F.col("i") == F.col("_i")) & (F.col("j") == F.col("_j")))

    def spread_of(total: str, squares: str) -> Column:
        """n times the sum of squares from the mean; what rounding leaves of none is none."""
        found = F.col("n") * F.col(squares) - F.col(total) * F.col(total)
        return F.when(found > 1e-12 * F.col("n") * F.col(squares), found)

    r = (F.col("n") * F.col("products") - F.col("own") * F.col("_own")) / F.sqrt(
        spread_of("own", "squares") * spread_of("_own", "_squares")
    )
    itself = F.when(spread_of("own", "squares").isNotNull(), 1.0)
    name = F.array(*[F.lit(n) for n in names])
    return pairs.select(
        F.get(name, F.col("i")).alias("a"),
        F.get(name, F.col("j")).alias("b"),
        F.when(F.col("i") == F.col("j"), itself).otherwise(r).alias("r"),
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Pearson r for every ordered pair, ``(a, b, r)``, over rows where both are present.

    Each unordered pair is computed once; a constant column gives NULL. Beyond
    ``WIDE`` columns the sums behind all pairs are matrix products, see
    :func:`wide_correlation`.
    """
    names = list(columns)
    if len(names) > WIDE and not by:
        return wide_correlation(df, names)
    aggregates = [
        correlation(named(names[i]), named(names[j])).alias(f"_r_{i}_{j}")
        for i in range(len(names))
        for j in range(i + 1, len(names))
    ]
    aggregates += [
        F.when(correlation(named(c), named(c)).isNotNull(), F.lit(1.0)).alias(f"_r_{i}_{i}")
        for i, c in enumerate(names)
    ]
    rows = [
        F.struct(
            F.lit(names[i]).alias("a"),
            F.lit(names[j]).alias("b"),
            F.col(f"_r_{min(i, j)}_{max(i, j)}").alias("r"),
        )
        for i in range(len(names))
        for j in range(len(names))
    ]
    keys = [named(c) for c in by]
    return df.groupBy(*keys).agg(*aggregates).select(*keys, F.inline(F.array(*rows)))


def _bounds(columns: Sequence[str]) -> Column:
    """One struct holding the smallest and largest value of each column."""
    return F.struct(
        *[F.min(named(c)).alias(f"{c}_low") for c in columns],
        *[F.max(named(c)).alias(f"{c}_high") for c in columns],
    ).alias("_bounds")


def _null_safe(left: DataFrame, right: DataFrame, by: Sequence[str]) -> Column:
    condition = F.lit(True)
    for c in by:
        condition = condition & left[quoted(c)].eqNullSafe(right[quoted(f"_by_{c}")])
    return condition


def with_bounds(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Add ``_bounds``, the columns' ranges over the table or over the row's group.

    For the whole table they are a scalar subquery: a constant by the time the
    rows are read, no join. For groups they are computed once, stored, and joined
    on; the stored size tells Spark whether to broadcast them.
    """
    if not by:
        return df.withColumn("_bounds", df.agg(_bounds(columns)).scalar())
    groups = df.groupBy(*[named(c) for c in by]).agg(_bounds(columns)).withColumnsRenamed({c: f"_by_{c}" for c in by})
    groups = materialize(groups, "bounds")
    return df.join(groups, _null_safe(df, groups, by), "inner").drop(*[f"_by_{c}" for c in by])


def low_high(column: str) -> tuple[Column, Column]:
    """Ends of a column's range, after :func:`with_bounds`."""
    bounds = F.col("_bounds")
    return bounds.getField(f"{column}_low"), bounds.getField(f"{column}_high")


def minmax_scale(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Replace each column by ``(x - min) / (max - min)``; a constant column gives NULL."""
    scaled = {}
    for c in columns:
        low, high = low_high(c)
        scaled[c] = F.try_divide(named(c) - low, high - low)
    return with_bounds(df, columns, by).withColumns(scaled).drop("_bounds")


def with_bins(
    df: DataFrame, columns: Sequence[str], bins: int, by: Sequence[str] = ()
) -> DataFrame:
    """Add ``_bin_<column>``, the equal-width bin of each value (NULL if missing)."""
    indexes = {
        f"_bin_{c}": bin_index(named(c), *bin_bounds(*low_high(c)), bins) for c in columns
    }
    return with_bounds(df, columns, by).withColumns(indexes)


def histogram(
    df: DataFrame, columns: Sequence[str], bins: int = 20, by: Sequence[str] = ()
) -> DataFrame:
    """``(column, bin, low, high, n)`` with empty bins; the last bin is closed.

    Two passes over ``df``: ranges, then counts. Only ``bins`` rows per column
    and group leave a map task, and only those are gathered to fill the gaps. A
    constant column is centred in a range of width one, so its rows share a bin.
    """
    entries = []
    for c in columns:
        low, high = bin_bounds(*low_high(c))
        entries.append(
            F.struct(
                F.lit(c).alias("column"),
                low.alias("_low"),
                high.alias("_high"),
                named(f"_bin_{c}").alias("_bin"),
            )
        )
    keys = [named(c) for c in by]
    column = [*keys, "column", "_low", "_high"]
    counts = (
        with_bins(df, columns, bins, by)
        .select(*keys, F.inline(F.array(*entries)))
        .where(F.col("_bin").isNotNull())
        .groupBy(*column, "_bin")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    filled = (
        counts.groupBy(*column)
        .agg(F.map_from_entries(F.collect_list(F.struct("_bin", "_n"))).alias("_counts"))
        .withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    )
    low, high, bin = F.col("_low"), F.col("_high"), F.col("bin")
    return filled.select(
        *keys,
        "column",
        "bin",
        bin_edge(low, high, bin, bins).alias("low"),
        bin_edge(low, high, bin + 1, bins).alias("high"),
        F.coalesce(F.try_element_at("_counts", bin), F.lit(0)).cast("bigint").alias("n"),
    )
