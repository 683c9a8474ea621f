"""Sorts, limits and positions.

Positions over a whole table (or over a group that may hold most of it) are
numbered without a window over the rows, which would put them in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.expressions import named, quoted
from panelweave.functions.storage import materialize


def descending(value: str, key: str) -> list[Column]:
    """The order of every ranking: largest first, missing last, then by key."""
    return [named(value).desc_nulls_last(), named(key).asc()]


def sorted_values(df: DataFrame, value: str, key: str) -> DataFrame:
    """All rows, largest value first: a range-partitioned sort."""
    return df.orderBy(*descending(value, key))


def top_k(df: DataFrame, value: str, key: str, k: int = 20) -> DataFrame:
    """The first ``k`` rows of :func:`sorted_values`; each task keeps ``k`` rows at most."""
    return df.orderBy(*descending(value, key)).limit(k)


def bottom_k(
    df: DataFrame, value: str, key: str, k: int = 20, include_missing: bool = False
) -> DataFrame:
    """The last ``k`` rows, still largest first.

    Rows without a value are left out; with ``include_missing`` they count as
    last and so come before the smallest values. ``k = 0`` gives no rows.
    """
    if include_missing:
        reverse = named(value).asc_nulls_first()
    else:
        df = df.where(named(value).isNotNull())
        reverse = named(value).asc()
    last = df.orderBy(reverse, named(key).desc()).limit(k)
    return last.orderBy(*descending(value, key))


def exclude_top_k(df: DataFrame, value: str, key: str, k: int = 5) -> DataFrame:
    """The table without the entities that hold the ``k`` largest values."""
    return df.join(top_k(df, value, key, k).select(named(key)), key, "left_anti")


def number_rows(
    df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), name: str = "position"
) -> DataFrame:
    """Add the 0-based position in ``order``, over the table or within each ``by`` group.

    Rows are range-partitioned and sorted by (by, order), so a group of any size
    spreads over many tasks. Each partition numbers its own rows; the counts per
    (partition, group) then say how far to shift them. The numbered rows are
    stored once, so that counts and rows agree even if a task runs again.
    ``order`` must be total within a group for the positions to be repeatable.
    """
    row_in_partition = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = materialize(
        df.repartitionByRange(*[named(c) for c in by], *order)
        .sortWithinPartitions(*[named(c) for c in by], *order)
        .withColumns({"_part": F.spark_partition_id(), "_row": row_in_partition}),
        "numbered",
    )
    before = (
        Window.partitionBy(*[named(c) for c in by]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    blocks = numbered.groupBy(*[named(c) for c in by], "_part").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first")
    )
    shifts = blocks.select(
        *[named(c).alias(f"_by_{c}") for c in by],
        F.col("_part").alias("_block"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    same = numbered["_part"] == shifts["_block"]
    for c in by:
        same = same & numbered[quoted(c)].eqNullSafe(shifts[quoted(f"_by_{c}")])
    return numbered.join(shifts, same, "inner").select(
        *[numbered[quoted(c)] for c in df.columns],
        (F.col("_row") + F.col("_shift")).cast("bigint").alias(name),
    )


def ordinal_index(df: DataFrame, key: str, name: str = "position") -> DataFrame:
    """0-based row number by key, the x axis of a chart over entities."""
    return number_rows(df, [named(key).asc()], name=name)


def rank_columns(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``(key, indicator, value, rank)``: 0-based position in each column.

    Largest first, no shared ranks, missing last. All columns are ranked in one
    shuffle of the long form.
    """
    long = df.unpivot([named(key)], [named(c) for c in columns], "indicator", "value")
    return number_rows(long, descending("value", key), by=["indicator"], name="rank")


def rank_table(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row per entity, each column replaced by its rank."""
    return rank_cells(rank_columns(df, key, columns), key, columns)


def rank_cells(ranks: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Ranks in long form -> one row per entity."""
    cells = [F.max(F.when(F.col("indicator") == c, F.col("rank"))).alias(c) for c in columns]
    return ranks.groupBy(named(key)).agg(*cells)
