"""Chart-data tables: what a chart would draw, as rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.functions.expressions import named
from panelweave.operators.ranking import rank_cells, rank_columns
from panelweave.operators.stats import low_high, with_bins, with_bounds


def chart_series(df: DataFrame, x: str, series: Mapping[str, str]) -> DataFrame:
    """``(x, series, y)``: several columns over one x, ``series`` = ``{label: column}``."""
    points = df.select(named(x), *[named(c).alias(label) for label, c in series.items()])
    return points.unpivot([named(x)], [named(label) for label in series], "series", "y")


def xy_pairs(df: DataFrame, x: str, y: str, *keep: str) -> DataFrame:
    """``(x, y)`` points, with any columns to keep: as many as there are rows.

    :func:`xy_buckets` and :func:`xy_outline` draw tables of any size.
    """
    return df.select(*[named(c) for c in keep], named(x).alias("x"), named(y).alias("y"))


def _bucketed(df: DataFrame, x: str, y: str, buckets: int, by: Sequence[str]) -> DataFrame:
    points = df.select(*[named(c) for c in by], named(x).alias("x"), named(y).alias("y"))
    rows = with_bins(points, ["x"], buckets, by).withColumnRenamed("_bin_x", "bucket")
    return rows.select(*[named(c) for c in by], "bucket", F.struct("x", "y").alias("p"), "x", "y")


def xy_buckets(
    df: DataFrame, x: str, y: str, buckets: int = 1000, by: Sequence[str] = ()
) -> DataFrame:
    """``(bucket, n, n_missing, x_low, x_high, y_mean, y_first, y_last, y_low, y_high)``.

    A chart of any number of rows as at most ``buckets`` rows a group: the x range is
    cut into equal widths, and each bucket says where it begins and ends, how high and
    low it goes and what it is on average. First and last are the y of its smallest
    and largest x, then y. Points without y are counted in ``n_missing`` alone; those
    without x make a bucket of their own, NULL. Two passes over ``df``, then one
    shuffle of at most one row per task, group and bucket, so a bucket may hold most
    of the rows.
    """
    rows = _bucketed(df, x, y, buckets, by).withColumn("p", F.when(F.col("y").isNotNull(), F.col("p")))
    first, last = F.min("p")["y"], F.max("p")["y"]
    return rows.groupBy(*[named(c) for c in by], "bucket").agg(
        F.count("y").alias("n"),
        F.count_if(F.col("y").isNull()).alias("n_missing"),
        F.min("x").alias("x_low"),
        F.max("x").alias("x_high"),
        F.avg("y").alias("y_mean"),
        # Points have their x first, so the least and greatest point end the bucket.
        F.when(F.col("bucket").isNotNull(), first).alias("y_first"),
        F.when(F.col("bucket").isNotNull(), last).alias("y_last"),
        F.min("y").alias("y_low"),
        F.max("y").alias("y_high"),
    )


def xy_outline(
    df: DataFrame, x: str, y: str, buckets: int = 1000, by: Sequence[str] = ()
) -> DataFrame:
    """``(x, y)`` of the points that a line chart of ``buckets`` pixels needs, four a bucket at most.

    Each bucket keeps its first and last point and its lowest and highest, so a line
    through them covers the pixels that the line through all points covers, extremes
    included. Ties go to the smaller x. Points without x or y draw nothing.
    """
    rows = _bucketed(df, x, y, buckets, by).where("x IS NOT NULL AND y IS NOT NULL")
    keys = [named(c) for c in by]
    low = F.min(F.struct("y", "x"))
    high = F.max(F.struct("y", (-F.col("x")).alias("m"), "x"))
    ends = rows.groupBy(*keys, "bucket").agg(
        F.array_distinct(
            F.array(
                F.min("p"),
                F.max("p"),
                F.struct(low["x"].alias("x"), low["y"].alias("y")),
                F.struct(high["x"].alias("x"), high["y"].alias("y")),
            )
        ).alias("points")
    )
    return ends.select(*keys, "bucket", F.inline("points"))


def date_label(df: DataFrame, timestamp: str, name: str = "label", pattern: str = "yyyy-MM") -> DataFrame:
    """Add an axis label made from a timestamp, months by default."""
    return df.withColumn(name, F.date_format(named(timestamp), pattern))


def pair_bins(df: DataFrame, columns: Sequence[str], bins: int = 20) -> DataFrame:
    """``(a, b, xbin, ybin, n)``: every pair of columns as counts on a bins x bins grid.

    The size is bounded by the grid however many rows there are, and each map
    task sends at most that many rows per pair. Pairs are listed once, in column
    order; rows where either value is missing are left out.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    cells = F.array(
        *[
            F.struct(
                F.lit(a).alias("a"),
                F.lit(b).alias("b"),
                named(f"_bin_{a}").alias("xbin"),
                named(f"_bin_{b}").alias("ybin"),
            )
            for a, b in pairs
        ]
    )
    return (
        with_bins(df, columns, bins)
        .select(F.inline(cells))
        .where(F.col("xbin").isNotNull() & F.col("ybin").isNotNull())
        .groupBy("a", "b", "xbin", "ybin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def parallel_coords(
    df: DataFrame, key: str, columns: Sequence[str], label: str, ranking: bool = False
) -> DataFrame:
    """``(key, axis, value, axis_min, axis_max, color, color_min, color_max)``.

    One row per entity and axis, raw values or ranks. Colour is the label's
    value (its rank, with ``ranking``) and its range is numeric.
    """
    if ranking:
        # Ranks run from 0 to the number of rows less one, in every column.
        ranks = rank_columns(df, key, columns)
        last = ranks.agg(F.max("rank").alias("last")).scalar()
        table = rank_cells(ranks, key, columns).withColumn("_last", last)
        low = dict.fromkeys(columns, F.lit(0).cast("bigint"))
        high = dict.fromkeys(columns, F.col("_last"))
    else:
        table = with_bounds(df.select(named(key), *[named(c) for c in columns]), columns)
        low = {c: low_high(c)[0] for c in columns}
        high = {c: low_high(c)[1] for c in columns}
    rows = [
        F.struct(
            F.lit(c).alias("axis"),
            named(c).alias("value"),
            low[c].alias("axis_min"),
            high[c].alias("axis_max"),
            named(label).alias("color"),
            low[label].alias("color_min"),
            high[label].alias("color_max"),
        )
        for c in columns
    ]
    return table.select(named(key), F.inline(F.array(*rows)))
