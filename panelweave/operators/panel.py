"""Assembling entity x indicator panels: lookups, pivots, joins, slices, complete rows.

Tables are aligned by entity key, never by row position.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.expressions import named, quoted
from panelweave.sources.lookups import unique_lookup


def tag_entity_type(
    df: DataFrame, lookup: DataFrame, key: str, type_column: str = "entity_type"
) -> DataFrame:
    """Left lookup of the entity type by exact name; an unknown name gives NULL.

    ``lookup`` is ``(entity, entity_type)``. There is no broadcast hint: Spark
    broadcasts the lookup while its size is within
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles (splitting hot names,
    under adaptive execution) beyond that.
    """
    types = unique_lookup(lookup, "entity", "entity_type").select(
        F.col("entity").alias("_lookup_entity"), F.col("entity_type").alias(type_column)
    )
    return df.join(types, df[quoted(key)] == types["_lookup_entity"], "left").drop("_lookup_entity")


def _single(value: Column, count: Column, what: Column, name: str) -> Column:
    """``value`` if its group has one row at most; otherwise the query fails."""
    duplicate = F.raise_error(F.concat(F.lit("duplicate row for "), what, F.lit(f" in {name}")))
    return F.when(count > 1, duplicate).otherwise(value).alias(name)


def pivot_panel(
    long: DataFrame,
    indicators: Mapping[str, object] | Sequence[str],
    years: int | Iterable[int],
    entity: str = "entity",
    base: DataFrame | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Long rows -> one row per entity (and year), one column per indicator.

    ``indicators`` names the columns: ``{name: code}``, or a list where both are
    the same. One year gives a table keyed by entity, several years one keyed by
    (entity, year). The rows are those of ``base``, a table with the key columns
    (and any others to keep), or without it those that the first indicator has.
    ``carry`` columns (an entity's name, say) are taken from the first indicator.

    One shuffle, after map-side combining: each indicator is a conditional
    aggregate in the same group-by. Two rows for one cell fail the query.
    """
    codes = dict(indicators) if isinstance(indicators, Mapping) else {n: n for n in indicators}
    one_year = isinstance(years, int)
    wanted = [years] if one_year else list(years)
    keys = [entity] if one_year else [entity, "year"]

    rows = long.where(F.col("year").isin(wanted) & F.col("indicator").isin(list(codes.values())))
    cells = []
    for i, code in enumerate(codes.values()):
        hit = F.col("indicator") == F.lit(code)
        cells.append(F.max(F.when(hit, F.col("value"))).alias(f"_v{i}"))
        cells.append(F.count(F.when(hit, F.lit(1))).alias(f"_n{i}"))
    from_first = F.col("indicator") == F.lit(next(iter(codes.values())))
    carried = [F.max(F.when(from_first, named(c))).alias(c) for c in carry]
    key_columns = [named(k) for k in keys]
    grouped = rows.groupBy(*key_columns).agg(*cells, *carried)

    what = F.concat_ws(" ", *[k.cast("string") for k in key_columns])
    present = grouped if base is not None else grouped.where(F.col("_n0") > 0)
    panel = present.select(
        *key_columns,
        *[named(c) for c in carry],
        *[_single(F.col(f"_v{i}"), F.col(f"_n{i}"), what, n) for i, n in enumerate(codes)],
    )
    if base is None:
        return panel
    return base.join(panel, keys, "left")


def join_panel(
    base: DataFrame, tables: Mapping[str, DataFrame], year: int, entity: str = "entity"
) -> DataFrame:
    """Wide tables side by side: the year's column of each, renamed, joined by entity.

    Left joins onto ``base``, so its rows define the output. Every table is
    grouped by the key first, which asserts one row per entity and leaves it
    partitioned for the join: one shuffle per table.
    """
    panel = base
    for name, table in tables.items():
        rows = table.groupBy(named(entity)).agg(
            F.max(named(str(year))).alias("_v"), F.count(F.lit(1)).alias("_n")
        )
        column = rows.select(
            named(entity), _single(F.col("_v"), F.col("_n"), named(entity).cast("string"), name)
        )
        panel = panel.join(column, entity, "left")
    return panel


def align(left: DataFrame, *others: DataFrame, on: str | Sequence[str] = "entity") -> DataFrame:
    """Add the columns of other tables to ``left``, by key."""
    for other in others:
        left = left.join(other, on, "left")
    return left


def align_years(
    base: DataFrame, facts: DataFrame, years: Iterable[int], columns: Sequence[str], entity: str = "entity"
) -> DataFrame:
    """``base`` with each year's columns of a table keyed by (entity, year), as ``<column>_<year>``.

    Tables stored by ``materialize_bucketed`` join without an exchange. A second row of
    a year and entity fails the query.
    """
    for year in years:
        rows = facts.where(F.col("year") == year).groupBy(named(entity)).agg(
            *[F.max(named(c)).alias(f"_{c}") for c in columns], F.count(F.lit(1)).alias("_n")
        )
        what = named(entity).cast("string")
        cells = [_single(named(f"_{c}"), F.col("_n"), what, f"{c}_{year}") for c in columns]
        base = base.join(rows.select(named(entity), *cells), entity, "left")
    return base


def to_wide(
    long: DataFrame, indicator: object, years: Iterable[int], entity: str = "entity"
) -> DataFrame:
    """One indicator of the long form as a wide table, one column per year.

    One shuffle after map-side combining; two rows for one cell fail the query.
    Entities without a value in these years have no row.
    """
    years = list(years)
    cells = []
    for year in years:
        hit = F.col("year") == year
        cells.append(F.max(F.when(hit, F.col("value"))).alias(f"_v_{year}"))
        cells.append(F.count(F.when(hit, F.lit(1))).alias(f"_n_{year}"))
    rows = long.where((F.col("indicator") == F.lit(indicator)) & F.col("year").isin(years))
    grouped = rows.groupBy(named(entity)).agg(*cells)
    what = named(entity).cast("string")
    return grouped.select(
        named(entity), *[_single(F.col(f"_v_{y}"), F.col(f"_n_{y}"), what, str(y)) for y in years]
    )


def year_slice(df: DataFrame, year: int, value: str = "value") -> DataFrame:
    """One year: a column of a wide table, or the rows of a long one."""
    if "year" in df.columns:
        return df.where(F.col("year") == year).drop("year")
    keep = [c for c in df.columns if not c.isdigit()]
    return df.select(*[named(c) for c in keep], named(str(year)).alias(value))


def filter_type(df: DataFrame, entity_type: str = "Country", column: str = "entity_type") -> DataFrame:
    """Rows of one entity type."""
    return df.where(named(column) == entity_type)


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows without a missing value in any column, the entity type included."""
    return df.na.drop("any")


def setup_panel(
    df: DataFrame,
    filter: bool = True,
    entity_type: str = "Country",
    column: str = "entity_type",
) -> DataFrame:
    """Analysis rows: one entity type (or all, ``filter=False``), complete rows only."""
    return complete_rows(filter_type(df, entity_type, column) if filter else df)


def drop_columns(df: DataFrame, *columns: str) -> DataFrame:
    """The table without some columns; naming one that is not there is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.drop(*columns)


def split_predictors(
    df: DataFrame, label: str, keys: Sequence[str] = ("entity", "entity_type")
) -> tuple[DataFrame, DataFrame]:
    """Predictors (all but label and keys) and the label alone."""
    return df.drop(*keys, label), df.select(named(label))


def holdout_split(df: DataFrame, train_year: int, test_year: int) -> tuple[DataFrame, DataFrame]:
    """Two year slices of a panel keyed by (entity, year)."""
    return year_slice(df, train_year), year_slice(df, test_year)
