"""A yearly customer panel over the order tables, in the shape of an indicator panel.

Entities are customers, indicators are ``revenue`` (the label), ``n_orders``,
``quantity`` and ``acctbal``; the customer's nation gives the entity type.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelweave.functions.storage import materialize, materialize_bucketed
from panelweave.operators import panel
from panelweave.sources import indicators, lookups

TRAIN_YEAR, TEST_YEAR = 1996, 1997
LABEL = "revenue"
PREDICTORS = ("n_orders", "quantity", "acctbal")
NUMBERS = (LABEL, *PREDICTORS)
YEARLY = ("revenue", "n_orders", "quantity")
# The predictors in a few bands each, all common, however many customers there are.
BANDS = ("orders_band", "quantity_band", "balance_band")


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables. Its schema is read from the files once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def yearly_facts(
    spark: SparkSession, sf_dir: str, years: Iterable[int] | None = None
) -> DataFrame:
    """``(entity, year, revenue, n_orders, quantity)`` from one scan of orders and lineitem.

    All orders count unless years are given, those without a date under year NULL.
    Given years are a date range, which reaches the scan. Line items shrink to one
    row per order before the join, and orders combine map-side before the
    shuffle by customer, so neither a huge order nor a huge customer lands in
    one task row by row. Amounts are rounded to cents, which takes the effect of
    summation order out of them.
    """
    orders = table(spark, sf_dir, "orders")
    year = F.year("o_orderdate")
    if years is not None:
        years = sorted(years)
        orders = orders.where(
            (F.col("o_orderdate") >= F.lit(date(years[0], 1, 1)))
            & (F.col("o_orderdate") < F.lit(date(years[-1] + 1, 1, 1)))
        )
        if len(years) == 1:
            year = F.lit(years[0])
        elif years != list(range(years[0], years[-1] + 1)):
            orders = orders.where(year.isin(years))
    per_order = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.sum("l_quantity").alias("order_quantity"))
    )
    # With one year the constant drops out of the grouping, so the result is
    # partitioned by customer alone and joins on without another shuffle.
    return (
        orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .groupBy(F.col("o_custkey").alias("entity"), year.alias("year"))
        .agg(
            F.round(F.sum("o_totalprice"), 2).alias("revenue"),
            F.count(F.lit(1)).cast("double").alias("n_orders"),
            F.sum("order_quantity").alias("quantity"),
        )
    )


def order_years(spark: SparkSession, sf_dir: str) -> list[int]:
    """The years in which there are orders, ascending: a few numbers, whatever the table."""
    year = F.year("o_orderdate").alias("year")
    found = table(spark, sf_dir, "orders").select(year).distinct().where("year IS NOT NULL")
    return sorted(row["year"] for row in found.collect())


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with its nation's name and its account balance."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    customer = table(spark, sf_dir, "customer")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left").select(
        F.col("c_custkey").alias("entity"), "country", F.col("c_acctbal").alias("acctbal")
    )


def entity_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type by nation name: every fifth nation is a group, two nations are unmapped."""
    nation = table(spark, sf_dir, "nation").where(~F.col("n_nationkey").isin(23, 24))
    kind = F.when(F.col("n_nationkey") % 5 == 0, "Group").otherwise("Country")
    return lookups.as_lookup(nation, F.col("n_name"), kind)


def long_form(
    spark: SparkSession,
    sf_dir: str,
    years: Iterable[int] | None = None,
    names: Sequence[str] = NUMBERS,
) -> DataFrame:
    """``(entity, indicator, year, value)`` of the named indicators, present values only.

    Without ``years`` all orders count; the balance then has the years of the orders.
    Only tables that those indicators need are read.
    """
    years = None if years is None else list(years)
    parts = []
    yearly = [name for name in names if name in YEARLY]
    if yearly:
        parts.append(
            yearly_facts(spark, sf_dir, years)
            .unpivot(["entity", "year"], yearly, "indicator", "value")
            .select("entity", "indicator", "year", "value")
        )
    if "acctbal" in names:
        years = order_years(spark, sf_dir) if years is None else years
        parts.append(
            table(spark, sf_dir, "customer").select(
                F.col("c_custkey").alias("entity"),
                F.lit("acctbal").alias("indicator"),
                F.explode(F.array(*[F.lit(y) for y in years]).cast("array<int>")).alias("year"),
                F.col("c_acctbal").alias("value"),
            )
        )
    return indicators.union_long(parts).where(F.col("value").isNotNull())


def customer_panel(spark: SparkSession, sf_dir: str, year: int = TRAIN_YEAR) -> DataFrame:
    """``(entity, country, entity_type, revenue, n_orders, quantity, acctbal)`` for one year.

    Every customer has a row; one without orders has missing values.
    """
    tagged = panel.tag_entity_type(
        entities(spark, sf_dir), entity_types(spark, sf_dir), "country"
    )
    facts = yearly_facts(spark, sf_dir, [year]).drop("year")
    return panel.align(tagged, facts).select("entity", "country", "entity_type", *NUMBERS)


def model_rows(
    spark: SparkSession,
    sf_dir: str,
    train_year: int = TRAIN_YEAR,
    test_year: int = TEST_YEAR,
    stored: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Complete rows of the train and the test year.

    ``stored`` writes both in one pass over the order tables, for fits that read
    them many times. Otherwise each year is a lazy plan over its own orders.
    """
    years = [train_year, test_year]
    balances = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("entity"), F.col("c_acctbal").alias("acctbal")
    )

    def complete(wanted: list[int]) -> DataFrame:
        rows = yearly_facts(spark, sf_dir, wanted).join(balances, "entity")
        return panel.complete_rows(rows.select("entity", "year", *NUMBERS))

    if stored:
        both = materialize(complete(years), "model-rows", partition_by=("year",))
        return panel.holdout_split(both, train_year, test_year)
    return complete([train_year]).drop("year"), complete([test_year]).drop("year")


def banded(rows: DataFrame) -> DataFrame:
    """Add :data:`BANDS`: up to three orders, fifty units, a thousand of balance apart."""
    return rows.withColumns(
        {
            "orders_band": F.least("n_orders", F.lit(3.0)),
            "quantity_band": F.least(F.floor(F.col("quantity") / 50), F.lit(5)).cast("double"),
            "balance_band": F.floor(F.col("acctbal") / 1000).cast("double"),
        }
    )


def facts_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`yearly_facts` of all years, stored once: a folder a year, bucketed by entity.

    Year slices of it read their folders alone and join each other by entity without
    an exchange.
    """
    facts = yearly_facts(spark, sf_dir).where("year IS NOT NULL")
    return materialize_bucketed(facts, "facts", "entity", partition_by=("year",))


def line_predictions(
    train: DataFrame, rows: DataFrame, x: str = "n_orders", keep: Sequence[str] = ("entity", LABEL)
) -> DataFrame:
    """Predictions of the train rows' least-squares line, a model in closed form."""
    line = train.agg(
        F.struct(
            F.regr_slope(LABEL, x).alias("slope"), F.regr_intercept(LABEL, x).alias("intercept")
        ).alias("line")
    )
    fitted = rows.withColumn("_line", line.scalar())
    prediction = F.col("_line.intercept") + F.col("_line.slope") * F.col(x)
    return fitted.select(*keep, prediction.alias("prediction"))
