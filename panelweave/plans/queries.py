"""The registered queries that assemble, summarise, rank and chart panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.storage import materialize, materialize_bucketed, scratch_path
from panelweave.operators import charts, metrics, models, panel, ranking, stats
from panelweave.plans import customers as c
from panelweave.plans.check_sql import FACTS, LINE, MODEL_ROWS, PANEL, unpivot_columns
from panelweave.plans.registry import query
from panelweave.sources import indicators, lookups, tables


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Columns rounded, so that summation order does not show."""
    return df.withColumns({name: F.round(name, digits) for name in columns})


# --- flagship -----------------------------------------------------------------


@query(
    "top_entities",
    f"""WITH {PANEL}
SELECT entity, country, entity_type, revenue, n_orders, quantity, acctbal FROM panel
WHERE entity_type = 'Country' AND revenue IS NOT NULL AND quantity IS NOT NULL
ORDER BY revenue DESC, entity LIMIT 20""",
)
def top_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel.setup_panel(c.customer_panel(spark, sf_dir), entity_type="Country")
    return ranking.top_k(rows, "revenue", "entity", 20)


# --- scans, sources, sinks ----------------------------------------------------


def indicator_files(
    spark: SparkSession, sf_dir: str, indicator: str = "revenue", by_nation: bool = False
) -> str:
    """One yearly indicator as files: a preamble, a header, a column per year.

    Entities are named after the customer, or after its nation.
    """
    folder = scratch_path(spark, "indicator-files")
    years = c.order_years(spark, sf_dir)
    values = panel.to_wide(c.long_form(spark, sf_dir, names=[indicator]), indicator, years)
    if by_nation:
        names = c.entities(spark, sf_dir).select("entity", F.col("country").alias("name"))
    else:
        names = c.table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("entity"), F.col("c_name").alias("name")
        )
    rows = names.join(values, "entity").select(
        F.col("name").alias("Country Name"),
        F.col("entity").cast("string").alias("Country Code"),
        F.lit(f"{indicator}, all orders").alias("Indicator Name"),
        F.lit(indicator).alias("Indicator Code"),
        *[F.col(f"`{y}`") for y in years],
    )
    rows.write.option("header", True).csv(folder)
    preamble = ['"Data Source","Order tables",', "", '"Last Updated Date","2018-08-28",', ""]
    spark.createDataFrame([(line,) for line in preamble], "value string").coalesce(1).write.mode(
        "append"
    ).text(folder)
    return folder


@query(
    "scan_indicator",
    f"""WITH {FACTS}
SELECT CAST(entity AS VARCHAR) AS entity, c_name AS entity_name, indicator, year, value
FROM long JOIN customer ON c_custkey = entity WHERE indicator = 'revenue' AND year IS NOT NULL""",
)
def scan_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = c.order_years(spark, sf_dir)
    wide = indicators.read_indicators(spark, indicator_files(spark, sf_dir), years)
    return indicators.to_long(wide)


NAMED_LONG = f"""WITH {FACTS}
SELECT CAST(entity AS VARCHAR) AS entity, c_name AS entity_name, indicator, year, value
FROM long JOIN customer ON c_custkey = entity WHERE year IS NOT NULL"""


def whole_files(spark: SparkSession, sf_dir: str, cells: Column | None = None) -> str:
    """All indicators as whole files, several each: four preamble lines, a header, rows.

    ``cells`` may rewrite the values, as text, from ``entity``, ``year`` and ``value``.
    """
    folder = scratch_path(spark, "whole-files")
    years = c.order_years(spark, sf_dir)
    names = c.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("entity"), F.col("c_name").alias("name")
    )
    long = c.long_form(spark, sf_dir).where("year IS NOT NULL").withColumn("file", F.col("entity") % 3)
    shown = F.col("value").cast("string") if cells is None else cells
    wide = (
        long.groupBy("indicator", "file", "entity")
        .agg(*[F.max(F.when(F.col("year") == y, shown)).alias(str(y)) for y in years])
        .join(names, "entity")
    )
    row = F.concat_ws(
        ",",
        F.to_csv(
            F.struct("name", F.col("entity").cast("string"), F.col("indicator"), F.col("indicator").alias("code"))
        ),
        *[F.coalesce(F.col(f"`{y}`"), F.lit("")) for y in years],
    )
    body = wide.select("indicator", "file", F.lit(5).alias("place"), row.alias("value"))
    header = ",".join(f'"{name}"' for name in [*indicators.DESCRIPTORS, *map(str, years)])
    head = ['"Data Source","Order tables",', "", '"Last Updated Date","2018-08-28",', "", header]
    top = F.posexplode(F.array(*[F.lit(line) for line in head])).alias("place", "value")
    lines = body.select("indicator", "file").distinct().select("indicator", "file", top).unionByName(body)
    (
        lines.repartition("indicator", "file")
        .sortWithinPartitions("indicator", "file", "place", "value")
        .select("indicator", "file", "value")
        .write.partitionBy("indicator", "file")
        .text(folder)
    )
    return f"{folder}/*/*/*.txt"


@query("skip_lines", NAMED_LONG)
def skip_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = indicators.read_csv_skipping(spark, whole_files(spark, sf_dir), 4)
    return indicators.to_long(wide)


#: Every seventh entity's cells of even years cannot be read; whole balances and a text column.
SPOILT = "CASE WHEN entity % 7 = 0 AND year % 2 = 0 THEN '~' || CAST(year AS VARCHAR) || '?' END"


def spoilt_files(spark: SparkSession, sf_dir: str) -> str:
    spoilt = F.when(
        (F.col("entity") % 7 == 0) & (F.col("year") % 2 == 0),
        F.concat(F.lit("~"), F.col("year").cast("string"), F.lit("?")),
    )
    whole = F.when(F.col("indicator") == "n_orders", F.col("value").cast("long").cast("string"))
    return whole_files(spark, sf_dir, F.coalesce(spoilt, whole, F.col("value").cast("string")))


@query(
    "rejected_cells",
    f"""WITH {FACTS}
SELECT CAST(entity AS VARCHAR) AS entity, indicator, year, {SPOILT} AS raw
FROM long WHERE year IS NOT NULL AND {SPOILT} IS NOT NULL""",
)
def rejected_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = c.order_years(spark, sf_dir)
    cells = indicators.raw_cells(spark, spoilt_files(spark, sf_dir), years)
    return indicators.rejected_cells(cells).drop("file")


@query(
    "read_with_rejects",
    f"""WITH {FACTS}
SELECT CAST(entity AS VARCHAR) AS entity, c_name AS entity_name, indicator, year, value
FROM long JOIN customer ON c_custkey = entity WHERE year IS NOT NULL AND {SPOILT} IS NULL""",
)
def read_with_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = c.order_years(spark, sf_dir)
    return indicators.to_long(indicators.read_indicators(spark, spoilt_files(spark, sf_dir), years))


@query(
    "column_types",
    f"""WITH {FACTS},
shown AS (
  SELECT indicator, entity, year, CASE WHEN {SPOILT} IS NOT NULL THEN 'text'
    WHEN indicator = 'n_orders' THEN 'integer' ELSE 'number' END AS kind
  FROM long WHERE year IS NOT NULL),
grid AS (
  SELECT * FROM (SELECT DISTINCT indicator, entity FROM shown), (SELECT DISTINCT year FROM shown)),
counted AS (
  SELECT g.indicator, CAST(g.year AS VARCHAR) AS "column", count(*) AS n,
    count(*) FILTER (kind IS NULL) AS n_missing, CAST(0 AS BIGINT) AS n_boolean,
    count(*) FILTER (kind = 'integer') AS n_integer, count(*) FILTER (kind = 'number') AS n_number,
    count(*) FILTER (kind = 'text') AS n_text
  FROM grid g LEFT JOIN shown s ON s.indicator = g.indicator AND s.entity = g.entity AND s.year = g.year
  GROUP BY 1, 2
  UNION ALL
  SELECT g.indicator, d, count(*), 0, 0, count(*) FILTER (d = 'Country Code'), 0,
    count(*) FILTER (d <> 'Country Code')
  FROM (SELECT DISTINCT indicator, entity FROM shown) g,
    (VALUES ('Country Name'), ('Country Code'), ('Indicator Name'), ('Indicator Code')) t(d)
  GROUP BY 1, 2)
SELECT *, CASE WHEN n_boolean = n THEN 'boolean' WHEN n_integer = n THEN 'bigint'
  WHEN n_integer + n_number + n_missing = n THEN 'double' ELSE 'string' END AS type
FROM counted""",
)
def column_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = c.order_years(spark, sf_dir)
    cells = indicators.raw_cells(spark, spoilt_files(spark, sf_dir), years)
    return indicators.column_types(cells, by=["indicator"])


def type_file(spark: SparkSession, sf_dir: str) -> str:
    """The entity types as small files, a JSON object for each entity: one per nation."""
    path = scratch_path(spark, "lookup")
    types = c.entity_types(spark, sf_dir)
    entry = F.to_json(F.create_map("entity", "entity_type"))
    types.select(entry.alias("value"), "entity").write.partitionBy("entity").text(path)
    return path


@query(
    "lookup_load",
    """SELECT n_name AS entity,
  CASE WHEN n_nationkey % 5 = 0 THEN 'Group' ELSE 'Country' END AS entity_type
FROM nation WHERE n_nationkey NOT IN (23, 24)""",
)
def lookup_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.read_entity_types(spark, type_file(spark, sf_dir))


@query("multi_indicator_long", f"WITH {FACTS} SELECT entity, indicator, year, value FROM long")
def multi_indicator_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.long_form(spark, sf_dir)


@query(
    "long_store",
    f"""WITH {FACTS}
SELECT entity, indicator, value FROM long WHERE year = 1996""",
)
def long_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "long-store")
    indicators.write_long(c.long_form(spark, sf_dir), path)
    return panel.year_slice(indicators.read_long(spark, path), 1996)


@query(
    "replace_years",
    f"""WITH {FACTS}
SELECT entity, indicator, year, CASE WHEN year = 1997 THEN 2 * value ELSE value END AS value
FROM long WHERE year BETWEEN 1995 AND 1998""",
)
def replace_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads: the second brings 1998 and corrects 1997."""
    path = scratch_path(spark, "yearly-store")
    indicators.write_long(c.long_form(spark, sf_dir, [1995, 1996, 1997]), path)
    later = c.long_form(spark, sf_dir, [1997, 1998])
    doubled = F.when(F.col("year") == 1997, 2 * F.col("value")).otherwise(F.col("value"))
    indicators.replace_years(later.withColumn("value", doubled), path)
    return indicators.read_long(spark, path).select("entity", "indicator", "year", "value")


@query(
    "panel_base",
    f"WITH {FACTS} SELECT country AS \"Country\", entity_type AS \"CountryType\", entity FROM entities",
)
def panel_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = panel.tag_entity_type(
        c.entities(spark, sf_dir), c.entity_types(spark, sf_dir), "country"
    )
    return tables.select_columns(
        tagged, Country="country", CountryType="entity_type", entity="entity"
    )


@query(
    "from_local",
    """SELECT c_custkey AS entity, c_mktsegment AS segment,
  CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 1.5 WHEN 'MACHINERY' THEN 2.0 END AS DOUBLE) AS weight
FROM customer""",
)
def from_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pandas as pd

    weights = pd.DataFrame(
        {"segment": ["BUILDING", "MACHINERY", "FURNITURE"], "weight": [1.5, 2.0, float("nan")]}
    )
    customer = c.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("segment")
    )
    local = tables.from_local(spark, weights, "segment string, weight double")
    return panel.align(customer, local, on="segment")


@query(
    "write_read_predictions",
    f"""WITH {LINE} SELECT entity, revenue, round(prediction, 4) AS prediction FROM scored""",
)
def write_read_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = c.model_rows(spark, sf_dir, stored=False)
    path = scratch_path(spark, "predictions")
    tables.write_table(c.line_predictions(train, test), path)
    return rounded(spark.read.parquet(path), 4, "prediction")


@query(
    "preview",
    f"WITH {PANEL} SELECT * FROM panel ORDER BY entity LIMIT 5",
)
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.preview(c.customer_panel(spark, sf_dir), "entity")


# Descriptions of the customer indicators, as metadata file lines.
METADATA = {
    "revenue": '"revenue","Revenue","Order prices, summed over the year.","Orders",',
    "n_orders": '"n_orders","Orders","Number of orders, by year.","Orders",',
    "quantity": '"quantity","Quantity","Ordered units, summed over the year.","Line items",',
    "acctbal": '"acctbal","Balance","Account balance, ""as is"".","Customers",',
}


@query(
    "indicator_catalog",
    f"""WITH {FACTS}
SELECT indicator AS "INDICATOR_CODE",
  CASE indicator WHEN 'revenue' THEN 'Revenue' WHEN 'n_orders' THEN 'Orders'
    WHEN 'quantity' THEN 'Quantity' ELSE 'Balance' END AS "INDICATOR_NAME",
  CASE indicator WHEN 'revenue' THEN 'Order prices, summed over the year.'
    WHEN 'n_orders' THEN 'Number of orders, by year.'
    WHEN 'quantity' THEN 'Ordered units, summed over the year.'
    ELSE 'Account balance, "as is".' END AS "SOURCE_NOTE",
  count(*) AS n_values, round(sum(value), 2) AS total
FROM long GROUP BY 1, 2, 3""",
)
def indicator_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = "\ufeff" + ",".join(f'"{name}"' for name in lookups.CATALOG_COLUMNS) + ","
    folder = scratch_path(spark, "metadata")
    for line in METADATA.values():
        lines = spark.createDataFrame([(header,), (line,)], "value string")
        lines.coalesce(1).write.mode("append").text(folder)
    catalog = lookups.read_catalog(spark, folder).select(
        "INDICATOR_CODE", "INDICATOR_NAME", "SOURCE_NOTE"
    )
    totals = (
        c.long_form(spark, sf_dir)
        .groupBy(F.col("indicator").alias("INDICATOR_CODE"))
        .agg(F.count(F.lit(1)).alias("n_values"), F.round(F.sum("value"), 2).alias("total"))
    )
    return catalog.join(totals, "INDICATOR_CODE")


# --- projections, filters, derived columns ------------------------------------


@query(
    "year_slice",
    f"""WITH {FACTS}
SELECT f.entity, g.revenue AS value FROM (SELECT DISTINCT entity FROM facts) f
LEFT JOIN facts g ON g.entity = f.entity AND g.year = 1996""",
)
def year_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = c.order_years(spark, sf_dir)
    wide = panel.to_wide(c.long_form(spark, sf_dir, names=["revenue"]), "revenue", years)
    return panel.year_slice(wide, 1996)


@query(
    "panel_pivot",
    f"WITH {FACTS} SELECT entity, revenue, n_orders AS orders, quantity FROM facts WHERE year = 1996",
)
def panel_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"revenue": "revenue", "orders": "n_orders", "quantity": "quantity"}
    long = c.long_form(spark, sf_dir, [1996], c.YEARLY)
    return panel.pivot_panel(long, names, 1996)


@query(
    "panel_pivot_base",
    f"""WITH {FACTS}
SELECT e.entity, e.country, f.revenue, f.quantity
FROM entities e LEFT JOIN facts f ON f.entity = e.entity AND f.year = 1997""",
)
def panel_pivot_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = c.entities(spark, sf_dir).select("entity", "country")
    names = ["revenue", "quantity"]
    long = c.long_form(spark, sf_dir, [1997], names)
    return panel.pivot_panel(long, names, 1997, base=base)


@query("filter_type", f"WITH {PANEL} SELECT * FROM panel WHERE entity_type = 'Group'")
def filter_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.filter_type(c.customer_panel(spark, sf_dir), "Group")


@query(
    "filter_off",
    f"""WITH {PANEL} SELECT * FROM panel
WHERE entity_type IS NOT NULL AND revenue IS NOT NULL AND quantity IS NOT NULL""",
)
def filter_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.setup_panel(c.customer_panel(spark, sf_dir), filter=False)


@query(
    "complete_rows",
    f"""WITH {PANEL} SELECT entity, revenue, n_orders, quantity FROM panel
WHERE revenue IS NOT NULL AND n_orders IS NOT NULL AND quantity IS NOT NULL""",
)
def complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.complete_rows(
        c.customer_panel(spark, sf_dir).select("entity", "revenue", "n_orders", "quantity")
    )


@query(
    "drop_column",
    f"WITH {PANEL} SELECT entity, entity_type, revenue, n_orders, quantity, acctbal FROM panel",
)
def drop_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.drop_columns(c.customer_panel(spark, sf_dir), "country")


@query(
    "residuals",
    f"""WITH {LINE} SELECT entity, revenue, round(prediction - revenue, 4) AS "LR_Res" FROM scored""",
)
def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = c.line_predictions(*c.model_rows(spark, sf_dir, stored=False))
    scored = metrics.add_residuals(scored, c.LABEL, {"LR": "prediction"})
    return rounded(scored.drop("prediction"), 4, "LR_Res")


@query(
    "relative_error",
    f"""WITH {LINE} SELECT entity, revenue,
  round((prediction - revenue) / nullif(revenue, 0), 6) AS "LR_MAPE" FROM scored""",
)
def relative_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = c.line_predictions(*c.model_rows(spark, sf_dir, stored=False))
    scored = metrics.add_relative_errors(scored, c.LABEL, {"LR": "prediction"})
    return rounded(scored.drop("prediction"), 6, "LR_MAPE")


@query(
    "predictor_target_split",
    f"""WITH {MODEL_ROWS}
SELECT 'predictors' AS part, concat_ws('|', CAST(n_orders AS BIGINT), CAST(quantity AS BIGINT),
  CAST(round(acctbal * 100) AS BIGINT)) AS "row" FROM train
UNION ALL SELECT 'target', CAST(CAST(round(revenue * 100) AS BIGINT) AS VARCHAR) FROM train""",
)
def predictor_target_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = c.model_rows(spark, sf_dir, stored=False)
    predictors, target = panel.split_predictors(train, c.LABEL, keys=["entity"])

    def whole(name: str, scale: int = 1) -> Column:
        return F.round(F.col(name) * scale).cast("bigint").cast("string")

    row = F.concat_ws("|", whole("n_orders"), whole("quantity"), whole("acctbal", 100))
    return predictors.select(F.lit("predictors").alias("part"), row.alias("row")).unionByName(
        target.select(F.lit("target").alias("part"), whole(c.LABEL, 100).alias("row"))
    )


@query(
    "exclude_topk",
    f"""WITH {PANEL} SELECT entity, revenue FROM panel WHERE entity NOT IN (
  SELECT entity FROM panel ORDER BY revenue DESC NULLS LAST, entity LIMIT 5)""",
)
def exclude_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.customer_panel(spark, sf_dir).select("entity", "revenue")
    return ranking.exclude_top_k(rows, "revenue", "entity", 5)


# --- joins --------------------------------------------------------------------


@query("entity_type_lookup", f"WITH {FACTS} SELECT entity, country, entity_type FROM entities")
def entity_type_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.entities(spark, sf_dir).select("entity", "country")
    return panel.tag_entity_type(rows, c.entity_types(spark, sf_dir), "country")


@query(
    "panel_join",
    f"""WITH {FACTS}
SELECT e.entity, f.revenue, f.n_orders, f.quantity, e.acctbal
FROM entities e LEFT JOIN facts f ON f.entity = e.entity AND f.year = 1997""",
)
def panel_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = materialize(c.long_form(spark, sf_dir, [1997]), "long-1997")
    wide = {name: panel.to_wide(long, name, [1997]) for name in c.NUMBERS}
    base = c.entities(spark, sf_dir).select("entity")
    return panel.join_panel(base, wide, 1997)


@query(
    "panel_bucketed",
    f"""WITH {FACTS}
SELECT e.entity, e.country, e.acctbal, a.revenue AS revenue_1996, a.n_orders AS n_orders_1996,
  b.revenue AS revenue_1997, b.n_orders AS n_orders_1997
FROM entities e LEFT JOIN facts a ON a.entity = e.entity AND a.year = 1996
LEFT JOIN facts b ON b.entity = e.entity AND b.year = 1997""",
)
def panel_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two years beside each other from one store; only the write shuffles."""
    facts = c.facts_store(spark, sf_dir)
    people = materialize_bucketed(c.entities(spark, sf_dir), "people", "entity")
    return panel.align_years(people, facts, [1996, 1997], ["revenue", "n_orders"])


@query(
    "align_predictions",
    f"""WITH {MODEL_ROWS},
lines AS (
  SELECT regr_slope(revenue, n_orders) AS s1, regr_intercept(revenue, n_orders) AS i1,
    regr_slope(revenue, quantity) AS s2, regr_intercept(revenue, quantity) AS i2 FROM train)
SELECT entity, revenue, round(i1 + s1 * n_orders, 4) AS by_orders, round(i2 + s2 * quantity, 4) AS by_quantity
FROM test, lines""",
)
def align_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of two models, stored apart and joined by entity without an exchange."""
    train, test = c.model_rows(spark, sf_dir)
    parts = []
    for x, name in (("n_orders", "by_orders"), ("quantity", "by_quantity")):
        keep = ("entity", c.LABEL) if not parts else ("entity",)
        found = c.line_predictions(train, test, x, keep).withColumnRenamed("prediction", name)
        parts.append(materialize_bucketed(found, "predictions", "entity"))
    return rounded(panel.align(*parts), 4, "by_orders", "by_quantity")


@query(
    "key_align",
    f"""WITH {FACTS}
SELECT e.entity, e.country, f.revenue AS before, g.revenue AS after
FROM entities e LEFT JOIN facts f ON f.entity = e.entity AND f.year = 1996
LEFT JOIN facts g ON g.entity = e.entity AND g.year = 1997""",
)
def key_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = c.entities(spark, sf_dir).select("entity", "country")
    before, after = (
        c.yearly_facts(spark, sf_dir, [year]).select("entity", F.col("revenue").alias(name))
        for year, name in ((1996, "before"), (1997, "after"))
    )
    return panel.align(base, before, after)


# --- aggregations and statistics ----------------------------------------------


def per_column(template: str, columns: tuple[str, ...] = c.NUMBERS, source: str = "panel") -> str:
    """The same aggregate row for every column, stacked."""
    return " UNION ALL ".join(template.format(c=name, source=source) for name in columns)


RANGES = """SELECT '{c}' AS "column", min({c}) AS "min", max({c}) AS "max",
 round(max({c}) - min({c}), 4) AS "range" FROM {source}"""


@query("column_ranges", f"WITH {PANEL} {per_column(RANGES)}")
def column_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.column_ranges(c.customer_panel(spark, sf_dir), c.NUMBERS), 4, "range")


@query(
    "column_ranges_by",
    f"WITH {PANEL} "
    + per_column(
        RANGES.replace("SELECT", "SELECT entity_type,", 1) + " GROUP BY entity_type"
    ),
)
def column_ranges_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.customer_panel(spark, sf_dir)
    return rounded(stats.column_ranges(rows, c.NUMBERS, by=["entity_type"]), 4, "range")


ARG_EXTREMES = """SELECT '{c}' AS "column",
 (SELECT entity FROM {source} WHERE {c} IS NOT NULL ORDER BY {c}, entity LIMIT 1) AS arg_min,
 (SELECT entity FROM {source} WHERE {c} IS NOT NULL ORDER BY {c} DESC, entity LIMIT 1) AS arg_max"""


@query("arg_extremes", f"WITH {PANEL} {per_column(ARG_EXTREMES)}")
def arg_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.arg_extremes(c.customer_panel(spark, sf_dir), "entity", c.NUMBERS)


@query(
    "arg_extremes_by",
    f"""WITH {PANEL} SELECT country, 'revenue' AS "column",
  first(entity ORDER BY revenue, entity) AS arg_min,
  first(entity ORDER BY revenue DESC, entity) AS arg_max
FROM panel WHERE revenue IS NOT NULL GROUP BY country""",
)
def arg_extremes_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.customer_panel(spark, sf_dir)
    return stats.arg_extremes(rows, "entity", ["revenue"], by=["country"])


ACCURACY = """avg(abs(prediction - revenue)) AS mae,
  100 * avg(abs(prediction - revenue) / nullif(revenue, 0)) AS mape,
  count(*) FILTER (revenue = 0) AS zero_labels"""


@query(
    "accuracy_metrics",
    f"""WITH {LINE}, m AS (SELECT {ACCURACY} FROM scored)
SELECT round(mae, 4) AS mae, round(mape, 4) AS mape, round(100 - mape, 4) AS accuracy, zero_labels FROM m""",
)
def accuracy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = c.line_predictions(*c.model_rows(spark, sf_dir, stored=False))
    return rounded(metrics.accuracy_metrics(scored, c.LABEL), 4, "mae", "mape", "accuracy")


REGRESSION = """count(*) AS n, round(sqrt(avg(pow(prediction - revenue, 2))), 4) AS rmse,
  round(1 - sum(pow(prediction - revenue, 2)) / nullif(var_pop(revenue) * count(*), 0), 6) AS r2"""


@query("regression_metrics", f"WITH {LINE} SELECT {REGRESSION} FROM scored")
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = c.line_predictions(*c.model_rows(spark, sf_dir, stored=False))
    return rounded(rounded(metrics.regression_metrics(scored, c.LABEL), 4, "rmse"), 6, "r2")


@query(
    "regression_metrics_by",
    f"""WITH {LINE} SELECT entity_type, {REGRESSION}
FROM scored JOIN entities USING (entity) GROUP BY entity_type""",
)
def regression_metrics_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = c.line_predictions(*c.model_rows(spark, sf_dir, stored=False))
    tagged = panel.tag_entity_type(
        panel.align(scored, c.entities(spark, sf_dir)), c.entity_types(spark, sf_dir), "country"
    )
    scores = metrics.regression_metrics(tagged, c.LABEL, by=["entity_type"])
    return rounded(rounded(scores, 4, "rmse"), 6, "r2")


def correlations(by: str = "") -> str:
    keep, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return " UNION ALL ".join(
        f"SELECT {keep}'{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM panel{group}"
        for a in c.NUMBERS
        for b in c.NUMBERS
    )


@query("correlation_matrix", f"WITH {PANEL} {correlations()}")
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.correlation_matrix(c.customer_panel(spark, sf_dir), c.NUMBERS), 6, "r")


@query("correlation_by", f"WITH {PANEL} {correlations('entity_type')}")
def correlation_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.customer_panel(spark, sf_dir)
    return rounded(stats.correlation_matrix(rows, c.NUMBERS, by=["entity_type"]), 6, "r")


MONTHS = [f"m{i}" for i in range(84)]


@query(
    "correlation_wide",
    """WITH monthly AS (
  SELECT o_custkey AS entity, 12 * (year(o_orderdate) - 1995) + month(o_orderdate) - 1 AS m,
    round(sum(o_totalprice), 2) AS v
  FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 2001 GROUP BY 1, 2),
pairs AS (
  SELECT a.m AS i, b.m AS j,
    CASE WHEN var_pop(a.v) > 1e-6 AND var_pop(b.v) > 1e-6 THEN corr(a.v, b.v) END AS r
  FROM monthly a JOIN monthly b USING (entity) GROUP BY 1, 2)
SELECT 'm' || x.i AS a, 'm' || y.i AS b, round(CASE WHEN x.i = y.i AND r IS NOT NULL THEN 1 ELSE r END, 5) AS r
FROM range(84) x(i), range(84) y(i) LEFT JOIN pairs ON pairs.i = x.i AND pairs.j = y.i""",
)
def correlation_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column per month: too many pairs for an expression each."""
    month = 12 * (F.year("o_orderdate") - 1995) + F.month("o_orderdate") - 1
    orders = c.table(spark, sf_dir, "orders").withColumn("month", month)
    cells = [F.round(F.sum(F.when(F.col("month") == i, F.col("o_totalprice"))), 2).alias(m) for i, m in enumerate(MONTHS)]
    wide = orders.where("month BETWEEN 0 AND 83").groupBy("o_custkey").agg(*cells)
    return rounded(stats.correlation_matrix(wide, MONTHS), 5, "r")


def binned(by: str = "") -> str:
    """Values with the bin whose edges hold them, per column and group."""
    key = f"{by}, " if by else ""
    on = "r.indicator = v.indicator" + (f" AND r.{by} IS NOT DISTINCT FROM v.{by}" if by else "")
    return f"""
vals AS ({unpivot_columns('panel', c.NUMBERS, f'entity, {by}' if by else 'entity')}),
ranges AS (
  SELECT {key}indicator, CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo,
         CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi
  FROM vals WHERE value IS NOT NULL GROUP BY {key}indicator),
edges AS (
  SELECT {key}indicator, CAST(i AS INTEGER) AS bin, lo + i * ((hi - lo) / 20) AS low,
         CASE WHEN i = 19 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 20) END AS high
  FROM ranges, range(20) t(i)),
binned AS (
  SELECT v.*, (SELECT max(bin) FROM edges r WHERE {on} AND r.low <= v.value) AS bin
  FROM vals v WHERE value IS NOT NULL)"""


@query(
    "histogram20",
    f"""WITH {PANEL}, {binned()}
SELECT e.indicator AS "column", e.bin, round(e.low, 4) AS low, round(e.high, 4) AS high, count(b.entity) AS n
FROM edges e LEFT JOIN binned b ON b.indicator = e.indicator AND b.bin = e.bin GROUP BY 1, 2, 3, 4""",
)
def histogram20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.histogram(c.customer_panel(spark, sf_dir), c.NUMBERS), 4, "low", "high")


@query(
    "histogram_by",
    f"""WITH {PANEL}, {binned('entity_type')}
SELECT e.entity_type, e.indicator AS "column", e.bin, round(e.low, 4) AS low, round(e.high, 4) AS high,
  count(b.entity) AS n
FROM edges e LEFT JOIN binned b ON b.indicator = e.indicator AND b.bin = e.bin
  AND b.entity_type IS NOT DISTINCT FROM e.entity_type
GROUP BY 1, 2, 3, 4, 5""",
)
def histogram_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.customer_panel(spark, sf_dir)
    return rounded(stats.histogram(rows, c.NUMBERS, by=["entity_type"]), 4, "low", "high")


DESCRIBE = """SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 4) AS mean,
 round(stddev_samp({c}), 4) AS stddev, min({c}) AS "min", max({c}) AS "max" FROM {source}"""


@query("describe_columns", f"WITH {PANEL} {per_column(DESCRIBE)}")
def describe_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.describe_columns(c.customer_panel(spark, sf_dir), c.NUMBERS)
    return rounded(rows, 4, "mean", "stddev")


LINEITEM_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "describe_lineitem_by",
    per_column(
        DESCRIBE.replace("SELECT", "SELECT l_returnflag,", 1) + " GROUP BY l_returnflag",
        LINEITEM_NUMBERS,
        "lineitem",
    ),
)
def describe_lineitem_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.table(spark, sf_dir, "lineitem")
    described = stats.describe_columns(rows, LINEITEM_NUMBERS, by=["l_returnflag"])
    return rounded(described, 4, "mean", "stddev")


# --- sorts, limits, positions -------------------------------------------------


@query(
    "rank_columns",
    f"""WITH {PANEL}, vals AS ({unpivot_columns('panel', c.NUMBERS)})
SELECT entity, indicator, value, row_number() OVER (
  PARTITION BY indicator ORDER BY value DESC NULLS LAST, entity) - 1 AS rank FROM vals""",
)
def rank_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_columns(c.customer_panel(spark, sf_dir), "entity", c.NUMBERS)


@query(
    "sorted_values",
    f"WITH {PANEL} SELECT entity, revenue FROM panel ORDER BY revenue DESC NULLS LAST, entity",
)
def sorted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.customer_panel(spark, sf_dir).select("entity", "revenue")
    return ranking.sorted_values(rows, "revenue", "entity")


@query(
    "top_k",
    f"WITH {PANEL} SELECT entity, quantity FROM panel ORDER BY quantity DESC NULLS LAST, entity LIMIT 20",
)
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.customer_panel(spark, sf_dir).select("entity", "quantity")
    return ranking.top_k(rows, "quantity", "entity", 20)


@query(
    "bottom_k",
    f"""WITH {PANEL} SELECT entity, quantity FROM panel WHERE quantity IS NOT NULL
ORDER BY quantity, entity DESC LIMIT 20""",
)
def bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.customer_panel(spark, sf_dir).select("entity", "quantity")
    return ranking.bottom_k(rows, "quantity", "entity", 20)


@query(
    "bottom_k_with_missing",
    f"""WITH {PANEL} SELECT entity, quantity FROM panel
ORDER BY quantity NULLS FIRST, entity DESC LIMIT 20""",
)
def bottom_k_with_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.customer_panel(spark, sf_dir).select("entity", "quantity")
    return ranking.bottom_k(rows, "quantity", "entity", 20, include_missing=True)


@query(
    "ordinal_index",
    f"""WITH {PANEL} SELECT entity, revenue, row_number() OVER (ORDER BY entity) - 1 AS position
FROM panel WHERE revenue IS NOT NULL""",
)
def ordinal_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.customer_panel(spark, sf_dir).select("entity", "revenue").where("revenue IS NOT NULL")
    return ranking.ordinal_index(rows, "entity")


# --- reshape and chart data ---------------------------------------------------


@query(
    "feature_vector",
    f"""WITH {MODEL_ROWS}
SELECT entity, revenue, n_orders AS f0, quantity AS f1, acctbal AS f2 FROM train""",
)
def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    train, _ = c.model_rows(spark, sf_dir, stored=False)
    table = models.feature_vector(train, c.PREDICTORS, c.LABEL, "entity")
    values = vector_to_array("features")
    return table.select("entity", c.LABEL, *[values[i].alias(f"f{i}") for i in range(3)])


def scaled(over: str = "") -> str:
    return ", ".join(
        f"round(({n} - min({n}) OVER ({over})) / nullif(max({n}) OVER ({over}) - min({n}) OVER ({over}), 0), 6) AS {n}"
        for n in c.NUMBERS
    )


@query("minmax_scale", f"WITH {PANEL} SELECT entity, {scaled()} FROM panel")
def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.customer_panel(spark, sf_dir).select("entity", *c.NUMBERS)
    return rounded(stats.minmax_scale(rows, c.NUMBERS), 6, *c.NUMBERS)


@query(
    "minmax_scale_by",
    f"WITH {PANEL} SELECT entity, country, {scaled('PARTITION BY country')} FROM panel",
)
def minmax_scale_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.customer_panel(spark, sf_dir).select("entity", "country", *c.NUMBERS)
    return rounded(stats.minmax_scale(rows, c.NUMBERS, by=["country"]), 6, *c.NUMBERS)


@query(
    "chart_series",
    f"""WITH {PANEL} SELECT entity, 'Revenue' AS series, revenue AS y FROM panel
UNION ALL SELECT entity, 'Quantity', quantity FROM panel""",
)
def chart_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.customer_panel(spark, sf_dir)
    return charts.chart_series(rows, "entity", {"Revenue": "revenue", "Quantity": "quantity"})


@query("xy_pairs", f"WITH {PANEL} SELECT entity, n_orders AS x, revenue AS y FROM panel")
def xy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.xy_pairs(c.customer_panel(spark, sf_dir), "n_orders", "revenue", "entity")


def x_buckets(points: str, n: int) -> str:
    """Points ``(x, y)`` with the bucket whose edges hold their x."""
    return f"""
points AS ({points}),
span AS (
  SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
         CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM points),
edges AS (
  SELECT CAST(i AS INTEGER) AS bucket, lo + i * ((hi - lo) / {n}) AS low FROM span, range({n}) t(i)),
placed AS (
  SELECT x, y, (SELECT max(bucket) FROM edges WHERE low <= x) AS bucket FROM points)"""


@query(
    "xy_buckets",
    f"""WITH {PANEL}, {x_buckets('SELECT revenue AS x, acctbal AS y FROM panel', 50)}
SELECT bucket, count(y) AS n, count(*) - count(y) AS n_missing, min(x) AS x_low, max(x) AS x_high,
  round(avg(y), 6) AS y_mean, CASE WHEN bucket IS NOT NULL THEN arg_min(y, {{x: x, y: y}}) END AS y_first,
  CASE WHEN bucket IS NOT NULL THEN arg_max(y, {{x: x, y: y}}) END AS y_last,
  min(y) AS y_low, max(y) AS y_high
FROM placed GROUP BY bucket""",
)
def xy_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.customer_panel(spark, sf_dir)
    return rounded(charts.xy_buckets(rows, "revenue", "acctbal", 50), 6, "y_mean")


ORDER_POINTS = """SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS x,
  o_totalprice AS y FROM orders WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL"""


@query(
    "xy_outline",
    f"""WITH {x_buckets(ORDER_POINTS, 200)},
chosen AS (
  SELECT bucket, min({{x: x, y: y}}) AS a, max({{x: x, y: y}}) AS b,
    arg_min({{x: x, y: y}}, {{y: y, x: x}}) AS c, arg_max({{x: x, y: y}}, {{y: y, x: -x}}) AS d
  FROM placed GROUP BY bucket)
SELECT DISTINCT bucket, p.x AS x, p.y AS y FROM (SELECT bucket, unnest([a, b, c, d]) AS p FROM chosen)""",
)
def xy_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = c.table(spark, sf_dir, "orders").withColumn(
        "day", F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).cast("double")
    )
    return charts.xy_outline(orders, "day", "o_totalprice", 200)


@query(
    "month_label",
    """SELECT strftime(o_orderdate, '%Y-%m') AS label, o_totalprice AS y, o_orderkey FROM orders""",
)
def month_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = charts.date_label(c.table(spark, sf_dir, "orders"), "o_orderdate")
    return labelled.select("label", F.col("o_totalprice").alias("y"), "o_orderkey")


PAIRS = [(a, b) for i, a in enumerate(c.NUMBERS) for b in c.NUMBERS[i + 1 :]]


@query(
    "pair_bins",
    f"WITH {PANEL}, {binned()} "
    + " UNION ALL ".join(
        f"""SELECT '{a}' AS a, '{b}' AS b, p.bin AS xbin, q.bin AS ybin, count(*) AS n
FROM binned p JOIN binned q ON p.entity = q.entity AND p.indicator = '{a}' AND q.indicator = '{b}'
GROUP BY 1, 2, 3, 4"""
        for a, b in PAIRS
    ),
)
def pair_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.pair_bins(c.customer_panel(spark, sf_dir), c.NUMBERS)


COORDS = """SELECT entity, '{c}' AS axis, {c} AS value,
 (SELECT min({c}) FROM {source}) AS axis_min, (SELECT max({c}) FROM {source}) AS axis_max,
 revenue AS color, (SELECT min(revenue) FROM {source}) AS color_min,
 (SELECT max(revenue) FROM {source}) AS color_max FROM {source}"""


@query(
    "parallel_coords",
    f"""WITH {PANEL}, complete AS (SELECT * FROM panel WHERE entity_type = 'Country' AND quantity IS NOT NULL)
{per_column(COORDS, source='complete')}""",
)
def parallel_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel.setup_panel(c.customer_panel(spark, sf_dir))
    return charts.parallel_coords(rows, "entity", c.NUMBERS, c.LABEL)


RANKED = ", ".join(
    f"row_number() OVER (ORDER BY {n} DESC NULLS LAST, entity) - 1 AS {n}" for n in c.NUMBERS
)


@query(
    "parallel_coords_ranked",
    f"""WITH {PANEL}, ranked AS (SELECT entity, {RANKED} FROM panel
  WHERE entity_type = 'Country' AND quantity IS NOT NULL)
{per_column(COORDS, source='ranked')}""",
)
def parallel_coords_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel.setup_panel(c.customer_panel(spark, sf_dir))
    return charts.parallel_coords(rows, "entity", c.NUMBERS, c.LABEL, ranking=True)


@query(
    "holdout_split",
    f"""WITH {MODEL_ROWS}
SELECT 'train' AS part, entity, revenue, n_orders, quantity, acctbal FROM train
UNION ALL SELECT 'test', entity, revenue, n_orders, quantity, acctbal FROM test""",
)
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = c.model_rows(spark, sf_dir, stored=False)
    return train.withColumn("part", F.lit("train")).unionByName(
        test.withColumn("part", F.lit("test"))
    )
