"""The customer panel against pandas, and its plans."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelweave.plans import customers as c

SF = "/root/testdata/sf0.001"


def facts(years):
    orders = pd.read_parquet(f"{SF}/orders.parquet")
    lines = pd.read_parquet(f"{SF}/lineitem.parquet")
    per_order = lines.groupby("l_orderkey")["l_quantity"].sum().rename("q")
    rows = orders.join(per_order, on="o_orderkey")
    rows["year"] = rows["o_orderdate"].dt.year
    rows = rows[rows["year"].isin(years)]
    grouped = rows.groupby(["o_custkey", "year"])
    return {
        key: (round(g["o_totalprice"].sum(), 2), float(len(g)), g["q"].sum(min_count=1))
        for key, g in grouped
    }


@pytest.mark.parametrize("years", [[1996], [1996, 1997], [1995, 1998, 2001]])
def test_yearly_facts_equal_pandas(spark, years):
    found = {
        (r["entity"], r["year"]): (r["revenue"], r["n_orders"], r["quantity"])
        for r in c.yearly_facts(spark, SF, years).collect()
    }
    wanted = facts(years)
    assert set(found) == set(wanted)
    for key, (revenue, n, quantity) in wanted.items():
        assert found[key][:2] == (pytest.approx(revenue), n)
        assert found[key][2] == (None if pd.isna(quantity) else pytest.approx(quantity))


def test_known_sizes(spark):
    panel = c.customer_panel(spark, SF)
    numbers = panel.select("revenue", "n_orders", "quantity")
    assert panel.count() == 150
    assert panel.where("revenue is null").count() == 29
    assert numbers.na.drop().count() == 121


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_year_and_columns_reach_the_scan(spark):
    plan = executed(c.yearly_facts(spark, SF, [1996]))
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01" in plan
    assert "LessThan(o_orderdate,1997-01-01" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_lineitem_is_not_read_for_revenue_alone(spark):
    long = c.long_form(spark, SF, [1996], ["revenue"])
    assert "l_quantity" not in executed(long)


def test_one_year_joins_customers_without_another_shuffle(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        entities = c.table(spark, SF, "customer").select(F.col("c_custkey").alias("entity"))
        facts = c.yearly_facts(spark, SF, [1996]).select("entity", "revenue")
        plan = executed(entities.join(facts, "entity", "left"))
        assert plan.count("Exchange hashpartitioning") == 2  # one per side
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


@pytest.fixture(scope="module")
def moved(spark, tmp_path_factory):
    """The tables with some orders outside the usual years and one without a date."""
    folder = str(tmp_path_factory.mktemp("moved"))
    for name in ("customer", "nation", "lineitem"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    key, date = F.col("o_orderkey"), F.col("o_orderdate")
    early = F.when(key % 10 == 0, date - F.expr("INTERVAL 9 YEARS"))
    late = early.when(key % 10 == 1, date + F.expr("INTERVAL 5 YEARS")).otherwise(date)
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    first = orders.agg(F.min("o_orderkey")).first()[0]
    orders.withColumn("o_orderdate", F.when(key != first, late)).coalesce(1).write.parquet(
        f"{folder}/orders.parquet"
    )
    return folder


@pytest.mark.parametrize(
    "name", ["multi_indicator_long", "scan_indicator", "year_slice", "indicator_catalog", "long_store"]
)
def test_no_year_is_left_out(spark, moved, name):
    import duckdb
    from checking import compare

    import __spark_entry__ as contract

    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in ("customer", "nation", "lineitem", "orders"):
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{moved}/{table}.parquet/*.parquet')"
        )
    check = contract.oracle_sql()[name]
    assert compare(spark, connection, contract.queries()[name], check, moved) == []


def test_panel_join_reads_one_year_once(spark):
    from panelweave.plans import queries

    stored = []
    keep, queries.materialize = queries.materialize, lambda df, label: stored.append(df) or keep(df, label)
    try:
        queries.panel_join(spark, SF)
    finally:
        queries.materialize = keep
    plan = executed(stored[0])
    assert plan.count("PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate,1997-01-01") == 1


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_orders_of_a_year_filter_line_items_before_their_shuffle(spark):
    """With the settings in the README, lineitem rows of other years stop at the scan."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
        "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "100MB",
    }
    before = c.yearly_facts(spark, SF, [1996]).collect()
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        facts = c.yearly_facts(spark, SF, [1996])
        plan = facts._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.index("l_orderkey") :]
        assert "might_contain" in below
        assert sorted(facts.collect()) == sorted(before)
    finally:
        for name in settings:
            spark.conf.unset(name)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_bucketed_years_and_predictions_join_without_an_exchange(spark, no_broadcast):
    from panelweave.functions.storage import materialize_bucketed
    from panelweave.operators import panel

    facts = c.facts_store(spark, SF)
    people = materialize_bucketed(c.entities(spark, SF), "people", "entity")
    joined = panel.align_years(people, facts, [1996, 1997], ["revenue"])
    predicted = materialize_bucketed(facts.where("year = 1997").select("entity", F.col("revenue").alias("p")), "p", "entity")
    joined = panel.align(joined, predicted)
    plan = plan_of(joined)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    # Each year reads its own folder.
    assert plan.count("PartitionFilters: [isnotnull(year") == 2
    shuffled = panel.align_years(
        c.entities(spark, SF), c.yearly_facts(spark, SF), [1996, 1997], ["revenue"]
    )
    assert "Exchange hashpartitioning" in plan_of(shuffled)
    assert sorted(map(str, joined.drop("p").collect())) == sorted(map(str, shuffled.collect()))


def test_a_repeated_row_of_a_year_fails(spark):
    from panelweave.operators import panel

    facts = spark.createDataFrame([(1, 1996, 2.0), (1, 1996, 3.0)], "entity long, year int, revenue double")
    base = spark.createDataFrame([(1,), (2,)], "entity long")
    with pytest.raises(Exception, match="duplicate row for 1"):
        panel.align_years(base, facts, [1996], ["revenue"]).collect()
    assert sorted(map(tuple, panel.align_years(base, facts, [1997], ["revenue"]).collect())) == [(1, None), (2, None)]


def test_buckets_are_one_file_each(spark):
    from panelweave.functions.storage import materialize_bucketed

    stored = materialize_bucketed(spark.range(1000).withColumnRenamed("id", "a.b"), "ids", "a.b", buckets=4)
    assert stored.count() == 1000 and len(stored.inputFiles()) == 4


def test_bands_are_few(spark):
    rows = c.banded(c.model_rows(spark, SF, stored=False)[0])
    for name in c.BANDS:
        assert rows.select(name).distinct().count() <= 11
