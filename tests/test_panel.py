import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelweave.operators import panel

LONG = "entity string, indicator string, year int, value double"
ROWS = [
    ("a", "x", 2013, 1.0),
    ("a", "y", 2013, 2.0),
    ("a", "x", 2014, 3.0),
    ("b", "x", 2013, 4.0),
    ("c", "y", 2013, 5.0),
]


@pytest.fixture
def long(spark):
    return spark.createDataFrame(ROWS, LONG)


def test_pivot_rows_are_those_of_the_first_indicator(long):
    rows = panel.pivot_panel(long, {"ex": "x", "why": "y"}, 2013).collect()
    assert sorted(rows) == [("a", 1.0, 2.0), ("b", 4.0, None)]


def test_pivot_with_a_base(spark, long):
    base = spark.createDataFrame([("a",), ("z",), ("c",)], "entity string")
    rows = panel.pivot_panel(long, ["x", "y"], 2013, base=base).collect()
    assert sorted(rows, key=lambda r: r[0]) == [("a", 1.0, 2.0), ("c", None, 5.0), ("z", None, None)]


def test_pivot_of_several_years(long):
    rows = panel.pivot_panel(long, ["x"], [2013, 2014]).collect()
    assert sorted(rows) == [("a", 2013, 1.0), ("a", 2014, 3.0), ("b", 2013, 4.0)]


def test_pivot_carries_columns_of_the_first_indicator(long):
    named = long.withColumn("name", F.concat(F.col("indicator"), F.col("entity")))
    rows = panel.pivot_panel(named, ["x", "y"], 2013, carry=["name"]).collect()
    assert {r["entity"]: r["name"] for r in rows} == {"a": "xa", "b": "xb"}


def test_pivot_keeps_an_entity_whose_first_value_is_missing(spark):
    long = spark.createDataFrame([("a", "x", 1, None), ("a", "y", 1, 2.0)], LONG)
    assert panel.pivot_panel(long, ["x", "y"], 1).collect() == [("a", None, 2.0)]


@pytest.mark.parametrize("value", [1.0, 9.0, None])
def test_duplicate_cell_raises(spark, value):
    long = spark.createDataFrame([*ROWS, ("a", "x", 2013, value)], LONG)
    with pytest.raises(PySparkException, match="duplicate row for a"):
        panel.pivot_panel(long, ["x"], 2013).collect()
    with pytest.raises(PySparkException, match="duplicate row for a"):
        panel.to_wide(long, "x", [2013]).collect()


def test_pivot_shuffles_once(long):
    plan = panel.pivot_panel(long, ["x", "y"], 2013)._jdf.queryExecution().sparkPlan().toString()
    executed = panel.pivot_panel(long, ["x", "y"], 2013)._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange") == 1 and "HashAggregate" in plan


def test_join_equals_pivot(spark, long):
    wide = {n: panel.to_wide(long, n, [2013, 2014]) for n in ("x", "y")}
    base = wide["x"].select("entity")
    joined = panel.join_panel(base, wide, 2013)
    assert sorted(joined.collect()) == sorted(panel.pivot_panel(long, ["x", "y"], 2013).collect())


def test_join_raises_on_a_repeated_entity(spark):
    wide = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "entity string, `2013` double")
    base = spark.createDataFrame([("a",)], "entity string")
    with pytest.raises(PySparkException, match="duplicate row"):
        panel.join_panel(base, {"x": wide}, 2013).collect()


def test_lookup_misses_give_null(spark):
    df = spark.createDataFrame([("Aland",), ("aland",), (None,)], "name string")
    lookup = spark.createDataFrame([("Aland", "Country"), ("World", "Group")], "entity string, entity_type string")
    rows = panel.tag_entity_type(df, lookup, "name").collect()
    assert {r["name"]: r["entity_type"] for r in rows} == {"Aland": "Country", "aland": None, None: None}


def test_duplicate_lookup_raises(spark):
    df = spark.createDataFrame([("a",)], "name string")
    lookup = spark.createDataFrame([("a", "Country"), ("a", "Country")], "entity string, entity_type string")
    with pytest.raises(PySparkException, match="duplicate entity"):
        panel.tag_entity_type(df, lookup, "name").collect()


def test_any_missing_cell_drops_the_row(spark):
    columns = ["Country", "CountryType", "x", "y"]
    full = ["a", "Country", 1.0, 2.0]
    rows = [full] + [full[:i] + [None] + full[i + 1 :] for i in range(4)] + [["n", "Country", float("nan"), 1.0]]
    df = spark.createDataFrame(rows, "Country string, CountryType string, x double, y double")
    assert df.columns == columns
    assert panel.complete_rows(df).collect() == [tuple(full)]


def test_setup_with_and_without_the_type_filter(spark):
    df = spark.createDataFrame(
        [("a", "Country", 1.0), ("g", "Group", 2.0), ("u", None, 3.0), ("m", "Country", None)],
        "entity string, entity_type string, x double",
    )
    assert {r["entity"] for r in panel.setup_panel(df).collect()} == {"a"}
    assert {r["entity"] for r in panel.setup_panel(df, entity_type="Group").collect()} == {"g"}
    assert {r["entity"] for r in panel.setup_panel(df, filter=False).collect()} == {"a", "g"}


def test_year_slice_of_wide_and_long(spark, long):
    assert panel.year_slice(long, 2014).collect() == [("a", "x", 3.0)]
    wide = panel.to_wide(long, "x", [2013, 2014])
    assert sorted(panel.year_slice(wide, 2013).collect()) == [("a", 1.0), ("b", 4.0)]


def test_drop_columns_checks_names(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert panel.drop_columns(df, "a").columns == ["b"]
    with pytest.raises(ValueError, match="no such"):
        panel.drop_columns(df, "z")


def test_split_and_holdout(spark, long):
    df = spark.createDataFrame([("a", "Country", 1.0, 2.0)], "entity string, entity_type string, x double, y double")
    predictors, target = panel.split_predictors(df, "y")
    assert predictors.columns == ["x"] and target.columns == ["y"]
    train, test = panel.holdout_split(panel.pivot_panel(long, ["x"], [2013, 2014]), 2013, 2014)
    assert sorted(train.collect()) == [("a", 1.0), ("b", 4.0)] and test.collect() == [("a", 3.0)]


def test_align_keeps_the_left_rows(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2)], "entity string, x int")
    right = spark.createDataFrame([("b", 3), ("c", 4)], "entity string, y int")
    assert sorted(panel.align(left, right).collect()) == [("a", 1, None), ("b", 2, 3)]


def test_pivot_by_dotted_codes(spark):
    long = spark.createDataFrame([("a", "SP.POP", 2013, 1.0), ("a", "EN.CO2", 2013, 2.0)], LONG)
    panel_rows = panel.pivot_panel(long, ["SP.POP", "EN.CO2"], 2013)
    assert panel_rows.columns == ["entity", "SP.POP", "EN.CO2"] and panel_rows.collect() == [("a", 1.0, 2.0)]
    assert panel.pivot_panel(long, ["SP.POP"], [2013]).collect() == [("a", 2013, 1.0)]
