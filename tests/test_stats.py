import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelweave.operators import charts, metrics, ranking, stats

QUICK = settings(
    max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
VALUES = st.lists(st.one_of(st.none(), st.integers(-20, 20).map(lambda i: i / 4)), min_size=1, max_size=40)


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "k bigint, v double")


# --- ranges, extremes, describe ---


def test_ranges_and_extremes(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 3.0), ("c", 1.0), ("d", None), ("e", 1.0)], "k string, v double")
    assert stats.column_ranges(df, ["v"]).collect() == [("v", 1.0, 3.0, 2.0)]
    assert stats.arg_extremes(df, "k", ["v"]).collect() == [("v", "c", "a")]


def test_statistics_of_an_empty_column(spark):
    df = frame(spark, [None, None])
    assert stats.column_ranges(df, ["v"]).collect() == [("v", None, None, None)]
    assert stats.arg_extremes(df, "k", ["v"]).collect() == [("v", None, None)]
    assert stats.describe_columns(df, ["v"]).collect()[0]["count"] == 0
    assert stats.histogram(df, ["v"]).count() == 0


@QUICK
@given(values=VALUES)
def test_describe_equals_pandas(spark, values):
    row = stats.describe_columns(frame(spark, values), ["v"]).collect()[0]
    series = pd.Series(values, dtype=float)
    for name, wanted in zip(
        ("count", "mean", "stddev", "min", "max"),
        (series.count(), series.mean(), series.std(), series.min(), series.max()),
    ):
        if math.isnan(wanted):
            assert row[name] is None
        else:
            assert row[name] == pytest.approx(wanted)


# --- correlation ---


def test_correlation_equals_pandas_with_missing_values(spark):
    rng = np.random.default_rng(3)
    data = pd.DataFrame(rng.normal(size=(60, 3)), columns=["x", "y", "z"])
    data["y"] += data["x"]
    data.loc[::7, "x"] = np.nan
    data.loc[::5, "z"] = np.nan
    rows = [tuple(None if math.isnan(v) else v for v in r) for r in data.itertuples(index=False)]
    df = spark.createDataFrame([tuple(map(lambda v: None if v is None else float(v), r)) for r in rows], "x double, y double, z double")
    found = {(r["a"], r["b"]): r["r"] for r in stats.correlation_matrix(df, ["x", "y", "z"]).collect()}
    wanted = data.corr()
    assert len(found) == 9
    for (a, b), r in found.items():
        assert r == pytest.approx(wanted.loc[a, b])


def test_correlation_of_a_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, c double")
    found = {(r["a"], r["b"]): r["r"] for r in stats.correlation_matrix(df, ["x", "c"]).collect()}
    assert found == {("x", "x"): 1.0, ("x", "c"): None, ("c", "x"): None, ("c", "c"): None}


# --- histograms ---


def counts(rows):
    return [r["n"] for r in sorted(rows, key=lambda r: r["bin"])]


@QUICK
@given(values=VALUES, bins=st.sampled_from([1, 3, 7, 20]))
def test_histogram_equals_numpy(spark, values, bins):
    present = [v for v in values if v is not None]
    rows = stats.histogram(frame(spark, values), ["v"], bins).collect()
    if not present:
        assert rows == []
        return
    wanted, edges = np.histogram(present, bins=bins)
    assert counts(rows) == list(wanted)
    low = [r["low"] for r in sorted(rows, key=lambda r: r["bin"])]
    assert low == pytest.approx(list(edges[:-1]))


def test_histogram_equals_numpy_on_awkward_edges(spark):
    values = [i / 10 for i in range(1, 4000)] + [0.1 * i for i in range(300)]
    rows = stats.histogram(frame(spark, values), ["v"]).collect()
    assert counts(rows) == list(np.histogram(values, bins=20)[0])


def test_histogram_of_a_constant_column_uses_one_bin(spark):
    rows = stats.histogram(frame(spark, [5.0] * 3), ["v"]).collect()
    assert counts(rows) == list(np.histogram([5.0] * 3, bins=20)[0])
    assert sum(n > 0 for n in counts(rows)) == 1


def test_histogram_by_group_equals_one_per_group(spark):
    df = frame(spark, [float(i * i % 37) for i in range(200)]).withColumn(
        "g", F.when(F.col("k") % 3 > 0, F.col("k") % 3)
    )
    found = stats.histogram(df, ["v"], 5, by=["g"]).collect()
    for g in (None, 1, 2):
        part = df.where(F.col("g").eqNullSafe(F.lit(g)))
        assert counts([r for r in found if r["g"] == g]) == counts(stats.histogram(part, ["v"], 5).collect())


def test_pair_bins_equal_numpy(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(500, 2))
    df = spark.createDataFrame([(float(x), float(y)) for x, y in data], "x double, y double")
    wanted, _, _ = np.histogram2d(data[:, 0], data[:, 1], bins=20)
    found = np.zeros((20, 20))
    for r in charts.pair_bins(df, ["x", "y"]).collect():
        assert (r["a"], r["b"]) == ("x", "y")
        found[r["xbin"], r["ybin"]] = r["n"]
    assert (found == wanted).all()


# --- scaling ---


def test_minmax_scale(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (2.0, 5.0), (None, 5.0)], "x double, c double")
    rows = stats.minmax_scale(df, ["x", "c"]).collect()
    assert sorted(rows, key=lambda r: (r["x"] is None, r["x"])) == [(0.0, None), (0.5, None), (1.0, None), (None, None)]


# --- positions, top and bottom ---


@QUICK
@given(values=VALUES)
def test_rank_is_the_place_in_descending_order(spark, values):
    found = {r["k"]: r["rank"] for r in ranking.rank_columns(frame(spark, values), "k", ["v"]).collect()}
    order = sorted(range(len(values)), key=lambda i: (values[i] is None, -(values[i] or 0.0), i))
    assert found == {k: place for place, k in enumerate(order)}


def test_rank_over_many_partitions_with_a_hot_value_and_groups(spark):
    df = spark.range(0, 4000, 1, 7).select(
        F.col("id").alias("k"),
        F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise((F.col("id") * 37 % 1001).cast("double")).alias("v"),
        F.when(F.col("id") % 10 > 1, F.lit("hot")).when(F.col("id") % 10 == 0, F.lit("cold")).alias("g"),
    )
    placed = ranking.number_rows(df, ranking.descending("v", "k"), by=["g"]).collect()
    rows = {r["k"]: r for r in df.collect()}
    for g in ("hot", "cold", None):
        order = sorted((k for k, r in rows.items() if r["g"] == g), key=lambda k: (-rows[k]["v"], k))
        assert {r["k"]: r["position"] for r in placed if r["g"] == g} == {k: i for i, k in enumerate(order)}


def test_no_window_over_the_rows(spark):
    """Rows are numbered in their partitions; the window sees one row per block."""
    df = spark.range(0, 5000, 1, 6).select(F.col("id").alias("k"))
    placed = ranking.ordinal_index(df, "k")
    blocks = placed._jdf.queryExecution().optimizedPlan().toString()
    assert blocks.count("Window [") == 1
    assert "Aggregate [_part" in blocks[blocks.index("Window [") :]


def test_top_and_bottom_with_ties_and_missing(spark):
    df = frame(spark, [3.0, 3.0, 1.0, None, None])
    keys = lambda d: [r["k"] for r in d.collect()]
    assert keys(ranking.sorted_values(df, "v", "k")) == [0, 1, 2, 3, 4]
    assert keys(ranking.top_k(df, "v", "k", 2)) == [0, 1]
    assert keys(ranking.top_k(df, "v", "k", 99)) == [0, 1, 2, 3, 4]
    assert keys(ranking.top_k(df, "v", "k", 0)) == []
    assert keys(ranking.bottom_k(df, "v", "k", 2)) == [1, 2]
    assert keys(ranking.bottom_k(df, "v", "k", 3, include_missing=True)) == [2, 3, 4]
    assert keys(ranking.bottom_k(df, "v", "k", 0)) == []
    assert keys(ranking.bottom_k(df, "v", "k", 99)) == [0, 1, 2]


def test_exclude_top_k(spark):
    df = frame(spark, [5.0, 9.0, 1.0, None, 7.0])
    assert sorted(r["k"] for r in ranking.exclude_top_k(df, "v", "k", 2).collect()) == [0, 2, 3]


# --- chart tables ---


def test_series_keep_missing_points(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, 3.0, 4.0)], "x int, a double, b double")
    rows = charts.chart_series(df, "x", {"A": "a", "B": "b"}).collect()
    assert sorted(rows, key=lambda r: (r["series"], r["x"])) == [
        (1, "A", 2.0), (2, "A", 3.0), (1, "B", None), (2, "B", 4.0),
    ]


def test_xy_and_month_labels(spark):
    df = spark.createDataFrame([("k", 1.0, 2.0)], "k string, a double, b double")
    assert charts.xy_pairs(df, "a", "b", "k").collect() == [("k", 1.0, 2.0)]
    assert charts.xy_pairs(df.withColumnRenamed("k", "k.k"), "a", "b", "k.k").columns == ["k.k", "x", "y"]
    dated = spark.sql("select timestamp_ntz '1996-03-31 23:59:59' as t")
    assert charts.date_label(dated, "t").collect()[0]["label"] == "1996-03"


@pytest.mark.parametrize("by_rank", [False, True])
def test_parallel_coordinates(spark, by_rank):
    df = spark.createDataFrame([("a", 10.0, 1.0), ("b", 30.0, 2.0), ("c", 20.0, 3.0)], "k string, x double, y double")
    rows = {(r["k"], r["axis"]): r for r in charts.parallel_coords(df, "k", ["x", "y"], "x", by_rank).collect()}
    assert len(rows) == 6
    point = rows["b", "y"]
    if by_rank:
        assert (point["value"], point["axis_min"], point["axis_max"], point["color"]) == (1, 0, 2, 0)
    else:
        assert (point["value"], point["axis_min"], point["axis_max"], point["color"]) == (2.0, 1.0, 3.0, 30.0)
    assert (point["color_min"], point["color_max"]) == ((0, 2) if by_rank else (10.0, 30.0))


# --- metrics ---


def test_metrics_formulas(spark):
    rows = [(10.0, 12.0), (20.0, 18.0), (-5.0, -4.0)]
    df = spark.createDataFrame(rows, "y double, prediction double")
    y, p = np.array(rows).T
    accuracy = metrics.accuracy_metrics(df, "y").collect()[0]
    assert accuracy["mae"] == pytest.approx(np.mean(abs(p - y)))
    assert accuracy["mape"] == pytest.approx(100 * np.mean(abs(p - y) / y))
    assert accuracy["accuracy"] == pytest.approx(100 - accuracy["mape"])
    scores = metrics.regression_metrics(df, "y").collect()[0]
    assert scores["rmse"] == pytest.approx(np.sqrt(np.mean((p - y) ** 2)))
    assert scores["r2"] == pytest.approx(1 - ((p - y) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_zero_label_has_no_relative_error(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 3.0), (4.0, 4.0)], "y double, p double")
    rows = metrics.add_relative_errors(metrics.add_residuals(df, "y", {"M": "p"}), "y", {"M": "p"}).collect()
    assert [(r["M_Res"], r["M_MAPE"]) for r in rows] == [(1.0, None), (1.0, 0.5), (0.0, 0.0)]
    row = metrics.accuracy_metrics(df, "y", "p").collect()[0]
    assert row["mape"] == pytest.approx(25.0) and row["zero_labels"] == 1


def test_exact_line_scores_perfectly(spark):
    df = spark.createDataFrame([(float(x), 2.0 * x + 1) for x in range(10)], "x double, y double")
    scored = df.withColumn("prediction", 2 * F.col("x") + 1)
    assert metrics.regression_metrics(scored, "y").collect() == [(10, 0.0, 1.0)]
    constant = scored.withColumn("y", F.lit(4.0))
    assert metrics.regression_metrics(constant, "y").collect()[0]["r2"] is None


def test_metrics_by_group_and_model(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 1.0, 2.0), ("a", 3.0, 3.0, 2.0), ("b", 5.0, 5.0, 9.0)],
        "g string, y double, good double, bad double",
    )
    grouped = {r["g"]: r for r in metrics.regression_metrics(df, "y", "bad", by=["g"]).collect()}
    assert grouped["a"]["rmse"] == 1.0 and grouped["b"]["rmse"] == 4.0
    ranked = metrics.model_metrics(df, "y", {"G": "good", "B": "bad"}).collect()
    assert [r["model"] for r in ranked] == ["G", "B"] and ranked[0]["rmse"] == 0.0


# --- names with dots, empty tables ---

DOTTED = ["SP.POP TOTL", "x`y"]


def test_column_names_may_hold_dots_and_quotes(spark):
    df = spark.createDataFrame([("a", 1.0, 4.0, "g"), ("b", 3.0, None, "g"), ("c", 2.0, 6.0, "h")], ["k.1", *DOTTED, "g.1"])
    first, second = DOTTED
    ranges = {r["column"]: r["range"] for r in stats.column_ranges(df, DOTTED).collect()}
    assert ranges == {first: 2.0, second: 2.0}
    assert {r["g.1"] for r in stats.column_ranges(df, DOTTED, by=["g.1"]).collect()} == {"g", "h"}
    extremes = {r["column"]: r["arg_max"] for r in stats.arg_extremes(df, "k.1", DOTTED).collect()}
    assert extremes == {first: "b", second: "c"}
    assert stats.describe_columns(df, DOTTED).count() == 2
    assert stats.correlation_matrix(df, DOTTED).where("r is not null").count() == 4
    assert stats.histogram(df, DOTTED, 2, by=["g.1"]).count() == 8
    assert stats.minmax_scale(df, DOTTED).columns == df.columns
    assert charts.pair_bins(df, DOTTED).agg(F.sum("n")).collect()[0][0] == 2
    ranks = {(r["k.1"], r["indicator"]): r["rank"] for r in ranking.rank_columns(df, "k.1", DOTTED).collect()}
    assert ranks["b", first] == 0 and ranks["b", second] == 2
    placed = ranking.number_rows(df, ranking.descending(first, "k.1"), by=["g.1"])
    assert {r["k.1"]: r["position"] for r in placed.collect()} == {"a": 1, "b": 0, "c": 0}
    assert [r["k.1"] for r in ranking.top_k(df, first, "k.1", 1).collect()] == ["b"]
    assert charts.parallel_coords(df, "k.1", DOTTED, first, ranking=True).count() == 6
    assert charts.chart_series(df, "k.1", {"A.1": first}).columns == ["k.1", "series", "y"]
    assert metrics.regression_metrics(df, first, second, by=["g.1"]).count() == 2


def test_operators_accept_an_empty_table(spark):
    df = spark.createDataFrame([], "k string, g string, x double, y double")
    both = ["x", "y"]
    assert ranking.ordinal_index(df, "k").collect() == []
    assert ranking.rank_columns(df, "k", both).collect() == []
    assert ranking.top_k(df, "x", "k").collect() == []
    assert ranking.bottom_k(df, "x", "k").collect() == []
    assert ranking.exclude_top_k(df, "x", "k").collect() == []
    for by in ([], ["g"]):
        assert stats.histogram(df, both, by=by).collect() == []
        assert stats.minmax_scale(df, both, by=by).collect() == []
    assert charts.pair_bins(df, both).collect() == []
    for by_rank in (False, True):
        assert charts.parallel_coords(df, "k", both, "x", by_rank).collect() == []
    assert {r["r"] for r in stats.correlation_matrix(df, both).collect()} == {None}
    assert metrics.regression_metrics(df, "x", "y").collect() == [(0, None, None)]


def test_ranked_coordinates_take_their_range_from_the_stored_ranks(spark):
    df = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 7 % 50).cast("double").alias("v"))
    plan = charts.parallel_coords(df, "k", ["v"], "v", ranking=True)
    assert "Range (" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert {r["axis_max"] for r in plan.collect()} == {49}


def bucket_points(spark):
    rows = [(float(i % 100), float((i * 37) % 101)) for i in range(4000)]
    rows += [(50.25, float(i)) for i in range(3000)] + [(50.3, -500.0), (50.4, 9000.0)]
    rows += [(None, 5.0), (None, None), (7.5, None), (100.0, 1.0), (float("nan"), 3.0)]
    return spark.createDataFrame(rows, "x double, y double").withColumn("x", F.when(~F.isnan("x"), F.col("x"))), rows


def test_buckets_of_points_by_hand(spark):
    table, rows = bucket_points(spark)
    found = {r["bucket"]: r for r in charts.xy_buckets(table.repartition(5), "x", "y", 10).collect()}
    assert len(found) == 11
    groups = {}
    for x, y in rows:
        missing = x is None or x != x
        groups.setdefault(None if missing else min(int(x // 10), 9), []).append((None if missing else x, y))
    for bucket, points in groups.items():
        row, there = found[bucket], [(x, y) for x, y in points if y is not None]
        assert row["n"] == len(there) and row["n_missing"] == len(points) - len(there)
        ys = [y for _, y in there]
        assert (row["y_low"], row["y_high"]) == (min(ys), max(ys))
        assert row["y_mean"] == pytest.approx(sum(ys) / len(ys))
        if bucket is not None:
            assert row["y_first"] == min(there)[1] and row["y_last"] == max(there)[1]
            assert (row["x_low"], row["x_high"]) == (min(x for x, _ in points), max(x for x, _ in points))
    # The hot bucket is one row, its extremes kept.
    assert found[5]["n"] > 3000 and found[5]["y_low"] == -500 and found[5]["y_high"] == 9000


def test_outline_keeps_ends_and_extremes(spark):
    table, rows = bucket_points(spark)
    found = charts.xy_outline(table.repartition(3), "x", "y", 10).collect()
    points = {}
    for r in found:
        points.setdefault(r["bucket"], set()).add((r["x"], r["y"]))
    assert len(found) <= 40
    groups = {}
    for x, y in rows:
        if x is not None and x == x and y is not None:
            groups.setdefault(min(int(x // 10), 9), []).append((x, y))
    for bucket, own in groups.items():
        low = min(own, key=lambda p: (p[1], p[0]))
        high = max(own, key=lambda p: (p[1], -p[0]))
        assert points[bucket] == {min(own), max(own), low, high}


def test_buckets_by_group_and_of_nothing(spark):
    table, _ = bucket_points(spark)
    both = table.withColumn("g", F.lit("a")).unionByName(table.withColumn("g", F.lit(None)))
    assert charts.xy_buckets(both, "x", "y", 10, by=["g"]).count() == 22
    assert charts.xy_buckets(table.where("false"), "x", "y").count() == 0
    assert charts.xy_outline(table.where("x IS NULL"), "x", "y").count() == 0
    constant = charts.xy_buckets(table.select(F.lit(3.0).alias("x"), "y"), "x", "y", 10)
    assert constant.count() == 1


def test_bounded_points_leave_tasks_as_buckets(spark):
    """Rows are combined before the one shuffle."""
    table, _ = bucket_points(spark)
    plan = charts.xy_buckets(table, "x", "y", 10)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan


def wide_table(spark, columns, rows=300):
    random = np.random.default_rng(columns)
    cells = random.normal(1e6, 3.0, (rows, columns))
    cells[:, 1] = cells[:, 0] * 2 + random.normal(0, 1, rows)
    cells[:, 2] = 7.25
    cells[random.random(cells.shape) < 0.2] = np.nan
    cells[:, 3] = np.nan
    cells[2:, 4] = np.nan
    names = [f"c.{i}" for i in range(columns)]
    frame = pd.DataFrame(cells, columns=names)
    return spark.createDataFrame(frame).repartition(5), frame, names


def test_wide_correlation_matches_the_small_form(spark):
    table, _, names = wide_table(spark, 12)
    table = table.select(*[F.nanvl(F.col(f"`{n}`"), F.lit(None)).alias(n) for n in names])
    small = {(r["a"], r["b"]): r["r"] for r in stats.correlation_matrix(table, names).collect()}
    wide = {(r["a"], r["b"]): r["r"] for r in stats.wide_correlation(table, names).collect()}
    assert set(small) == set(wide)
    for pair, r in small.items():
        assert wide[pair] == (None if r is None else pytest.approx(r, abs=1e-9)), pair


def test_five_hundred_columns(spark):
    table, frame, names = wide_table(spark, 500)
    found = stats.correlation_matrix(table, names).toPandas()
    assert len(found) == 500 * 500
    matrix = found.pivot(index="a", columns="b", values="r").loc[names, names].to_numpy(float)
    wanted = frame.corr().to_numpy()
    few = frame.notna().astype(int).T @ frame.notna().astype(int)
    sure = (few.to_numpy() > 10) & ~np.isnan(wanted)
    assert np.abs(matrix - wanted)[sure].max() < 1e-7
    assert np.isnan(matrix[2]).all() and np.isnan(matrix[3]).all()
