import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.functions.storage import clear_scratch, materialize, scratch_dir
from panelweave.sources import indicators, lookups, tables

PREAMBLE = '"Data Source","World tables",\n\n"Last Updated Date","2018-08-28",\n\n'
HEADER = '"Country Name","Country Code","Indicator Name","Indicator Code","2012","2013","2014",\n'
ROWS = [
    '"Aland","ALD","Forest, share","AG.X","1.5","2.5","3.5",\n',
    '"Bland, Republic of","BLR","Forest, share","AG.X","","..","4.25",\n',
    '"The ""Isles""","ISL","Forest, share","AG.X",,,"0",\n',
]


def write(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


@pytest.fixture
def csv_file(tmp_path):
    return write(tmp_path / "a.csv", PREAMBLE + HEADER + "".join(ROWS), "utf-8-sig")


def by_code(df):
    return {r["Country Code"]: r for r in df.collect()}


def test_scan_skips_preamble_and_reads_missing_cells(spark, csv_file):
    rows = by_code(indicators.read_indicators(spark, csv_file, range(2012, 2015)))
    assert set(rows) == {"ALD", "BLR", "ISL"}
    assert rows["BLR"]["Country Name"] == "Bland, Republic of"
    assert rows["ISL"]["Country Name"] == 'The "Isles"'
    assert [rows["ALD"][str(y)] for y in (2012, 2013, 2014)] == [1.5, 2.5, 3.5]
    assert [rows["BLR"][str(y)] for y in (2012, 2013, 2014)] == [None, None, 4.25]
    assert [rows["ISL"][str(y)] for y in (2012, 2013, 2014)] == [None, None, 0.0]


def test_scan_without_preamble_and_with_bom_on_the_header(spark, tmp_path):
    path = write(tmp_path / "b.csv", HEADER + "".join(ROWS), "utf-8-sig")
    assert indicators.read_indicators(spark, path, range(2012, 2015)).count() == 3


def test_scan_many_files_in_one_read(spark, tmp_path):
    one = write(tmp_path / "a.csv", PREAMBLE + HEADER + "".join(ROWS))
    two = write(tmp_path / "b.csv", PREAMBLE + HEADER + "".join(ROWS).replace("AG.X", "EN.Y"))
    rows = indicators.read_indicators(spark, [one, two], range(2012, 2015))
    counts = {r["Indicator Code"]: r["count"] for r in rows.groupBy("Indicator Code").count().collect()}
    assert counts == {"AG.X": 3, "EN.Y": 3}


def test_scan_rejects_a_file_with_other_years(spark, csv_file):
    for years in (range(2011, 2014), range(2012, 2016)):
        with pytest.raises(PySparkException, match="does not match years"):
            indicators.read_indicators(spark, csv_file, years).collect()


@pytest.mark.parametrize("skip", [0, 4])
def test_exact_skip_agrees_with_content_skip(spark, tmp_path, skip):
    text = (PREAMBLE if skip else "") + HEADER + "".join(ROWS)
    path = write(tmp_path / "a.csv", text, "utf-8-sig")
    exact = indicators.read_csv_skipping(spark, path, skip)
    assert exact.columns == [*indicators.DESCRIPTORS, "2012", "2013", "2014"]
    scanned = indicators.read_indicators(spark, path, range(2012, 2015))
    assert by_code(exact) == by_code(scanned)


def test_exact_skip_across_file_splits(spark, tmp_path):
    body = "".join(f'"N{i}","C{i}","I","X","{i}","{i}","{i}",\n' for i in range(5000))
    path = write(tmp_path / "a.csv", PREAMBLE + HEADER + body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = indicators.read_csv_skipping(spark, path, 4)
        assert rows.agg(F.count("*"), F.sum("2013")).collect()[0][:] == (5000, sum(range(5000)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_exact_skip_checks_the_header(spark, csv_file):
    schema = indicators.indicator_schema([2013, 2014])
    with pytest.raises(ValueError, match="expected columns"):
        indicators.read_csv_skipping(spark, csv_file, 4, schema)
    with pytest.raises(ValueError, match="no header"):
        indicators.read_csv_skipping(spark, csv_file, 50)


def test_long_form_leaves_out_missing_cells(spark, csv_file):
    wide = indicators.read_indicators(spark, csv_file, range(2012, 2015))
    long = indicators.to_long(wide)
    assert long.columns == ["entity", "entity_name", "indicator", "year", "value"]
    assert long.count() == 5
    assert indicators.to_long(wide, keep_missing=True).count() == 9
    assert indicators.to_long(wide, [2014]).count() == 3


def test_long_store_prunes_by_year(spark, csv_file, tmp_path):
    wide = indicators.read_indicators(spark, csv_file, range(2012, 2015))
    path = str(tmp_path / "store")
    indicators.write_long(indicators.to_long(wide), path)
    stored = indicators.read_long(spark, path)
    assert dict(stored.dtypes)["year"] == "int"
    one = stored.where("year = 2014")
    assert one.count() == 3 and len(one.inputFiles()) >= 1
    assert "PartitionFilters: [isnotnull(year" in one._jdf.queryExecution().toString()


def test_union_long_turns_nan_into_null(spark):
    part = spark.createDataFrame([("a", "x", 1, float("nan"))], "entity string, indicator string, year int, value double")
    other = spark.createDataFrame([(2.0, 1, "x", "b")], "value double, year int, indicator string, entity string")
    rows = {r["entity"]: r["value"] for r in indicators.union_long([part, other]).collect()}
    assert rows == {"a": None, "b": 2.0}


def test_lookup_file_is_parsed_not_evaluated(spark, tmp_path):
    path = write(tmp_path / "types.txt", '{\n"Aland":"Country",\n"World":"Group"\n}')
    rows = {r["entity"]: r["entity_type"] for r in lookups.read_entity_types(spark, path).collect()}
    assert rows == {"Aland": "Country", "World": "Group"}
    evil = write(tmp_path / "evil.txt", '__import__("os").getcwd()')
    with pytest.raises(Exception, match="MALFORMED|JSON"):
        lookups.read_entity_types(spark, evil).collect()


def test_duplicate_lookup_key_raises(spark):
    twice = spark.createDataFrame([("a", "Country"), ("a", "Group")], "entity string, entity_type string")
    with pytest.raises(PySparkException, match="duplicate entity"):
        lookups.unique_lookup(twice, "entity", "entity_type").collect()


def test_catalog_handles_bom_quotes_and_trailing_comma(spark, tmp_path):
    text = '"INDICATOR_CODE","INDICATOR_NAME","SOURCE_NOTE","SOURCE_ORGANIZATION",\n"A.B","Name, with comma","Note ""quoted"".","Org",\n'
    path = write(tmp_path / "m.csv", text, "utf-8-sig")
    catalog = lookups.read_catalog(spark, path)
    assert catalog.columns == list(lookups.CATALOG_COLUMNS)
    assert catalog.collect()[0][:] == ("A.B", "Name, with comma", 'Note "quoted".', "Org")
    other = write(tmp_path / "o.csv", '"CODE"\n"A"\n')
    with pytest.raises(ValueError, match="lacks columns"):
        lookups.read_catalog(spark, other)


def test_from_local_and_select_and_preview(spark):
    import pandas as pd

    frame = pd.DataFrame({"k": ["b", "a", "c"], "v": [1.0, float("nan"), 3.0]})
    df = tables.from_local(spark, frame)
    assert tables.preview(df, "k", n=2).collect() == [("a", None), ("b", 1.0)]
    assert tables.select_columns(df, key="k", twice=F.col("v") * 2).columns == ["key", "twice"]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_write_table_reads_back(spark, tmp_path, fmt):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, v double")
    path = str(tmp_path / fmt)
    tables.write_table(df, path, fmt)
    reader = spark.read.schema(df.schema).option("header", True)
    assert sorted(reader.format(fmt).load(path).collect()) == sorted(df.collect())


def test_materialize_keeps_rows_and_schema(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).cast("int").alias("part"))
    stored = materialize(df, "test", partition_by=("part",))
    assert set(stored.columns) == {"id", "part"}
    assert sorted(stored.select("id", "part").collect()) == sorted(df.collect())
    assert stored.inputFiles()[0].split("://")[-1].lstrip("/").startswith(
        scratch_dir(spark).replace("file:", "").lstrip("/")
    )


def test_cleared_scratch_is_gone_and_usable_again(spark):
    import os

    path = materialize(spark.range(3).toDF("id"), "gone").inputFiles()[0].removeprefix("file://")
    clear_scratch(spark)
    assert not os.path.exists(path)
    assert materialize(spark.range(3).toDF("id"), "back").count() == 3


SWAPPED = HEADER.replace("Indicator Name", "?").replace("Indicator Code", "Indicator Name")
SWAPPED = SWAPPED.replace("?", "Indicator Code")


@pytest.mark.parametrize(
    "text, problem",
    [
        (PREAMBLE + SWAPPED + '"One","ONE","X","I","1","2","3",\n', "does not match"),
        (PREAMBLE + HEADER + '"One","ONE","I","","1","2","3",\n', "without an indicator code"),
        (PREAMBLE + '"One","ONE","I","X","1","2","3",\n', "no header"),
    ],
)
def test_misread_files_fail(spark, tmp_path, text, problem):
    path = write(tmp_path / "bad.csv", text)
    with pytest.raises(Exception, match=problem):
        indicators.read_indicators(spark, path, range(2012, 2015)).collect()


@pytest.fixture
def small_splits(spark):
    """Files of a few kilobytes are read in many splits."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_exact_skipping_of_many_files(spark, tmp_path, small_splits):
    sizes = {"a": 0, "b": 1, "c": 900, "d": 2500, "e": 3}
    for name, n in sizes.items():
        body = "".join(f'"N{i}","{name}{i}","I","X","{i}","","{i}",\n' for i in range(n))
        write(tmp_path / f"{name}.csv", PREAMBLE + HEADER + body, "utf-8-sig" if name == "c" else "utf-8")
    rows = indicators.read_csv_skipping(spark, str(tmp_path), 4, keep_file=True)
    assert rows.rdd.getNumPartitions() > 20
    found = {r[0]: r[1:] for r in rows.groupBy(F.substring("Country Code", 1, 1)).agg(
        F.count("*"), F.sum("2012"), F.count_distinct("file")).collect()}
    assert found == {n: (k, sum(range(k)), 1) for n, k in sizes.items() if k}
    again = indicators.read_indicators(spark, str(tmp_path), range(2012, 2015))
    assert again.count() == sum(sizes.values())


def test_lines_are_numbered_by_file(spark, tmp_path, small_splits):
    texts = {"a.txt": "\n\n", "b.txt": "x", "c.txt": "".join(f"line {i} {'y' * (i % 90)}\n" for i in range(700))}
    for name, text in texts.items():
        write(tmp_path / name, text)
    found = {}
    for row in indicators.placed_lines(spark, str(tmp_path)).collect():
        found.setdefault(row["file"].rsplit("/", 1)[1], {})[row["line"]] = row["value"]
    assert found == {name: dict(enumerate(text.splitlines())) for name, text in texts.items()}


def test_other_and_missing_headers_among_many_files(spark, tmp_path):
    write(tmp_path / "a.csv", PREAMBLE + HEADER + "".join(ROWS))
    write(tmp_path / "b.csv", PREAMBLE + HEADER.replace("2013", "2031") + "".join(ROWS))
    with pytest.raises(Exception, match="expected columns"):
        indicators.read_csv_skipping(spark, str(tmp_path), 4).collect()
    write(tmp_path / "b.csv", PREAMBLE)
    with pytest.raises(ValueError, match="b.csv has no header"):
        indicators.read_csv_skipping(spark, str(tmp_path), 4)


def raw_file(tmp_path):
    rows = [
        '"A","AAA","I","X","1","..","TRUE",',
        '"B","BBB","I","X","2"," 1e3 ","false",',
        '"C, D","CCC","I","X","3","","True",',
        '"D","DDD","I","X","-4","NaN","FALSE",',
    ]
    return write(tmp_path / "raw.csv", PREAMBLE + HEADER + "\n".join(rows) + "\n")


def test_rejected_cells_are_those_the_typed_scan_lost(spark, tmp_path):
    path = raw_file(tmp_path)
    cells = indicators.raw_cells(spark, path, range(2012, 2015))
    rejected = {(r["entity"], r["year"]): r["raw"] for r in indicators.rejected_cells(cells).collect()}
    assert rejected == {
        ("AAA", 2013): "..", ("AAA", 2014): "TRUE", ("BBB", 2014): "false", ("CCC", 2014): "True", ("DDD", 2014): "FALSE"
    }
    typed = {r["Country Code"]: r for r in indicators.read_indicators(spark, path, range(2012, 2015)).collect()}
    for row in cells.where("column in ('2012', '2013', '2014')").collect():
        value, key = typed[row["entity"]][row["column"]], (row["entity"], int(row["column"]))
        lost = value is None and row["raw"] not in (None, "", "NaN")
        assert lost == (key in rejected)


def test_types_are_the_narrowest_that_hold_a_column(spark, tmp_path):
    path = raw_file(tmp_path)
    types = indicators.column_types(indicators.raw_cells(spark, path, range(2012, 2015)))
    found = {r["column"]: r for r in types.collect()}
    assert {name: r["type"] for name, r in found.items()} == {
        **dict.fromkeys(indicators.DESCRIPTORS, "string"), "2012": "bigint", "2013": "string", "2014": "boolean"
    }
    assert found["2013"]["n_missing"] == 2 and found["2013"]["n_number"] == 1 and found["2013"]["n_text"] == 1
    schema = indicators.inferred_schema(types, [*indicators.DESCRIPTORS, "2012", "2013", "2014"])
    rows = {r["Country Code"]: r for r in indicators.read_csv_skipping(spark, path, 4, schema).collect()}
    assert [rows[k]["2012"] for k in sorted(rows)] == [1, 2, 3, -4]
    assert [rows[k]["2014"] for k in sorted(rows)] == [True, False, True, False]


def test_header_check_reads_only_the_start_of_a_file(spark, tmp_path):
    import gzip

    body = "".join(f'"N","C{i}","I","X","1","2","3",\n' for i in range(20_000))
    path = str(tmp_path / "a.csv.gz")
    with gzip.open(path, "wt") as out:
        out.write(PREAMBLE + HEADER + body)
    assert len(indicators._head(spark, "file:" + path)) < 4000
    assert indicators.read_indicators(spark, path, range(2012, 2015)).count() == 20_000
    late = write(tmp_path / "late.csv", PREAMBLE + body[:3000] + HEADER)
    with pytest.raises(ValueError, match="no header row"):
        indicators.read_indicators(spark, late, range(2012, 2015))


def test_replacing_years_can_run_again(spark, tmp_path):
    path = str(tmp_path / "store")
    kind = "entity string, indicator string, year int, value double"
    first = [("a", "i", 1, 1.0), ("b", "i", 1, 2.0), ("a", "i", 2, 3.0)]
    indicators.write_long(spark.createDataFrame(first, kind), path)
    second = spark.createDataFrame([("a", "i", 2, 30.0), ("c", "i", 3, 40.0)], kind)
    for _ in range(2):
        indicators.replace_years(second, path)
        found = indicators.read_long(spark, path).select("entity", "indicator", "year", "value").collect()
        assert sorted(map(tuple, found)) == [("a", "i", 1, 1.0), ("a", "i", 2, 30.0), ("b", "i", 1, 2.0), ("c", "i", 3, 40.0)]
    failing = second.withColumn("value", F.when(F.col("year") == 3, F.raise_error(F.lit("lost"))).otherwise(-1.0).cast("double"))
    with pytest.raises(Exception, match="lost"):
        indicators.replace_years(failing, path)
    assert indicators.read_long(spark, path).agg(F.sum("value")).first()[0] == 73.0
    indicators.replace_years(second.where("false"), path)
    assert indicators.read_long(spark, path).count() == 4


@pytest.mark.parametrize("text", ['{"A": "Country", "B": "Gro', "", "[1]"])
def test_damaged_lookup_fails(spark, tmp_path, text):
    path = write(tmp_path / "types.txt", text)
    with pytest.raises(Exception):  # noqa: B017
        assert lookups.read_entity_types(spark, path).collect()


def test_schema_is_explicit():
    schema = indicators.indicator_schema([2013])
    assert schema.fieldNames() == [*indicators.DESCRIPTORS, "2013"]
    assert isinstance(schema["2013"].dataType, T.DoubleType)


def test_line_breaks_inside_quotes(spark, tmp_path):
    rows = '"Two\nLines","TWO","I","X","1","2","3",\n"One","ONE","I","X","4","5","6",\n'
    path = write(tmp_path / "m.csv", PREAMBLE + HEADER + rows)
    found = by_code(indicators.read_indicators(spark, path, range(2012, 2015), multi_line=True))
    assert found["TWO"]["Country Name"] == "Two\nLines" and found["ONE"]["2014"] == 6.0


@pytest.mark.parametrize("cluster", ["yarn", "local-cluster[2,1,1024]"])
def test_scratch_needs_a_shared_folder_on_a_cluster(cluster):
    class Context:
        master = cluster
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(Session)
