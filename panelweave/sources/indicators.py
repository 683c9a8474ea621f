"""Wide per-year indicator files and the long form they turn into."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.functions.expressions import nan_to_null, without_nan
from panelweave.functions.storage import materialize

# The descriptor columns of an indicator file, in file order.
DESCRIPTORS = ("Country Name", "Country Code", "Indicator Name", "Indicator Code")

# Short name -> indicator code of the five published indicators.
INDICATOR_CODES = {
    "landForest": "AG.LND.FRST.ZS",
    "atmosphereCO2": "EN.ATM.CO2E.KT",
    "GDP": "NY.GDP.MKTP.CD",
    "populationTotal": "SP.POP.TOTL",
    "populationUrban": "SP.URB.TOTL.IN.ZS",
}

# Year columns of the published files, first and last.
FIRST_YEAR, LAST_YEAR = 1960, 2017


def indicator_schema(years: Iterable[int]) -> T.StructType:
    """Four text descriptors, then one double per year."""
    return T.StructType(
        [T.StructField(name, T.StringType()) for name in DESCRIPTORS]
        + [T.StructField(str(year), T.DoubleType()) for year in years]
    )


def _keep_row(years: Sequence[int]) -> Column:
    """True for data rows, false for preamble and header rows.

    A header row whose descriptors or outer year columns are not where the schema
    has them fails the query: the file would otherwise be read with columns that
    changed places. So does a row with values but without an indicator code.
    """
    code = F.col(f"`{DESCRIPTORS[3]}`")
    headed, aligned = _header_row(), F.lit(True)
    for name in DESCRIPTORS:
        aligned = aligned & F.coalesce(F.col(f"`{name}`") == name, F.lit(False))
    for year in (years[0], years[-1]):
        aligned = aligned & F.coalesce(F.col(f"`{year}`") == float(year), F.lit(False))
    header = F.when(aligned, F.lit(False)).otherwise(
        F.raise_error(F.lit(f"indicator file header does not match years {years[0]}-{years[-1]}"))
    )
    valued = F.lit(False)
    for year in years:
        valued = valued | F.col(f"`{year}`").isNotNull()
    nameless = F.when(
        valued, F.raise_error(F.lit("indicator file row without an indicator code")).cast("boolean")
    ).otherwise(F.lit(False))
    return F.when(headed, header).when(code.isNull(), nameless).otherwise(F.lit(True))


def _header_row() -> Column:
    """Some descriptor column holds the code's or the indicator's heading."""
    headed = F.lit(False)
    for name in DESCRIPTORS:
        headed = headed | F.coalesce(F.col(f"`{name}`").isin(*DESCRIPTORS[2:]), F.lit(False))
    return headed


# Bytes from the start of a file in which its header must begin and end.
HEAD_BYTES = 1 << 16


def _head(spark: SparkSession, path: str) -> list[list[str]]:
    """The first rows of a file, as many as end within its first ``HEAD_BYTES``."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path))
    stream = where.getFileSystem(conf).open(where)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(where)
        read = codec.createInputStream(stream) if codec else stream
        data = bytes(read.readNBytes(HEAD_BYTES))
    finally:
        stream.close()
    text = data.decode("utf-8-sig", "ignore")
    if len(data) == HEAD_BYTES:
        text = text[: text.rfind("\n") + 1]
    return list(csv.reader(io.StringIO(text)))


def _check_headers(spark: SparkSession, files: Sequence[str]) -> None:
    """Every file with data rows must have a header before them.

    Only the start of each file is read, a few at a time, whatever the files hold.
    """

    def lacks_header(path: str) -> bool:
        for row in _head(spark, path):
            if any(cell in DESCRIPTORS[2:] for cell in row[: len(DESCRIPTORS)]):
                return False
            if len(row) >= len(DESCRIPTORS) and row[len(DESCRIPTORS) - 1]:
                return True
        return False

    with ThreadPool(16) as pool:
        for path, lacking in zip(files, pool.imap(lacks_header, files)):
            if lacking:
                raise ValueError(f"{path} has no header row")


def _scan(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, multi_line: bool
) -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("multiLine", multi_line)
        .csv(paths)
    )


def read_indicators(
    spark: SparkSession,
    paths: str | Sequence[str],
    years: Iterable[int] = range(FIRST_YEAR, LAST_YEAR + 1),
    multi_line: bool = False,
) -> DataFrame:
    """One scan over any number of indicator files; the code column tells them apart.

    The schema is explicit, so nothing is inferred. Preamble lines and headers
    are recognised by their content, not by line number, which keeps the files
    splittable and lets many files share one scan. Cells that are empty or not
    numbers are NULL. Set ``multi_line`` for files with line breaks inside
    quotes; each is then read by one task.
    """
    years = list(years)
    rows = _scan(spark, paths, indicator_schema(years), multi_line)
    _check_headers(spark, rows.inputFiles())
    return without_nan(rows.where(_keep_row(years)))


def raw_cells(
    spark: SparkSession,
    paths: str | Sequence[str],
    years: Iterable[int] = range(FIRST_YEAR, LAST_YEAR + 1),
    multi_line: bool = False,
) -> DataFrame:
    """``(file, entity, indicator, column, raw)``: every cell of the data rows as its text.

    Descriptor columns are cells too. Empty cells are NULL. Preamble and header rows
    are left out by content, as in :func:`read_indicators`.
    """
    columns = [*DESCRIPTORS, *[str(year) for year in years]]
    schema = T.StructType([T.StructField(name, T.StringType()) for name in columns])
    rows = _scan(spark, paths, schema, multi_line)
    data = rows.where(F.col(f"`{DESCRIPTORS[3]}`").isNotNull() & ~_header_row())
    return data.select(
        F.col("_metadata.file_path").alias("file"),
        F.col(f"`{DESCRIPTORS[1]}`").alias("entity"),
        F.col(f"`{DESCRIPTORS[3]}`").alias("indicator"),
        *[F.col(f"`{name}`") for name in columns],
    ).unpivot(["file", "entity", "indicator"], [F.col(f"`{name}`") for name in columns], "column", "raw")


def _number(raw: Column) -> Column:
    """The cell as the typed scan reads it: NULL where it is not a number."""
    return raw.try_cast("double")


# Texts that stand for a missing number.
MISSING = ("", "NaN")


def rejected_cells(cells: DataFrame) -> DataFrame:
    """``(file, entity, indicator, year, raw)``: year cells that :func:`read_indicators` cannot read.

    ``cells`` comes from :func:`raw_cells`. The typed scan gives NULL for them, as for
    empty cells; here is what they held. ``NaN`` stands for a missing number.
    """
    year, raw = F.col("column").try_cast("int"), F.col("raw")
    unread = raw.isNotNull() & ~F.trim(raw).isin(*MISSING) & _number(raw).isNull()
    return cells.where(year.isNotNull() & unread).select(
        "file", "entity", "indicator", year.alias("year"), "raw"
    )


def column_types(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(column, n, n_missing, n_boolean, n_integer, n_number, n_text, type)`` in one pass.

    ``cells`` comes from :func:`raw_cells`. Each cell has the narrowest kind that can
    hold it, a column the narrowest that holds all of its cells: boolean where all are,
    bigint where all are whole and none is missing, double where all are numbers or
    missing, else string; booleans among numbers make a string column. Counts combine
    map-side, so one column may hold any number of cells.
    """
    raw = F.col("raw")
    missing = raw.isNull() | F.trim(raw).isin(*MISSING)
    kind = (
        F.when(missing, "missing")
        .when(raw.isin("True", "False", "true", "false", "TRUE", "FALSE"), "boolean")
        .when(raw.rlike(r"^[+-]?[0-9]{1,18}$"), "integer")
        .when(_number(raw).isNotNull(), "number")
        .otherwise("text")
    )
    names = ("missing", "boolean", "integer", "number", "text")
    counted = cells.withColumn("_kind", kind).groupBy(*by, "column").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("_kind") == name).alias(f"n_{name}") for name in names],
    )
    numbers = F.col("n_integer") + F.col("n_number") + F.col("n_missing")
    return counted.withColumn(
        "type",
        F.when(F.col("n_boolean") == F.col("n"), "boolean")
        .when(F.col("n_integer") == F.col("n"), "bigint")
        .when(numbers == F.col("n"), "double")
        .otherwise("string"),
    )


def inferred_schema(types: DataFrame, columns: Sequence[str]) -> T.StructType:
    """A schema for :func:`read_csv_skipping` from the small table of :func:`column_types`."""
    found = {row["column"]: row["type"] for row in types.select("column", "type").collect()}
    return T.StructType(
        [T.StructField(name, T._parse_datatype_string(found.get(name, "double"))) for name in columns]
    )


def _splits(spark: SparkSession, paths: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Lines with their split, and the number of lines of each split (stored)."""
    lines = spark.read.text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    counts = lines.groupBy("file", "_block").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first")
    )
    return lines, materialize(counts, "line-counts")


def _placed(lines: DataFrame, splits: DataFrame) -> DataFrame:
    before = (
        Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = splits.select(
        F.col("file").alias("_file"),
        F.col("_block").alias("_start"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    same = (F.col("file") == F.col("_file")) & (F.col("_block") == F.col("_start"))
    return lines.join(shifts, same).select("value", "file", (F.col("_id") + F.col("_shift")).alias("line"))


def placed_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``(value, file, line)``: every physical line with its 0-based number in its file.

    A file is read in splits by many tasks. A first scan counts the lines of each
    split; summed up in the order of the splits they say how many lines of the file
    come before one. Row ids give a line's place within its split, since a split is
    read whole, in order, by one task. Only the counts move, one row a split.
    """
    return _placed(*_splits(spark, paths))


def read_csv_skipping(
    spark: SparkSession,
    paths: str | Sequence[str],
    skip_lines: int = 0,
    schema: T.StructType | None = None,
    keep_file: bool = False,
) -> DataFrame:
    """CSV files, each without its first ``skip_lines`` physical lines and its header.

    Exact for files without line breaks inside quotes, of any size and number; see
    :func:`placed_lines`. Without ``schema`` the header of the first file names the
    columns, years as double and the rest as text; with one, headers must hold its
    names in that order. A file without a header after those lines fails, one with
    another header fails when it is read. ``keep_file`` adds the column ``file``.
    """
    lines, splits = _splits(spark, paths)
    sizes = splits.groupBy("file").agg(F.sum("_n").alias("n"))
    short = sizes.where(F.col("n") <= skip_lines).head()
    if short is not None:
        raise ValueError(f"{short['file']} has no header after {skip_lines} lines")
    first = sizes.orderBy("file").head()
    if first is None:
        raise ValueError(f"{paths} has no header after {skip_lines} lines")
    lines = _placed(lines, splits)
    head = lines.where((F.col("file") == first["file"]) & (F.col("line") == skip_lines)).head()
    found = next(csv.reader([head["value"].lstrip("\ufeff")]), [])
    if found and not found[-1]:
        found.pop()  # trailing comma
    if schema is None:
        schema = T.StructType(
            [
                T.StructField(name, T.DoubleType() if name.isdigit() else T.StringType())
                for name in found
            ]
        )
    elif found[: len(schema.fields)] != schema.fieldNames():
        raise ValueError(f"{first['file']}: expected columns {schema.fieldNames()}, found {found}")
    texts = ", ".join(f"c{i} string" for i in range(len(schema.fields)))
    cells = F.from_csv(F.ltrim(F.col("value"), F.lit("\ufeff")), texts, {"escape": '"'})
    heading = F.to_json(cells) == F.to_json(F.struct(*[F.lit(f.name).alias(f"c{i}") for i, f in enumerate(schema.fields)]))
    other = F.raise_error(F.concat("file", F.lit(f": expected columns {schema.fieldNames()}, found "), "value"))
    header = F.when(heading, F.lit(False)).otherwise(other.cast("boolean"))
    keep = (
        F.when(F.col("line") < skip_lines, F.lit(False))
        .when(F.col("line") == skip_lines, header)
        .otherwise(F.trim("value") != "")
    )
    parsed = F.from_csv("value", schema.toDDL(), {"escape": '"'})
    kept = ["file"] if keep_file else []
    return without_nan(lines.where(keep).select(parsed.alias("row"), *kept).select("row.*", *kept))


def to_long(wide: DataFrame, years: Iterable[int] | None = None, keep_missing: bool = False) -> DataFrame:
    """Wide file rows -> ``(entity, entity_name, indicator, year, value)``, without a shuffle.

    Missing cells are left out unless ``keep_missing``: absence says the same in
    fewer rows.
    """
    names = [c for c in wide.columns if c.isdigit()] if years is None else [str(y) for y in years]
    long = wide.select(
        F.col("`Country Code`").alias("entity"),
        F.col("`Country Name`").alias("entity_name"),
        F.col("`Indicator Code`").alias("indicator"),
        *[F.col(f"`{n}`") for n in names],
    ).unpivot(["entity", "entity_name", "indicator"], names, "year", "value")
    long = long.withColumn("year", F.col("year").cast("int"))
    return long if keep_missing else long.where(F.col("value").isNotNull())


def union_long(parts: Sequence[DataFrame]) -> DataFrame:
    """Stack long tables by column name, NaN as NULL."""
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.withColumn("value", nan_to_null(F.col("value")))


def write_long(long: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store the long form by year, so that a year slice reads only its folder.

    Rows are range-partitioned by (year, entity): tasks are of even size however
    unevenly the years are filled, and each writes to one or two year folders.
    """
    (
        long.repartitionByRange("year", "entity")
        .sortWithinPartitions("year", "indicator", "entity")
        .write.mode(mode)
        .partitionBy("year")
        .parquet(path)
    )


def replace_years(long: DataFrame, path: str) -> None:
    """Put the years in ``long`` into the store in place of what it holds for them.

    Other years stay as they are, and are not read. The year folders are swapped in
    when all tasks are done, so a load that failed or ran twice can run again.
    """
    (
        long.repartitionByRange("year", "entity")
        .sortWithinPartitions("year", "indicator", "entity")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year")
        .parquet(path)
    )


def read_long(spark: SparkSession, path: str) -> DataFrame:
    """Open a store written by :func:`write_long`."""
    return spark.read.parquet(path)
