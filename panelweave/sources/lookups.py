"""Small reference tables: entity types and indicator metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.expressions import named

# The columns of an indicator metadata file.
CATALOG_COLUMNS = ("INDICATOR_CODE", "INDICATOR_NAME", "SOURCE_NOTE", "SOURCE_ORGANIZATION")


def read_entity_types(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object ``{entity: type}``, or one per file, as ``(entity, entity_type)``.

    The text is parsed as data, never evaluated; one that is not a JSON object
    fails the query.
    """
    text = spark.read.text(path, wholetext=True).select("value")
    pairs = F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})
    broken = F.raise_error(F.lit(f"{path} is not a JSON object")).cast("map<string,string>")
    return text.select(F.explode(F.coalesce(pairs, broken)).alias("entity", "entity_type"))


def unique_lookup(lookup: DataFrame, key: str, value: str) -> DataFrame:
    """The lookup with one row per key; a repeated key fails the query that reads it."""
    repeated = F.raise_error(F.concat(F.lit(f"duplicate {key} in lookup: "), named(key).cast("string")))
    return lookup.groupBy(named(key)).agg(
        F.when(F.count(F.lit(1)) > 1, repeated).otherwise(F.first(named(value))).alias(value)
    )


def read_catalog(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Indicator metadata files as one table keyed by ``INDICATOR_CODE``.

    Byte-order mark and quoted commas are handled by the reader; the empty
    column that a trailing comma makes is dropped.
    """
    rows = spark.read.option("header", True).option("escape", '"').csv(paths)
    missing = [c for c in CATALOG_COLUMNS if c not in rows.columns]
    if missing:
        raise ValueError(f"metadata file lacks columns {missing}")
    return rows.select(*CATALOG_COLUMNS)


def as_lookup(df: DataFrame, entity: Column, entity_type: Column) -> DataFrame:
    """Any table as a lookup ``(entity, entity_type)``."""
    return df.select(entity.alias("entity"), entity_type.alias("entity_type"))
