"""Comparing a registered query with its SQL check, value by value."""

from __future__ import annotations

import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def cell(value):
    if isinstance(value, float):
        return "NaN" if value != value else repr(value)
    return "NULL" if value is None else str(value)


def rows(names, values):
    """Rows as sorted tuples, columns in order of name."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in values)


def spark_types(df):
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


# Type names of the SQL engine and of Spark that mean the same.
SAME_TYPE = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
}


def compare(spark, connection, query, sql, sf_dir):
    """Differences as text; empty if rows, names and types agree."""
    df = query(spark, sf_dir)
    found = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    wanted = rows(names, cursor.fetchall())
    problems = []
    if sorted(df.columns) != sorted(names):
        problems.append(f"columns {sorted(df.columns)} != {sorted(names)}")
    else:
        for name, kind in spark_types(df).items():
            if SAME_TYPE.get(types[name].upper()) != kind:
                problems.append(f"type of {name}: {kind} != {types[name]}")
    if len(found) != len(wanted):
        problems.append(f"{len(found)} rows != {len(wanted)}")
    if not wanted:
        problems.append("check has no rows")
    different = [(a, b) for a, b in zip(found, wanted) if a != b]
    if different:
        problems.append(f"{len(different)} rows differ, first {different[0]}")
    return problems
