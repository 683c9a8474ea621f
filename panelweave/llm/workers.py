"""What the Python tasks of these operators share: code on the workers, bounded batches."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package's sources, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="panelweave-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "panelweave_sources.zip")
    with zipfile.ZipFile(archive, "w") as sources:
        for top, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(top, name)
                    sources.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def bounded(
    batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 8 << 20
) -> Iterator[pa.RecordBatch]:
    """Cut batches by rows so that each holds at most ``max_bytes`` of text, or one row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(
            zero_copy_only=False
        )
        start = held = 0
        for row, length in enumerate(lengths.tolist()):
            if held and held + length > max_bytes:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += length
        if start < batch.num_rows:
            yield batch.slice(start)


def text_bytes(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; NULL is the empty text."""
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def extended(df: DataFrame, function, text: str, added: str) -> DataFrame:
    """``df`` with the columns ``added`` by an Arrow function; all names are taken literally.

    The function sees the columns as ``c0``, ``c1``, ..., the text as ``text``, and
    yields the batch with the added columns behind its own.
    """
    inner = [f"c{i}" if name != text else "text" for i, name in enumerate(df.columns)]
    fields = [
        f"{name} {field.dataType.simpleString()}"
        for name, field in zip(inner, df.schema.fields)
    ]
    out = df.toDF(*inner).mapInArrow(function, ", ".join([*fields, added]))
    return out.select(
        *[F.col(name).alias(own) for name, own in zip(inner, df.columns)],
        *[name for name in out.columns if name not in inner],
    )
