"""Cutting lineage through the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from panelweave.functions.expressions import named


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; all executors must see it.

    Where the session names none, a temporary folder is set, but only in local
    mode: on a cluster a machine-local folder would lose data with its machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="panelweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch folder, in one folder per application."""
    application = spark.sparkContext.applicationId
    return f"{scratch_dir(spark).rstrip('/')}/panelweave-{application}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write once to the scratch folder and read back.

    Later passes read columnar files instead of repeating the joins behind
    ``df``, and a lost executor costs a re-read, not a re-computation.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_bucketed(
    df: DataFrame, label: str, key: str, buckets: int = 0, partition_by: tuple[str, ...] = ()
) -> DataFrame:
    """As :func:`materialize`, in ``buckets`` buckets of ``key``, as many as shuffles have by default.

    Tables stored with the same key and number join, and group, by that key without an
    exchange, however often they are read. Each task writes one bucket, so there is one
    file a bucket (and folder of ``partition_by``).
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, label)
    name = "panelweave_" + re.sub(r"\W", "_", path.rsplit("/", 1)[1])
    writer = df.repartition(buckets, named(key)).write.bucketBy(buckets, key).sortBy(key)
    writer.partitionBy(*partition_by).option("path", path).saveAsTable(name, format="parquet")
    return spark.table(name)


def clear_scratch(spark: SparkSession) -> None:
    """Remove everything this application has stored in the scratch folder.

    For the end of a job, when no table read from there is needed any more.
    """
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(
        f"{scratch_dir(spark).rstrip('/')}/panelweave-{context.applicationId}"
    )
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
