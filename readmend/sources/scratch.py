"""The folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`. Only a local session without the
    setting gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        folder = named.rstrip("/")
    else:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        app = context.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="readmend-")
        folder = _LOCAL[app]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(df):
    """Materialize in the shared folder and forget the lineage."""
    scratch_dir(df.sparkSession)
    return df.checkpoint()


def written(df):
    """The same as a table: later scans read the columns and rows they need. What its query shuffled is dropped."""
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        # numbers that come sorted are stored as differences
        df.write.option("parquet.writer.version", "v2").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """A query that runs inside leaves no shuffle files once it has ended; else they stay until the driver
    collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
