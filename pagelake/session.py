"""Session defaults and the checkpoint folder."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Page archives choose what they read by filters on the URL.
    "spark.sql.python.filterPushdown.enabled": "true",
    # A page can be large, so batches to Python are bounded by rows here and by bytes below.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 * 1024 * 1024),
}


def get_spark(app_name: str = "pagelake", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where none is named, a local master gets a folder below the warehouse; any other master is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return f"{qualified(spark, base).rstrip('/')}/pagelake-{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system, as Hadoop resolves it: without one, other readers would look on the machine they run on."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return path
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    whole = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()
    return re.sub(r"^file:/(?!/)", "file:///", whole)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder made by ``shared_folder``; a missing one is no error."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def write_through(df: DataFrame, name: str = "step", folders: list[str] | None = None) -> DataFrame:
    """Write ``df`` below the shared folder and read it back. This is an action: it runs ``df`` now.

    It cuts the lineage, survives lost executors, and unlike ``checkpoint()`` keeps columns apart
    and sizes known, so later steps read only what they need and joins are planned on real sizes.
    The folder's path is added to ``folders``, so that the caller can remove it once it is read.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    if folders is not None:
        folders.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Actions within give Python workers batches of no more rows than ``SESSION_DEFAULTS`` names, whatever the session allows.

    For rows that hold whole texts: a batch stands in the memory of the executor and of its worker at once.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own, most = spark.conf.get(key), SESSION_DEFAULTS[key]
    if 0 < int(own) <= int(most):
        yield
        return
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.set(key, own)


def narrow_side(rows: DataFrame, at_most: int, limit: int) -> DataFrame:
    """The narrow side of a join with parsed pages, which must not be the side that moves.

    Pages are stored compressed, so the planner takes them for much smaller than they are and might send them out instead.
    ``at_most`` is a known bound of the row count: up to ``limit`` rows are broadcast, more are hashed by a shuffled join.
    """
    return F.broadcast(rows) if at_most <= limit else rows.hint("shuffle_hash")
