"""Results published as a whole: every attempt writes under its own name, and a manifest says which one counts.

A write that fails half-way leaves files that no manifest row names, and the result before it stays readable. The row is
added last, so readers see all parts of a result or none. An attempt for a run that is published already does nothing, so
a job that is run again neither doubles nor replaces what is there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.operators.sinks import write_csv, write_json, write_run_document, write_text
from pagelake.session import remove_folder

MANIFEST = "position long, run string, attempt string, published_at timestamp"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    known = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest") if known else spark.createDataFrame([], MANIFEST)


def publish(spark: SparkSession, path: str, run: str, write: Callable[[str], object]) -> bool:
    """Call ``write`` with the folder of a new attempt and make it the result of ``run``; False if ``run`` has one."""
    path = path.rstrip("/")
    before = _manifest(spark, path).agg(F.max("position").alias("last"), F.count(F.when(F.col("run") == run, 1)).alias("n")).first()
    if before.n:
        return False
    attempt = f"attempt-{uuid.uuid4().hex}"
    write(f"{path}/{attempt}")
    row = spark.range(1).select(
        F.lit((before["last"] or 0) + 1).cast("long").alias("position"), F.lit(run).alias("run"), F.lit(attempt).alias("attempt"), F.current_timestamp().alias("published_at"),
    )
    row.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return True


def published(spark: SparkSession, path: str, run: str | None = None) -> str | None:
    """Folder of the result that counts: the last published one, or that of ``run``. Of two published at once the larger name counts."""
    path = path.rstrip("/")
    rows = _manifest(spark, path)
    best = (rows if run is None else rows.where(F.col("run") == run)).agg(F.max(F.struct("position", "attempt")).alias("best")).first().best
    return f"{path}/{best.attempt}" if best else None


def forget_attempts(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Remove all attempts but the last ``keep`` published ones; returns how many went. Not while others publish."""
    path = path.rstrip("/")
    kept = {r.attempt for r in _manifest(spark, path).orderBy(F.desc("position"), F.desc("attempt")).limit(keep).collect()}
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)]
    gone = [n for n in names if n.startswith("attempt-") and n not in kept]
    for name in gone:
        remove_folder(spark, f"{path}/{name}")
    return len(gone)


def publish_json(records: DataFrame, path: str, run: str, fields: list[str]) -> bool:
    return publish(records.sparkSession, path, run, lambda folder: write_json(records, folder, fields))


def publish_text(records: DataFrame, path: str, run: str) -> bool:
    return publish(records.sparkSession, path, run, lambda folder: write_text(records, folder))


def publish_csv(records: DataFrame, path: str, run: str, order: list[str], fields: list[str] | None = None) -> bool:
    """Records without any field publish an empty result."""
    return publish(records.sparkSession, path, run, lambda folder: write_csv(records, folder, order, fields=fields))


def publish_run_document(runs: DataFrame, summary: DataFrame, path: str, run: str) -> bool:
    """Runs and summary, both or neither."""
    return publish(runs.sparkSession, path, run, lambda folder: write_run_document(runs, summary, folder))
