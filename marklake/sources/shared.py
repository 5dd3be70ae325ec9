"""Tables that cut lineage, kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset (tests, one machine) a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = held.get() if held.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="marklake-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def _application(spark: SparkSession) -> str:
    """The application's own folder in the shared one. The file system deletes it when the application ends."""
    folder = f"{shared_dir(spark)}/marklake-{spark.sparkContext.applicationId}"
    if getattr(spark.sparkContext, "_marklake_folder", None) != folder:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        spark.sparkContext._marklake_folder = folder
    return folder


def written(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """df as a Parquet table in the shared folder: the plan above reads the files, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{_application(spark)}/{label}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cleared(spark: SparkSession) -> None:
    """Deletes all tables made by written() in this application, for a caller who reads none of its queries any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_application(spark))
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in system.listStatus(path):
        system.delete(status.getPath(), True)


def summed(parts: DataFrame, size: int, fan: int = 32) -> np.ndarray:
    """The sum of a column `part` of float64 vectors (bytes): added up in a tree, of which no task holds more than about `fan` parts and the driver one."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for part in batch.column(0):
                total += np.frombuffer(part.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    n = parts.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // fan)
        parts = parts.repartition(n).mapInArrow(add, "part binary")
    return np.frombuffer(next(iter(parts.mapInArrow(add, "part binary").coalesce(1).mapInArrow(add, "part binary").collect())).part)


def dropped(df: DataFrame) -> None:
    """Deletes the files behind a table made by written(); the caller knows that no plan reads them any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shipped(spark: SparkSession) -> None:
    """Makes this package importable on all executors, once per application, wherever it was started from."""
    import os
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_marklake_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    folder = shared_dir(spark)
    local = folder.removeprefix("file://") if folder.startswith(("file://", "/")) else tempfile.mkdtemp(prefix="marklake-")
    os.makedirs(local, exist_ok=True)
    target = f"{local}/marklake-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for p in sorted(package.rglob("*.py")):
            out.write(p, p.relative_to(package.parent))
    context.addPyFile(target)
    context._marklake_shipped = True
