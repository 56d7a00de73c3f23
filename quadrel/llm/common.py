"""Shared folder, written intermediates and Arrow batch plumbing for the operators of this package."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset (local tests)."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        path = sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "quadrel-shared")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/quadrel-{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage with a Parquet table in the shared folder, so that a lost executor never recomputes what led to it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    write(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def write(df: DataFrame, path: str, *by: str) -> None:
    """Writes a table; its shuffle files go as soon as it is written, since nothing reads them again."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        drop_path(t.sparkSession, t._scratch)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at interpreter exit
            return


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str, rows: int = 512) -> DataFrame:
    """mapInArrow over slices of at most `rows` rows, so that Python holds few decoded texts at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, rows):
                out = fn(b.slice(i, rows))
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(run, schema)


def col(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have (names are compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name
