"""Session settings and the shared folder that queries cut their lineage with."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only while its rows, measured, have at most this many bytes.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`. Where it is unset, a local master gets a temporary folder
    of its own; a cluster has no folder to fall back on, so that is an error."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    at = tempfile.mkdtemp(prefix="lorekeep-")
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{at}")
    return f"file://{at}"


_scopes = threading.local()


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted at the end of the scratch scope that it was made in, or else when the JVM ends."""
    at = f"{shared_dir(spark)}/lorekeep/{label}-{uuid.uuid4().hex}"
    if getattr(_scopes, "open", None):
        _scopes.open[-1].append(at)
    path, system = _path(spark, at)
    system.deleteOnExit(path)
    return at


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are gone at its end: for calls that hand over results, not tables."""
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    _scopes.open.append([])
    try:
        yield
    finally:
        for at in _scopes.open.pop():
            path, system = _path(spark, at)
            system.delete(path, True)
            system.cancelDeleteOnExit(path)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes `df` as a table in the shared folder and reads it back: later stages neither recompute it
    nor depend on the executors that made it."""
    spark = df.sparkSession
    at = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """For stages that spend much time per row: an input in fewer files than there are cores, and too
    small to be split by bytes, is hash-partitioned over the cores. Large inputs stay as the scan splits them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > cores * (128 << 20) or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores, *keys)


def _bytes(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType | T.BinaryType):
        n = F.octet_length(c)
    elif isinstance(kind, T.ArrayType):
        n = F.aggregate(c, F.lit(0), lambda n, x: n + _bytes(x, kind.elementType).cast("int"))
    elif isinstance(kind, T.StructType):
        n = sum((_bytes(c[f.name], f.dataType) for f in kind.fields), F.lit(0))
    else:
        n = F.lit(8)
    return F.coalesce(n, F.lit(0)) + 8


def broadcastable(df: DataFrame) -> DataFrame:
    """Marks `df` for broadcast if its rows, summed up in one job, fit BROADCAST_BYTES; otherwise the join shuffles. Pass a written
    table, for it is read twice."""
    row = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    size = df.agg(F.sum(row.cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df
