"""Intermediate tables in the cluster's shared folder.

Lineage is cut by written Parquet tables, so a lost executor costs a re-read
and never a recomputation of earlier stages.
"""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from contextlib import contextmanager
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.ship import ship

_written: dict[str, SparkSession] = {}


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset a temporary one of this process, on a local master only: other machines would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="veilspark-")
        _own[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


#: Bytes of an Arrow batch that goes to a Python worker; rows may be long texts, and both sides hold a batch or two.
BATCH_BYTES = 4 << 20


@cache
def _trim():
    """The C library's malloc_trim; where it has none, a function that does nothing."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return lambda pad: 0


def release() -> None:
    """Gives memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def _releasing(function):
    """`function`, after which its worker, which then idles or runs other tasks, holds no memory that it has freed."""

    def run(batches):
        try:
            yield from function(batches)
        finally:
            release()

    return run


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """`df.mapInArrow` with batches bounded in bytes; a session that bounds them itself, and lower, keeps its own bound. Workers give freed memory back after each task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(key, None)
    digits = (now or "").rstrip("bB")
    if not digits.isdigit() or not 0 < int(digits) <= BATCH_BYTES:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return ship(df).mapInArrow(_releasing(function), schema)


#: Under this setting Spark deletes a query's shuffle files at its end, not when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaning(spark: SparkSession):
    """Queries of `spark` that run within leave no shuffle files; afterwards the setting is as it was."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def put(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` as a table of this run and returns it as read back. Its shuffle files go with the query."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veilspark/{name}-{uuid.uuid4().hex}"
    with _cleaning(spark):
        df.write.option("compression", "zstd").parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._veilspark_path = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Deletes tables made by `put` that no result reads any more."""
    for table in tables:
        path = getattr(table, "_veilspark_path", None)
        if path in _written:
            _delete(path, _written.pop(path))


def _delete(path: str, spark: SparkSession) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Ids that a join may broadcast: 8 MB of longs. More are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def join_ids(rows: DataFrame, key: str, ids: DataFrame, how: str) -> DataFrame:
    """`rows` whose `key` is in (left_semi) or not in (left_anti) the one-column table `ids`; wide rows are not shuffled while the ids are few."""
    own = f"_id_{uuid.uuid4().hex[:12]}"  # no column of `rows` has it
    ids = ids.select(F.col(ids.columns[0]).alias(own))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return rows.join(ids, F.col(key) == F.col(own), how)


@atexit.register
def _sweep() -> None:
    for path, spark in list(_written.items()):
        if spark.sparkContext._jsc is not None:
            try:
                _delete(path, spark)
            except Exception:  # noqa: BLE001 - the JVM may have ended first
                return
