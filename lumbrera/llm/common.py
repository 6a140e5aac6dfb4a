"""Shared helpers: written intermediate tables, and batches bounded by bytes."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes of text that one step of a Python operator holds as numpy arrays.
SLICE_BYTES = 4 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, one of a local session's own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = f"{tempfile.gettempdir()}/lumbrera-{os.getpid()}"
    return shared.rstrip("/") + "/llm"


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append((spark, path))
    return path


def _hadoop(spark: SparkSession, path: str):  # noqa: ANN202
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def delete_path(spark: SparkSession, path: str) -> None:
    store, path = _hadoop(spark, path)
    store.delete(path, True)


def make_folder(spark: SparkSession, path: str) -> None:
    store, path = _hadoop(spark, path)
    store.mkdirs(path)


_scopes: list[list[tuple[SparkSession, str]]] = []


@contextlib.contextmanager
def scratch_scope(*keep: str) -> Iterator[None]:
    """What is written under the scratch folder within goes at the end, but for tables whose names begin with one of ``keep``.

    For steps whose results are written or collected before the end.
    """
    _scopes.append(held := [])
    try:
        yield
    finally:
        _scopes.pop()
        for spark, path in held:
            if not path.rpartition("/")[2].startswith(tuple(f"{k}-" for k in keep)):
                delete_path(spark, path)


class Written:
    """A DataFrame written as Parquet in the shared folder, so that lost executors cost no recomputation."""

    def __init__(self, df: DataFrame, name: str, compression: str = "zstd"):
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, name)
        self.schema = df.schema
        # The table replaces the plan, so the plan's shuffle files can go as soon as it is written.
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", compression).parquet(self.path)
        finally:
            self.spark.conf.set(_CLEANUP, before)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        delete_path(self.spark, self.path)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns; others, whatever their names, are dropped before any join."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def input_bytes(df: DataFrame, column: str) -> int:
    """Total UTF-8 bytes of a column, for partition counts only."""
    return df.agg(F.sum(F.octet_length(F.col(column)).cast("long"))).first()[0] or 0


def buckets_for(total_bytes: int, each: int, least: int = 1) -> int:
    return max(least, -(-total_bytes // each))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each slice holds about ``limit`` bytes of the named column, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    drop_stale()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < n:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def give_back() -> None:
    """Return freed memory to the system, which an idle Python worker would otherwise hold beside the next operator's."""
    import ctypes
    import sys

    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL("libc.so.6").malloc_trim(0)


_kept: dict[tuple, object] = {}
_kept_stage = -1


def _stage() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.stageId() if context else -1


def drop_stale() -> None:
    """Forget what earlier stages kept in this Python worker."""
    global _kept_stage
    if _kept_stage != (now := _stage()):
        _kept.clear()
        _kept_stage = now
        give_back()


def kept_for_stage(make, *key):  # noqa: ANN001, ANN201
    """``make(*key)``, once per stage and Python worker, so that a stage's tasks share what they have learned."""
    drop_stale()
    if (make, *key) not in _kept:
        _kept[(make, *key)] = make(*key)
    return _kept[(make, *key)]
