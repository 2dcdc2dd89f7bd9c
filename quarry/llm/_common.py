"""Helpers shared by the training-data operators: tables, shared workspace, Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.shared import shared_dir
from quarry.shipping import ship

#: Rows and bytes of one Arrow batch handed to Python, whichever comes first; one row is the least.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, on storage that
    outlives any executor."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    _scratch[-1].append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Intermediate tables by the step that they belong to; the first list is the session's.
_scratch: list[list[tuple[SparkSession, str]]] = [[]]


def _delete_all(paths: list[tuple[SparkSession, str]]) -> None:
    while paths:
        delete_path(*paths.pop())


@contextmanager
def scratch() -> Iterator[None]:
    """Intermediate tables written inside are deleted at the end: what needs them must be written
    by then, under a path of its own. Those written outside any go when the driver's Python ends."""
    _scratch.append([])
    try:
        yield
    finally:
        _delete_all(_scratch.pop())


@atexit.register
def _at_the_end() -> None:
    if _scratch[0] and _scratch[0][0][0].sparkContext._gateway is not None:
        try:
            _delete_all(_scratch[0])
        except Exception:  # noqa: BLE001 - the JVM may be gone already, and its session with it
            pass


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``written`` for what ``make`` gives; the tables that it wrote on its way are deleted then, and
    inside a ``scratch`` also what that held before, which is the input of a step that is done."""
    with scratch():
        out = make()
        path = fresh_path(out.sparkSession, name)
        out.write.parquet(path)
    if len(_scratch) > 1:
        _delete_all(_scratch[-1])
    _scratch[-1].append((out.sparkSession, path))
    return out.sparkSession.read.schema(out.schema).parquet(path)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns renamed c0, c1, ...: no name of the caller's can clash or need quoting."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def as_row(df: DataFrame) -> DataFrame:
    """One column, ``row``: the whole row as a struct."""
    return df.select(F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns)).alias("row"))


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], added: StructType | None = None) -> DataFrame:
    """``mapInArrow`` that keeps the columns c0, c1, ... of ``numbered(df)`` and adds some."""
    small_batches(df.sparkSession)
    plain = numbered(df)
    return plain.mapInArrow(lean(run), StructType([*plain.schema, *(added or [])]))


def written_once(df: DataFrame, name: str) -> DataFrame:
    """``written``, and the shuffle files that only this step needed are deleted when it ends."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        return written(df, name)
    finally:
        spark.conf.set(key, before)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives freed memory back: it waits beside the next stages, which may not need it."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return go


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """Make ready for Python workers: bound what one Arrow batch of whole texts can take."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def parts(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def input_bytes(docs: DataFrame) -> int:
    """Bytes that ``docs`` reads, as the optimizer has it from its files; counted where it can't know."""
    known = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known < 1 << 58:
        return known
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


#: What operators keep in a Python worker between tasks, and how to let go of it.
_kept: dict[str, Callable[[], None]] = {}


def keeps(name: str, forget: Callable[[], None]) -> None:
    _kept[name] = forget


def only(name: str) -> None:
    """Called where an operator starts in a worker: what the other operators kept there is let go."""
    for other in [k for k in _kept if k != name]:
        _kept.pop(other)()
