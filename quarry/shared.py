"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where that is unset and the master is this machine is a temporary folder made and recorded
    in the session, so that one session always uses one folder. On a cluster executors would each
    write to a disk of their own, so there it is an error.
    """
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or getattr(context, "_quarry_shared_dir", None)
    if not at:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quarry-shared-")
        context._quarry_shared_dir = at
    return at.rstrip("/")


def written(df: DataFrame, name: str, once: bool = False) -> DataFrame:
    """Cut lineage with a table in that folder: what comes after reads it, whatever executors are lost.

    ``once``: shuffle files that only this step needed are deleted when it ends.
    """
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path = f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true" if once else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Delete a table that ``written`` made, when nothing reads it any more."""
    context = table.sparkSession.sparkContext
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        at = context._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores where its files are too few for that; as it is where there are enough.

    The planner's size decides: below one file partition for each core, which is little to move. A
    size that it cannot know is taken for large.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = spark.sparkContext.defaultParallelism
    most = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()) * cores
    return df.repartition(cores) if size < most else df


def tasks_for(*tables: DataFrame, bytes_each: int = 1 << 20) -> int:
    """How many tasks the planner's sizes of ``tables`` ask for: one for each core and each partition of a shuffle at least; unknown sizes count as none."""
    spark = tables[0].sparkSession
    sizes = (int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in tables)
    known = sum(size for size in sizes if size < 1 << 45)
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), min(known // bytes_each, 1 << 14))
