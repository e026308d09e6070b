"""Tables in the folder that driver and executors share, and how they come to be."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Where it is unset, a folder is made in local mode only, as in tests; a cluster must name it."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = context.getCheckpointDir()
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def tidy(spark: SparkSession) -> SparkSession:
    """``spark``, from now on removing the shuffle files of each finished query at once, which else stay until the driver collects its garbage, and handing rows to
    Python in Arrow batches of 16 MB at most, as packed rows are long."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    return spark


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: it outlives a lost executor, and all readers see the same rows."""
    folder = new_folder(df.sparkSession, "table")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame, below: int = 128 << 20) -> DataFrame:
    """``df`` dealt out over all cores where it is smaller than one split of a scan: such a table is often a single row group, which a single task reads, and
    whatever follows would stay in that task. Larger tables, which scans split by themselves, are not moved."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < below else df
