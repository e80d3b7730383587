"""Cutting lineage in loops, in a folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; only a local session without one gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="factweave-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def run_folder(spark: SparkSession) -> str:
    """The path of a new folder below it."""
    return f"{checkpoint_folder(spark)}/run-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete ``path``, in whatever file system it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clean_up(spark: SparkSession) -> None:
    """Delete all that this session has written to its checkpoint folder; results that still read from there must have been used."""
    remove(spark, checkpoint_folder(spark))
    spark.sparkContext.setCheckpointDir(spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="factweave-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, in compressed columns, for tables of long rows; plans over it know its size."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(spark: SparkSession) -> None:
    """Let go of shuffle files and checkpoints that no plan holds any more: Spark's cleaner frees them behind the collectors."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(df: DataFrame) -> None:
    """Delete the table under ``df`` that ``stored`` wrote, once no lazy result reads it."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        remove(df.sparkSession, path)
    free(df.sparkSession)
