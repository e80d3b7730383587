"""File sources and sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("jsonl", "json", "csv", "tsv", "parquet")


def read(spark: SparkSession, kind: str, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines, a JSON array, CSV or TSV with a header and quoted line breaks, or Parquet. A schema avoids a pass for inference."""
    reader = spark.read if schema is None or kind == "parquet" else spark.read.schema(schema)
    if kind == "jsonl":
        return reader.json(path)
    if kind == "json":
        return reader.json(path, multiLine=True)
    if kind in ("csv", "tsv"):
        return reader.csv(path, header=True, sep="\t" if kind == "tsv" else ",", quote='"', escape='"', multiLine=True)
    if kind == "parquet":
        return reader.parquet(path)
    raise ValueError(f"unknown format {kind}")


def read_log_files(spark: SparkSession, root: str) -> DataFrame:
    """Whole JSON files below ``root`` as ``raw``, with their path and the run that their folder names."""
    got = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    return got.select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("path"), F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+/[^/]+$", 1).alias("source_run"))


def write_stage(df: DataFrame, path: str, by: str | None = None) -> DataFrame:
    """A stage's result as snappy Parquet, read again."""
    writer = df.write.mode("overwrite").option("compression", "snappy")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_metrics(df: DataFrame, path: str, force: bool = False) -> bool:
    """One JSON file of metrics; kept as it is if it exists and ``force`` is not set. Whether it was written."""
    try:
        df.coalesce(1).write.mode("overwrite" if force else "errorifexists").json(path)
    except AnalysisException as e:
        if "PATH_ALREADY_EXISTS" in str(e):
            return False
        raise
    return True


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet cache; an empty table of ``schema`` if there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def pass_through(spark: SparkSession, source: str, target: str, pattern: str = "*.jsonl", without: tuple[str, ...] = ("train.jsonl",)) -> list[str]:
    """Copy the files of folder ``source`` that match ``pattern``, but for ``without``, to ``target`` as they are; their names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    to = path(target)
    to.getFileSystem(conf).mkdirs(to)
    done = []
    for found in path(source).getFileSystem(conf).globStatus(path(f"{source}/{pattern}")) or []:
        name = found.getPath().getName()
        if name not in without:
            jvm.org.apache.hadoop.fs.FileUtil.copy(found.getPath().getFileSystem(conf), found.getPath(), to.getFileSystem(conf), path(f"{target}/{name}"), False, conf)
            done.append(name)
    return sorted(done)
