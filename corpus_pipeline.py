"""A training-corpus pipeline: toxicity, near-duplicates, benchmark leaks, secrets, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage
before kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm import bpe, decontam, secret_scan, simhash, toxicity
from factweave.llm.common import ensure_checkpoint_dir, spread, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.7 or more go.

    Null and empty texts score as texts without hits and stay; rows with a null id, and each
    of repeated rows, are scored by their text. An empty table stays empty; all columns are kept.
    """
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return spread(docs).where(toxicity.score(F.col("text"), lexicon) < 0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by SimHash, the one of smallest id stays.

    Null, empty and blank texts are one group. Of rows that repeat an id one stays; rows
    without id stay. An empty table stays empty; all columns are kept.
    """
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay; rows with a null id and repeated rows are decided
    by their text. An empty table stays empty; all columns are kept.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and ``n_chars`` follows; the documents stay.

    Null texts stay null, texts without secrets and all other columns as they are; rows with a
    null id and repeated rows each. An empty table stays empty.
    """
    return secret_scan.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of each remaining document.

    Null texts are read as empty; rows with a null id and repeated rows each give a row. An
    empty table gives an empty result; columns but id and text are not read.
    """
    return bpe.encode(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("bpe", tokenize),
]

#: Merge rules, lexicons and fingerprints are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written as Parquet to the checkpoint folder and read again.

    A stage's table is removed when the next one is written. The one that the result reads
    stays; it can be removed when the result has been used.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, old = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if old is not None:
            remove(spark, old)
        old = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)


def remove(spark: SparkSession, path: str) -> None:
    """Delete ``path`` in whatever file system it is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
