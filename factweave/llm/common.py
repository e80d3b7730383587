"""Helpers that the operators of this folder share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from factweave.operators.components import components as connected_components

__all__ = ["connected_components", "cut", "ensure_checkpoint_dir", "forest", "fresh", "spread", "stored", "table", "text_chunks"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session names in ``spark.checkpoint.dir``; only a local session without one gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="factweave-checkpoint-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet under the checkpoint folder and read from there; unlike ``cut``, plans over it know its size."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if it has fewer partitions than there are (a table of one small file); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def text_chunks(texts: list[str], chars: int) -> Iterator[list[str]]:
    """Runs of texts of about so many characters (a longer text by itself), so that what is built for a run is bounded."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > chars:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links ``a[i]``-``b[i]``: each linked node and the smallest node of its group (roots themselves left out)."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        if np.array_equal(before, label):
            break
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]
