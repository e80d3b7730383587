"""Vectors packed into tiles, and all pairs of tiles brought together without copies on disk.

A tile is one row: its keys and the bytes of its vectors. Pairs of tiles are a join without
equal keys over the written tiles: a task reads the tiles of two parts and hands pairs to
Python in batches of bounded bytes, so nothing is shuffled and no side has to fit a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructType

from factweave.plans.checkpoint import stored

#: Rows of a tile, and rows of one that are multiplied at a time.
TILE, SLAB = 2048, 256


def dealt(key: str, tiles: Column) -> Column:
    """The tile, from 0, of a row with that key."""
    return F.pmod(F.xxhash64(F.lit("tile"), key), tiles).cast("int")


def packed(df: DataFrame, by: list[str], rest: list[str] | None = None) -> DataFrame:
    """``(by, keys, code, size, rest)``: a row for each tile (each value of ``by``) of ``df(by, key, v, rest)``, members in key order."""
    rest, kind = rest or [], df.schema["v"].dataType
    small = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", ignore_index=True)
        code = np.stack(pdf["v"].to_numpy()).astype(np.float32 if small else np.float64).tobytes()
        return pdf[by].iloc[:1].assign(keys=[pdf["key"].tolist()], code=[code], size=4 if small else 8, **{c: [pdf[c].tolist()] for c in rest})

    name = lambda c: df.schema[c].dataType.simpleString()
    kinds = [*[f"`{c}` {name(c)}" for c in by], f"keys array<{name('key')}>", "code binary", "size int", *[f"`{c}` array<{name(c)}>" for c in rest]]
    own = df if small else df.withColumn("v", F.col("v").cast(ArrayType(DoubleType())))
    return stored(own.select(*by, "key", "v", *rest).groupBy(*by).applyInPandas(pack, ", ".join(kinds)))


def matrix(tile: dict) -> np.ndarray:
    """The vectors of a tile, at norm 1."""
    m = np.frombuffer(tile["code"], np.float32 if tile["size"] == 4 else np.float64).reshape(len(tile["keys"]), -1).astype(np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1.0, norm)


def _spread(df: DataFrame) -> DataFrame:
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def meet(left: DataFrame, right: DataFrame, on: str, f: Callable[[dict, dict], pd.DataFrame], kinds: str) -> DataFrame:
    """The rows ``f(l, r)`` of all pairs of tiles that ``on``, over columns with ``l_`` and ``r_`` before them, lets meet."""
    names = [[c for c in df.columns if c != "ranges"] for df in (left, right)]
    sides = [_spread(df).select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns]) for p, df in zip("lr", (left, right), strict=True)]
    schema = to_arrow_schema(StructType.fromDDL(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                value = lambda c, batch=batch, at=at: x.as_buffer() if pa.types.is_binary((x := batch[c][at]).type) else x.as_py()
                out = f(*({c: value(f"{p}_{c}") for c in own} for p, own in zip("lr", names, strict=True)))
                if len(out):
                    yield pa.RecordBatch.from_pandas(out, schema=schema, preserve_index=False)

    met = sides[0].join(sides[1], F.expr(on)).select(*[f"{p}_{c}" for p, own in zip("lr", names, strict=True) for c in own])
    return met.mapInArrow(run, kinds)
