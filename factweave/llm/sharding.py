"""Rendezvous sharding of stable record keys over weighted shards, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets in which slots are numbered; a bucket of a shard is numbered by one task, the buckets' offsets are prefix sums.
BUCKETS = 4096


def shard_scores(key: Column, weights: Sequence[float], first: int = 0) -> list[Column]:
    """Each shard's score for ``key``: ``weight / -ln(u)`` with ``u`` uniform in (0, 1) by the hash of key and shard."""
    out = []
    for shard, weight in enumerate(weights, first):
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) * F.lit(2.0**-53)
        out.append(F.lit(float(weight)) / -F.log(F.least(u, F.lit(1 - 2.0**-53))))  # the greatest hash would round to 1
    return out


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of highest score; of equal scores the lower shard. A shard of weight w gets w of each sum of weights.

    Decided by ``key`` alone: null keys share a shard, repeated keys too. An empty list of weights is an error.
    """
    scores = F.array(*shard_scores(key, weights))
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] = (1.0,) * 16, new_weight: float = 1.0) -> DataFrame:
    """Every row of ``docs`` in a shard: ``(id, size, text_crc32, shard, slot, grown_shard)``.

    Law: key and number of shards decide. ``grown_shard`` is the shard when one
    more of ``new_weight`` is added; scores of old shards stay, so a row moves only
    into the new one. ``size`` is the UTF-8 bytes of the text (null: none) plus 1,
    ``text_crc32`` that of the bytes (null: of none). ``slot`` numbers the rows of a
    shard from 0 without gaps. Rows that repeat a key share its shard and have
    slots of their own; null keys hash alike and share one. An empty table gives an
    empty result; columns that are not named are not read.

    Numbering needs no task that holds a shard: rows are numbered within hash
    buckets of (shard, key, text), and each bucket starts at the sum of those before.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    scores = F.array(*shard_scores(F.col("id"), weights))
    rows = rows.withColumn("scores", scores).select(
        "id",
        "size",
        "text_crc32",
        (F.array_position("scores", F.array_max("scores")) - 1).cast("int").alias("shard"),
        F.when(shard_scores(F.col("id"), [new_weight], len(weights))[0] > F.array_max("scores"), len(weights)).otherwise(F.array_position("scores", F.array_max("scores")) - 1).cast("int").alias("grown_shard"),
        F.pmod(F.xxhash64("id", "size", "text_crc32"), F.lit(BUCKETS)).cast("int").alias("bucket"),
    )
    sums = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("shard").alias("of"), F.col("bucket").alias("part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "bucket").orderBy("id", "size", "text_crc32")
    return (
        rows.withColumn("place", F.row_number().over(order))
        .join(starts, (F.col("shard") == F.col("of")) & (F.col("bucket") == F.col("part")))
        .select("id", "size", "text_crc32", "shard", (F.col("start") + F.col("place") - 1).cast("long").alias("slot"), "grown_shard")
    )
