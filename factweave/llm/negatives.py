"""Hard-negative mining by a full sort of each anchor's integer scores.

Anchors and rows are dealt to blocks and parts; a task has one block of anchors and one part of
the rows, sorts every anchor's scores in that part (higher first, then smaller id), finds by
binary search where a positive's upper limit begins, and reads the next rows of other labels
down to the lower limit. The best of all parts are the best of the table, so the first pass
merges the positives of the parts and the second, with the limits they set, the negatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from factweave.llm.common import spread, stored

POSITIVES, NEGATIVES = 5, 10
#: Components of the anchors, and of the rows, of one task.
ELEMENTS = 4_000_000
#: Scores that are held at once.
SCORES = 2_000_000


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components as floor(256 x): four bytes each where they fit, else as doubles."""
    for pdf in batches:
        code, width = [], []
        for v in pdf["v"]:
            with np.errstate(over="ignore"):
                m = np.floor(256 * np.asarray(v, np.float64))
            kind = "<i4" if np.abs(m).max(initial=0) < 1 << 31 else "<f8"
            code.append(m.astype(kind).tobytes())
            width.append(int(kind[2]))
        yield pdf[["id", "label", "place", "anchor"]].assign(code=code, width=np.array(width, np.int32))


def matrix(code: pd.Series, width: pd.Series) -> np.ndarray:
    """The packed vectors as rows; shorter ones are filled with zeros, which add nothing to a product."""
    rows = [np.frombuffer(c, f"<{'i' if w == 4 else 'f'}{w}") for c, w in zip(code, width, strict=True)]
    if len({len(r) for r in rows}) == 1:
        return np.stack(rows).astype(np.float64)
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of ``a`` and ``b``, exact; one beyond 64 bits is an error."""
    n = min(a.shape[1], b.shape[1])
    a, b = a[:, :n], b[:, :n]
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * n < 1 << 53:
        return (a @ b.T).astype(np.int64)
    if not (np.isfinite(a).all() and np.isfinite(b).all()):
        raise OverflowError("a component times 256 is beyond double precision")
    whole = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (a, b)]
    return np.array(whole[0] @ whole[1].T, dtype=object).astype(np.int64)


def ranked(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``s``, whose columns are in order of id: columns by falling score and id, and their scores."""
    bits = max(1, int(s.shape[1] - 1).bit_length())
    if int(np.abs(s).max(initial=0)) < 1 << (62 - bits):  # score and column in one number sort at once
        key = np.sort((-s << bits) | np.arange(s.shape[1]), axis=1)
        return key & ((1 << bits) - 1), -(key >> bits)
    order = np.lexsort((np.broadcast_to(np.arange(s.shape[1]), s.shape), -s))
    return order, np.take_along_axis(s, order, axis=1)


def limits(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest score ``n`` with ``30 p <= 100 n <= 90 p``, without products that could overflow."""
    tens, ones = positive // 10, positive % 10
    return 3 * tens - (-3 * ones // 10), 9 * tens + 9 * ones // 10


def _slabs(anchors: pd.DataFrame, rows: pd.DataFrame):
    """For runs of anchors: their rows in the frame, the ranked rows of the part, and their scores."""
    rows = rows.sort_values(["id", "place"], ignore_index=True)
    a, b = matrix(anchors["code"], anchors["width"]), matrix(rows["code"], rows["width"])
    step = max(1, SCORES // max(1, len(rows)))
    for at in range(0, len(anchors), step):
        yield slice(at, at + step), rows, *ranked(scores(a[at : at + step], b))


def _positives(count: int):
    """The part's first rows of each anchor's label."""

    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"anchor": [], "row": [], "id": [], "score": []}, dtype=np.int64)]
        if len(anchors) and len(rows):
            for own, part, order, score in _slabs(anchors, rows):
                label, place = anchors["label"].to_numpy()[own, None], anchors["place"].to_numpy()[own, None]
                same = (part["label"].to_numpy()[order] == label) & (part["place"].to_numpy()[order] != place)
                k, at = np.nonzero(same & (np.cumsum(same, axis=1) <= count))
                row = order[k, at]
                out.append(pd.DataFrame({"anchor": place[k, 0], "row": part["place"].to_numpy()[row], "id": part["id"].to_numpy()[row], "score": score[k, at]}))
        return pd.concat(out)

    return run


def _negatives(count: int):
    """The part's first rows of other labels between the limits of each positive."""

    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"anchor": [], "k": [], "row": [], "id": [], "score": []}, dtype=np.int64)]
        if len(anchors) and len(rows):
            for own, part, order, score in _slabs(anchors, rows):
                label, place = part["label"].to_numpy(), part["place"].to_numpy()
                ids = part["id"].to_numpy()
                for anchor, of, targets, line, falling in zip(anchors["place"].to_numpy()[own], anchors["label"].to_numpy()[own], anchors["positives"].to_numpy()[own], order, score, strict=True):
                    other = np.flatnonzero(label[line] != of)  # places in the sorted list
                    rising = -falling[other]
                    least, most = limits(np.asarray(targets, np.int64))
                    begin, end = np.searchsorted(rising, -most, "left"), np.searchsorted(rising, -least, "right")
                    size = np.clip(np.minimum(end, begin + count) - begin, 0, None)
                    k = np.repeat(np.arange(len(size)), size)
                    at = other[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
                    out.append(pd.DataFrame({"anchor": np.full(len(at), anchor), "k": k, "row": place[line[at]], "id": ids[line[at]], "score": falling[at]}))
        return pd.concat(out)

    return run


def _first(found: DataFrame, keys: list[str], count: int) -> DataFrame:
    """Of each key the first ``count`` rows by falling score, id and place, numbered from 1."""
    by = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= count)


def mine(
    vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, elements: int = ELEMENTS,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for the rows of ``vectors`` where ``anchor`` holds.

    A score is the integer inner product of floor(256 x) over the components; higher
    ones come first, ties by smaller id. An anchor's positives are its first ``positives``
    other rows of its label, a positive's negatives the first ``negatives`` rows of other labels
    with ``30 * positive_score <= 100 * negative_score <= 90 * positive_score``.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Rows that
    repeat an id are rows of their own; such anchors are mined each, and rows equal in score and id
    follow in the order in which they were written. Vectors of different lengths meet over the components
    that both have. A pair without negatives gives no row, an empty table an empty result. A score
    beyond 64 bits is an error. Other columns are not read.
    """
    v = F.col(vec_col).cast(ArrayType(DoubleType()))
    of = F.col(label) if isinstance(label, str) else label
    finite = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    good = vectors.select(F.col(id_col).cast("long").alias("id"), of.cast("long").alias("label"), v.alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    good = spread(good.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)).withColumn("place", F.monotonically_increasing_id())
    rows = stored(good.mapInPandas(_packed, "id long, label long, place long, anchor boolean, code binary, width int"))
    n = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("anchor").alias("anchors"), F.max(F.octet_length("code") / F.col("width")).alias("dim")).first()
    per = max(1, int(elements // max(1, n["dim"] or 1)))
    blocks, parts = max(1, -(-n["anchors"] // per)), max(1, -(-n["rows"] // per))
    deal = lambda seed, into: F.pmod(F.xxhash64(F.lit(seed), "place"), F.lit(into)).cast("int")
    every = lambda into: F.explode(F.sequence(F.lit(0), F.lit(into - 1)))
    anchors = rows.where("anchor").withColumn("block", deal(1, blocks)).withColumn("part", every(parts)).drop("anchor")
    copies = rows.select(*(F.col(c).alias(c) for c in ("id", "label", "place", "code", "width")), deal(2, parts).alias("part"), every(blocks).alias("block")).groupBy("block", "part")
    found = anchors.groupBy("block", "part").cogroup(copies).applyInPandas(_positives(positives), "anchor long, row long, id long, score long")
    best = stored(_first(found, ["anchor"], positives))
    targets = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("t")).select(F.col("anchor").alias("place"), F.col("t.score").alias("positives"))
    found = anchors.join(targets, "place").groupBy("block", "part").cogroup(copies).applyInPandas(_negatives(negatives), "anchor long, k int, row long, id long, score long")
    names = rows.where("anchor").select(F.col("place").alias("anchor"), F.col("id").alias("anchor_id"))
    pairs = best.select("anchor", (F.col("rank") - 1).alias("k"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(names, "anchor")
    return _first(found, ["anchor", "k"], negatives).join(pairs, ["anchor", "k"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
