"""Cosine similarity between and within tables of vectors, by blocks of matrix products.

Vectors are dealt to tiles by pivots, and pairs of tiles are multiplied; a table of
references is a set of tiles too, so neither side is gathered or copied for each tile of the other.
Pairs of tiles that are too far apart for the threshold are never formed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators.dedup import greedy_keep
from factweave.operators.sampling import hash_order, take_per_group
from factweave.operators.tiles import SLAB, TILE, matrix, meet, packed
from factweave.plans.checkpoint import cut

#: Pivots at most, and rings of angle a radian: they bound the cells.
PIVOTS, RINGS = 256, 32
#: Pairs are listed once there are so many a row at most; before, dense groups are thinned.
DENSE = 16
#: Keys of a pass that are walked in one task and whose kept ones are sent to all, and the least share of the rest that they have to take.
BLOCK, FEW = 2048, 0.1


def _unit(values: pd.Series) -> np.ndarray:
    m = np.stack(values.to_numpy()).astype(np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1.0, norm)


def _spread_out(x: np.ndarray, count: int) -> np.ndarray:
    """``count`` of the rows, each the farthest from those before."""
    chosen, best = [0], x @ x[0]
    while len(chosen) < min(count, len(x)):
        chosen.append(int(best.argmin()))
        best = np.maximum(best, x @ x[chosen[-1]])
    return x[chosen]


class Cells:
    """A partition of vectors into cells, and which pairs of cells can hold a pair of some cosine.

    A cell is a nearest pivot and a range of angles to it; rows of a crowded cell are dealt to tiles by hash.
    Of vectors ``x``, ``y`` at angles ``a``, ``b`` from pivots at angle ``d`` the angle is at least ``d - a - b``, ``a - d - b``
    and ``b - d - a``, so two cells whose ranges keep all of these over the threshold's angle need not meet.
    Pivots (rows far from one another, of a sample of eight times their number) and cells are bounded in number, whatever the rows.
    """

    def __init__(self, tables: list[DataFrame], tile: int | None = None, pivots: int = PIVOTS):
        tile, n = tile or TILE, max(df.count() for df in tables)
        self.spark = tables[0].sparkSession
        most = max(1, min(pivots, n // tile))
        some = next((got for df in reversed(tables) if len(got := df.orderBy(F.xxhash64("key"), "key").limit(8 * most).select("v").toPandas())), None)
        self.pivots = np.zeros((1, 1)) if some is None else _spread_out(_unit(some["v"]), most)
        self.placed = [self._placed(df) for df in tables]
        held = [df.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("n")).toPandas() for df in self.placed]
        count = pd.concat(held).groupby(["pivot", "ring"])["n"].max().sort_index() if any(map(len, held)) else pd.Series([], dtype=np.int64)
        rows, at, first = [], 0, 0
        for (pivot, ring), size in count.items():
            if not rows or rows[-1][1] != pivot or rows[-1][4] + size > tile:
                if rows:
                    first += rows[-1][5]
                rows.append([at, pivot, ring, ring, 0, 1, first])
                at += 1
            rows[-1][3], rows[-1][4] = ring, rows[-1][4] + size
            rows[-1][5] = -(-rows[-1][4] // tile)
        self.cells = pd.DataFrame(rows, columns=["cell", "pivot", "low", "high", "n", "tiles", "first"]).astype(np.int64)

    def _placed(self, df: DataFrame) -> DataFrame:
        pivots = self.pivots

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    cosine = np.clip(_unit(pdf["v"]) @ pivots.T, -1, 1)
                    near = cosine.argmax(axis=1)
                    yield pdf.assign(pivot=near, ring=np.floor(np.arccos(cosine[np.arange(len(near)), near]) * RINGS).astype(np.int64))

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return cut(df.mapInPandas(run, f"{kinds}, pivot long, ring long"))

    def partners(self, threshold: float | None) -> list[np.ndarray]:
        """For each cell those with which it can hold a pair; without a threshold all."""
        c = self.cells
        low, high = c["low"].to_numpy() / RINGS, (c["high"].to_numpy() + 1) / RINGS
        between = np.arccos(np.clip(self.pivots @ self.pivots.T, -1, 1))
        limit = np.inf if threshold is None else np.arccos(np.clip(threshold, -1, 1)) + 1e-6
        out = []
        for k, pivot in enumerate(c["pivot"]):
            d = between[pivot, c["pivot"]]
            least = np.maximum(d - high[k] - high, np.maximum(low[k] - d - high, low - d - high[k]))
            out.append(np.flatnonzero(least <= limit))
        return out

    def meetings(self, threshold: float | None) -> tuple[int, int]:
        """The pairs of tiles that meet, and those that there are."""
        tiles = self.cells["tiles"].to_numpy()
        return int(sum(t * tiles[p].sum() for t, p in zip(tiles, self.partners(threshold), strict=True))), int(tiles.sum()) ** 2

    def compare(self, threshold: float | None, f: Callable[[dict, dict], pd.DataFrame], kinds: str) -> DataFrame:
        """The rows ``f(l, r)`` of the pairs of tiles that meet: of one table each pair once, a tile with itself too, of two those of either."""
        first, tiles = self.cells["first"].to_numpy(), self.cells["tiles"].to_numpy()
        ranges = []
        for own in self.partners(threshold):
            merged: list[list[int]] = []
            for q in own:  # cells follow one another in their tiles
                if merged and merged[-1][1] == first[q]:
                    merged[-1][1] = int(first[q] + tiles[q])
                else:
                    merged.append([int(first[q]), int(first[q] + tiles[q])])
            ranges.append([tuple(m) for m in merged])
        kind = "cell long, pivot long, low long, high long, n long, tiles long, first long, ranges array<struct<low: int, high: int>>"
        cells = self.spark.createDataFrame([(*map(int, row), p) for row, p in zip(self.cells.to_numpy(), ranges, strict=True)], kind)
        out = []
        for df in self.placed:
            own = df.join(F.broadcast(cells.drop("n", "cell", "ranges")), (df["pivot"] == cells["pivot"]) & (df["ring"] >= cells["low"]) & (df["ring"] <= cells["high"]))
            names = [c for c in df.columns if c not in ("pivot", "ring")]
            at = own.select(*names, (F.col("first") + F.pmod(F.xxhash64("key"), F.col("tiles"))).cast("int").alias("t"))
            at = packed(at, ["t"], [c for c in names if c not in ("key", "v")])
            out.append(at.join(F.broadcast(cells.select("first", "tiles", "ranges")), (at["t"] >= F.col("first")) & (at["t"] < F.col("first") + F.col("tiles"))).drop("first", "tiles"))
        left, right = out[0], out[-1].drop("ranges")
        return meet(left, right, "exists(l_ranges, x -> r_t >= x.low AND r_t < x.high)" + " AND l_t <= r_t" * (len(out) == 1), f, kinds)


def similar_pairs(df: DataFrame, key: str, vec: str, threshold: float) -> DataFrame:
    """``(a, b, cosine)`` with ``a < b`` and cosine at the threshold or over it."""
    own = df.select(F.col(key).cast("long").alias("key"), F.col(vec).alias("v")).where("v IS NOT NULL")

    def run(left: dict, right: dict) -> pd.DataFrame:
        sim = matrix(left) @ matrix(right).T
        x, y = np.nonzero(sim >= threshold)
        a, b = np.asarray(left["keys"])[x], np.asarray(right["keys"])[y]
        out = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "cosine": sim[x, y]})
        return out[(a < b) if left["t"] == right["t"] else (a != b)]

    return Cells([own]).compare(threshold, run, "a long, b long, cosine double")


def best_similarity(df: DataFrame, refs: DataFrame, key: str, vec: str, ref_key: str, ref_vec: str, threshold: float | None = None) -> DataFrame:
    """``(key, best)``: each vector's greatest cosine to a reference; null without references.

    With ``threshold`` a value below it may be too small or null; those at it or over it are exact.
    """
    own = df.select(F.col(key).cast("long").alias("key"), F.col(vec).alias("v")).where("v IS NOT NULL")
    ref = refs.select(F.col(ref_key).cast("long").alias("key"), F.col(ref_vec).alias("v")).where("v IS NOT NULL")

    def run(left: dict, right: dict) -> pd.DataFrame:
        return pd.DataFrame({"key": left["keys"], "best": (matrix(left) @ matrix(right).T).max(axis=1)})

    found = Cells([own, ref]).compare(threshold, run, "key long, best double").groupBy("key").agg(F.max("best").alias("best"))
    return own.select("key").join(found, "key", "left").select(F.col("key").alias(key), "best")


def best_by_group(df: DataFrame, refs: DataFrame, key: str, vec: str, ref_key: str, ref_vec: str, group: str) -> DataFrame:
    """``(key, group, best)``: each vector's greatest cosine to the references of each group. A reference of several groups is compared once."""
    own = df.select(F.col(key).cast("long").alias("key"), F.col(vec).alias("v")).where("v IS NOT NULL").withColumn("groups", F.array().cast("array<string>"))
    ref = refs.where(F.col(ref_vec).isNotNull()).groupBy(F.col(ref_key).cast("long").alias("key")).agg(F.first(ref_vec).alias("v"), F.collect_set(F.col(group).cast("string")).alias("groups"))
    ref = cut(ref)

    def run(left: dict, right: dict) -> pd.DataFrame:
        sim, out = matrix(left) @ matrix(right).T, []
        for g in sorted({g for own in right["groups"] for g in own}):
            has = np.array([g in own for own in right["groups"]])
            out.append(pd.DataFrame({"key": left["keys"], "g": g, "best": sim[:, has].max(axis=1)}))
        return pd.concat(out) if out else pd.DataFrame()  # no frame without rows: an empty column of strings has no type

    found = Cells([own, ref]).compare(None, run, "key long, g string, best double")
    return found.groupBy("key", "g").agg(F.max("best").alias("best")).select(F.col("key").alias(key), F.col("g").alias(group), "best")


def far_from(rows: DataFrame, refs: DataFrame, threshold: float) -> DataFrame:
    """Rows ``(key, v)`` none of whose rows has a cosine at the threshold to one of the few rows ``refs(key, v)``, which each task holds."""
    some = refs.select("v").toPandas()["v"]
    sent = rows.sparkSession.sparkContext.broadcast(_unit(some).T if len(some) else None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), SLAB):
                part = pdf.iloc[at : at + SLAB]
                near = (_unit(part["v"]) @ sent.value >= threshold).any(axis=1)
                yield part.assign(v=part["v"].mask(near, None))

    if not len(some):
        return rows
    got = cut(rows.mapInPandas(run, f"key long, v {rows.schema['v'].dataType.simpleString()}"))  # near rows without their vectors
    return got.where("v IS NOT NULL").join(got.where("v IS NULL").select(F.col("key").alias("__near")).distinct(), F.col("key") == F.col("__near"), "left_anti")


def earlier_links(own: DataFrame, threshold: float) -> DataFrame:
    """``(key, before, links)``: for each key of ``own(key, v)`` with a partner of cosine at the threshold, the number of earlier partners and of all; no pair leaves a task."""

    def run(left: dict, right: dict) -> pd.DataFrame:
        a, b, x, y = np.asarray(left["keys"]), np.asarray(right["keys"]), matrix(left), matrix(right).T
        count = np.zeros((4, max(len(a), len(b))), np.int64)
        for at in range(0, len(a), SLAB):
            near = x[at : at + SLAB] @ y >= threshold
            near &= a[at : at + SLAB, None] != b[None, :]
            later = near & (b[None, :] < a[at : at + SLAB, None])
            count[0, at : at + len(near)], count[1, at : at + len(near)] = later.sum(1), near.sum(1)
            count[2, : len(b)] += (near & ~later).sum(0)
            count[3, : len(b)] += near.sum(0)
        out = pd.DataFrame({"key": a, "before": count[0, : len(a)], "links": count[1, : len(a)]})
        if left["t"] != right["t"]:
            out = pd.concat([out, pd.DataFrame({"key": b, "before": count[2, : len(b)], "links": count[3, : len(b)]})])
        return out[out["links"] > 0]

    return Cells([own]).compare(threshold, run, "key long, before long, links long").groupBy("key").agg(F.sum("before").alias("before"), F.sum("links").alias("links"))


def first_kept(rows: DataFrame, threshold: float, size: int) -> tuple[DataFrame, int] | None:
    """Of the ``size`` first keys of ``rows(key, v)`` those that the pass keeps, ``(key, v)``, and the last key looked at; None without rows."""
    last = rows.select("key").orderBy("key").limit(size).agg(F.max("key")).first()[0]
    if last is None:
        return None

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", ignore_index=True)
        key, x = pdf["key"].to_numpy(), _unit(pdf["v"])
        kept, gone = [], set()
        for at, k in enumerate(key.tolist()):
            if k not in gone:
                kept.append(at)
                gone.update(key[at:][(x[at:] @ x[at] >= threshold) & (key[at:] > k)].tolist())
        kept = [at for at in kept if key[at] not in gone]
        return pdf.iloc[kept][["key", "v"]]

    kind = rows.schema["v"].dataType.simpleString()
    return cut(rows.where(F.col("key") <= last).groupBy(F.lit(0).alias("one")).applyInPandas(walk, f"key long, v {kind}")), last


def semantic_dedup(df: DataFrame, key: str, vec: str, threshold: float = 0.70, dense: int = DENSE, block: int = BLOCK, few: float = FEW) -> DataFrame:
    """Rows kept by a pass in key order that drops later rows similar to a kept one.

    The first ``block`` keys are walked, and what lies near their kept ones goes, as long as that
    takes ``few`` of the rest: rows times kept rows are compared then, not rows times rows. Of what
    is left the links are counted. While there are many a row, the keys without an earlier partner are
    kept and their partners dropped, from counts alone; the links of the rest are then listed
    for ``greedy_keep``. All give what the pass gives.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vec).alias("v")).where("v IS NOT NULL")
    left, kept, lost = rows, [], []
    while (found := first_kept(left, threshold, block)) is not None:
        first, last = found
        kept.append(first.select("key"))
        later = left.where(F.col("key") > last)
        before = later.count()
        if not before:
            left = later
            break
        left = cut(far_from(later, first, threshold))
        if left.count() > (1 - few) * before:
            break
    whole = left.select("key")
    while True:
        linked = cut(earlier_links(left, threshold))
        left = cut(left.join(linked.select("key"), "key", "left_semi"))
        load = linked.agg(F.sum("links").alias("s"), F.count(F.lit(1)).alias("n")).first()
        if (load["s"] or 0) <= 2 * dense * load["n"]:
            break
        first = cut(left.join(linked.where("before = 0").select("key"), "key", "left_semi"))
        rest = left.join(first.select("key"), "key", "left_anti")
        best = best_similarity(rest, first, "key", "v", "key", "v", threshold)
        gone = cut(best.where(F.col("best") >= threshold).select("key"))
        lost.append(gone)
        left = cut(rest.join(gone, "key", "left_anti"))
    keep = greedy_keep(left, similar_pairs(left, "key", "v", threshold), "key")
    for gone in [*lost, left.select("key").join(keep, "key", "left_anti")]:
        whole = whole.join(gone.withColumnRenamed("key", "__lost"), F.col("key") == F.col("__lost"), "left_anti")
    for first in kept:
        whole = whole.unionByName(first)
    gone = rows.select(F.col("key").alias("__lost")).join(whole, F.col("__lost") == F.col("key"), "left_anti")
    return df.join(gone, F.col(key) == F.col("__lost"), "left_anti")


def semantic_decontaminate(df: DataFrame, refs: DataFrame, key: str, vec: str, ref_key: str, ref_vec: str, threshold: float = 0.90) -> DataFrame:
    """Rows whose greatest cosine to a reference is under the threshold; an empty side leaves ``df`` as it is."""
    near = best_similarity(df, refs, key, vec, ref_key, ref_vec, threshold).where(F.col("best") >= threshold)
    return df.join(near.select(key), key, "left_anti")


def avg_cosine_distance(df: DataFrame, vec: str, by: list[str] | None = None) -> DataFrame:
    """Mean of 1 - cosine over all pairs of a group, from the sum of the unit vectors; no pair is formed."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = df.select(*(by or []), F.posexplode(F.transform(vec, lambda x: x.cast("double") / norm)).alias("d", "x"))
    sums = unit.groupBy(*(by or []), "d").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    n = F.max("n")
    return sums.groupBy(*(by or [])).agg(F.when(n > 1, (n * n - F.sum(F.col("s") * F.col("s"))) / (n * (n - 1))).otherwise(F.lit(0.0)).alias("distance"))


def sampled_distances(df: DataFrame, key: str, vec: str, by: list[str], rows: int = 2_000, pairs: int = 100_000, seed: int = 42) -> DataFrame:
    """``(by, a, b, distance)``: 1 - cosine of ``pairs`` pairs (or all) of ``rows`` rows (or all) of each group, both taken in hash order.

    The sample is the operator's own limit, for a density plot.
    """
    some = take_per_group(df.select(*by, F.col(key).alias("key"), F.col(vec).alias("v")), by, rows, hash_order("key", seed), "key")
    left, right = some.withColumnsRenamed({"key": "a", "v": "x"}), some.withColumnsRenamed({"key": "b", "v": "y"})
    both = left.join(right, by).where("a < b") if by else left.join(right, F.col("a") < F.col("b"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s.cast("double") * t.cast("double")), F.lit(0.0), lambda s, t: s + t)
    far = both.select(*by, "a", "b", (1 - dot("x", "y") / F.sqrt(dot("x", "x") * dot("y", "y"))).alias("distance"), F.concat_ws("-", "a", "b").alias("pair"))
    return take_per_group(far, by, pairs, hash_order("pair", seed), "pair").drop("pair")
