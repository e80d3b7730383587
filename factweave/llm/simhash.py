"""SimHash near-duplicates: exact Hamming links found by vantage-point search.

A vantage-point tree prunes by the triangle bound ``|d(q, v) - d(x, v)| <= r``.
On fingerprints of unrelated texts all distances to a vantage point lie in
32 +- 4, so with r = 4 about three quarters of the points overlap any split and a
tree over all fingerprints compares nearly all pairs. The fingerprints are
therefore first dealt to shards by the bits of block combinations (two
fingerprints within r bits agree on ``blocks - r`` whole blocks, so each link
meets in some shard: an exact cover), and vantage points work where points are
dense: a shard above ``shard_rows`` is split into shells by distance from its
vantage point, with each shell's lower border copied into the shell below, and
inside a shard a vantage-point tree answers the radius queries; a shard of a few
points has one vantage point and is compared in order of the distance from it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import connected_components, cut, forest, fresh, spread

SEED = 42
SHARD_ROWS = 20_000
PLAIN_ROWS = 48


def fingerprint(text: str | None, words: int = 4) -> int:
    """The unsigned 64-bit SimHash of the word shingles of ``text``, lower-cased in A-Z (null, empty or blank: 0)."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    flat = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(flat, SEED)
    size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(size)
    begin = (ends - size)[: len(parts) - words + 1].tolist()
    end = (ends - 1)[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(flat[i:j], SEED) for i, j in zip(begin, end, strict=True)], np.uint64)
    over = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        over += np.unpackbits(h[at : at + (1 << 15)].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int((np.where(over * 2 > len(h), 1, 0).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``(id, fp)``: one row per row of ``docs``, ``fp`` the signed long with the fingerprint's bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.fromiter((fingerprint(t, words) for t in pdf["text"]), np.uint64, len(pdf))
            yield pd.DataFrame({"id": pdf["id"], "fp": fp.view(np.int64)})

    return spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))).mapInPandas(run, "id long, fp long")


class VantageTree:
    """A vantage-point tree over unsigned 64-bit fingerprints under Hamming distance."""

    def __init__(self, points: np.ndarray, leaf: int = 256):
        self.points, self.leaf = points, leaf
        self.root = self._build(np.arange(len(points)), 0)

    def _build(self, own: np.ndarray, depth: int):
        if len(own) <= self.leaf or depth > 40:
            return own
        v = self.points[own[0]]
        d = np.bitwise_count(self.points[own] ^ v)
        mid = int(np.median(d))
        near = d <= mid
        if near.all():
            near = d < mid
        if near.all() or not near.any():
            return own
        low, high = d[near], d[~near]
        return (v, (int(low.min()), int(low.max()), self._build(own[near], depth + 1)), (int(high.min()), int(high.max()), self._build(own[~near], depth + 1)))

    def within(self, q: np.uint64, radius: int) -> np.ndarray:
        """Positions of all points at most ``radius`` bits from ``q``."""
        found, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, np.ndarray):
                found.append(node[np.bitwise_count(self.points[node] ^ q) <= radius])
                continue
            d = int(np.bitwise_count(node[0] ^ q))
            stack += [child for low, high, child in node[1:] if low - radius <= d <= high + radius]
        return np.concatenate(found) if found else np.empty(0, np.int64)


def _tree_links(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among ``fp``: each point is queried once."""
    tree, free = VantageTree(fp), np.ones(len(fp), bool)
    a, b = [], []
    for start in range(len(fp)):
        if not free[start]:
            continue
        free[start] = False
        queue = [start]
        while queue:
            at = queue.pop()
            near = tree.within(fp[at], radius)
            near = near[free[near]]
            free[near] = False
            a += [at] * len(near)
            b += near.tolist()
            queue += near.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def _shard_links(radius: int):
    """Links within each shard of a partition; only a spanning forest of them leaves the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [(p["shard"].to_numpy(), p["fp"].to_numpy(), p["rep"].to_numpy()) for p in batches]
        if not got:
            return
        shard, fp, rep = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        order = np.argsort(shard, kind="stable")
        shard, fp, rep = shard[order], fp[order].view(np.uint64), rep[order]
        first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.empty(0, np.int64)
        count = np.diff(np.r_[first, len(shard)])
        a, b = [], []
        of = np.repeat(count, count)
        small = np.flatnonzero((of > 1) & (of <= PLAIN_ROWS))
        # The first point of a small shard is its vantage point: in order of distance from it, only neighbours within the radius can link.
        d = np.bitwise_count(fp[small] ^ fp[np.repeat(first, count)[small]]).astype(np.int64)
        order = np.lexsort((d, shard[small]))
        small, d = small[order], d[order]
        s, f, r = shard[small], fp[small], rep[small]
        for k in range(1, PLAIN_ROWS):
            same = np.flatnonzero((s[k:] == s[:-k]) & (d[k:] - d[:-k] <= radius)) if k < len(s) else np.empty(0, np.int64)
            if not len(same):
                break
            near = same[np.bitwise_count(f[same] ^ f[same + k]) <= radius]
            a.append(r[near])
            b.append(r[near + k])
        for at, n in zip(first[count > PLAIN_ROWS].tolist(), count[count > PLAIN_ROWS].tolist(), strict=True):
            x, y = _tree_links(fp[at : at + n], radius)
            a.append(rep[at + x])
            b.append(rep[at + y])
        if a and sum(map(len, a)):
            x, y = forest(np.concatenate(a), np.concatenate(b))
            yield pd.DataFrame({"a": x, "b": y})

    return run


def links(points: DataFrame, radius: int = 4, blocks: int | None = None, shard_rows: int = SHARD_ROWS, levels: int = 3) -> DataFrame:
    """``(a, b)``: links that connect the ``rep`` of all distinct fingerprints of ``points(fp, rep)`` within ``radius`` bits.

    The pairs form the same groups as all pairs within the radius do (a spanning
    forest per shard). ``blocks`` is chosen from the row count so that a shard of
    unrelated fingerprints stays small; every choice gives the same groups.
    """
    n = points.count()
    if blocks is None:
        blocks = radius + (2 if n <= 1 << 25 else 3 if n <= 1 << 32 else 4)
    edge = [64 * k // blocks for k in range(blocks + 1)]
    masks = []
    for kept in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << (edge[k + 1] - edge[k])) - 1) << edge[k] for k in kept)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).cast("long").alias("m")) for k, m in enumerate(masks)]))
    dealt = points.select("fp", "rep", kinds.alias("c")).select("fp", "rep", F.xxhash64("c.k", F.col("fp").bitwiseAND(F.col("c.m"))).alias("shard"))
    for _ in range(levels):
        heavy = cut(dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("v")).where(F.col("n") > shard_rows).select("shard", "v"))
        if heavy.isEmpty():
            break
        width = 2 * radius
        d = F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))).cast("long")
        shell = F.floor(d / width)
        low = d - shell * width < radius
        into = F.when(F.col("v").isNull(), F.array(F.lit(-1).cast("long"))).when(low & (shell > 0), F.array(shell, shell - 1)).otherwise(F.array(shell))
        dealt = (
            dealt.join(heavy, "shard", "left")
            .select("fp", "rep", "shard", F.explode(into).alias("shell"))
            .select("fp", "rep", F.when(F.col("shell") < 0, F.col("shard")).otherwise(F.xxhash64("shard", "shell")).alias("shard"))
        )
    return dealt.repartition("shard").mapInPandas(_shard_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, words: int = 4) -> DataFrame:
    """``(id, fp, component)`` for every row of ``docs``.

    Rows whose fingerprints differ in at most ``radius`` bits are linked;
    ``component`` is the smallest id reachable. Null, empty and blank texts all
    have fingerprint 0 and so form a group. Repeated ids give repeated rows; a null
    id keeps its fingerprint and takes the smallest id of its group (null if none).
    An empty table gives an empty result. Columns of ``docs`` that are not named are
    not read, so extra columns can't clash.
    """
    own = cut(fingerprints(docs, id_col, text_col, words))
    points = cut(own.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")))
    groups = connected_components(links(points, radius))
    of = points.join(groups, points["rep"] == groups["node"], "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return own.join(of, "fp", "left").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its near-duplicate group; of rows that repeat that id one stays; rows without id stay.

    The kept ids join back to the rows, and the texts of a repeated id are the only ones that are grouped.
    Null, empty and blank texts form one group; an empty table stays empty; all columns are kept.
    """
    got, own = near_duplicates(docs, id_col, text_col, radius), fresh(docs, "kept_id")
    keep = cut(got.where("id = component").groupBy("id").agg(F.count(F.lit(1)).alias("n")).select(F.col("id").alias(own), "n"))
    once = docs.join(keep.where("n = 1").select(own), F.col(id_col) == F.col(own), "left_semi")
    many = docs.join(keep.where("n > 1").select(own), F.col(id_col) == F.col(own), "left_semi").dropDuplicates([id_col])
    return once.unionByName(many).unionByName(docs.where(F.col(id_col).isNull()))
