"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

A unit vector ``x`` is stored as ``s * q + e`` with int8 ``q``; ``|e|`` is computed
per vector. For two vectors ``|x.y - s_x s_y q_x.q_y| <= |e_x| + |e_y| + |e_x||e_y|``,
so a pair whose int8 product plus that bound stays under the threshold can't be a
link, and one whose product less the bound reaches it is one. Vectors are quantised
once; tasks that compare tiles get codes, scales and bounds only. Full vectors go
to a second pass, of those that stand in a pair between the two, and only such pairs
are recomputed in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from factweave.llm.common import connected_components, cut, forest

#: Codes of a tile, and rows of it that are multiplied at a time.
TILE_ROWS = 4096
SLAB = 256


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and an upper bound of the 2-norm of the error of each unit vector."""
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    err = np.linalg.norm(unit - codes * scale[:, None], axis=1)
    return codes, scale, err * (1 + 1e-9) + 1e-9


def unit_vectors(m: np.ndarray) -> np.ndarray:
    """Rows of norm 1; the largest component becomes 1 first, which keeps squares finite."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


Codes = tuple[np.ndarray, np.ndarray, np.ndarray]


def close_pairs(a: Codes, b: Codes, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions ``(i, j)`` of pairs whose greatest possible cosine reaches the threshold, and whether the least one does; ``same``: i < j only."""
    (qa, sa, ea), (qb, sb, eb) = a, b
    kind = np.float32 if qa.shape[1] <= 1000 else np.float64  # products of codes stay exact
    fa, fb = qa.astype(kind), qb.astype(kind).T.copy()
    for at in range(0, len(qa), SLAB):
        up = slice(at, at + SLAB)
        first = at if same else 0
        if first >= len(qb):
            break
        codes = fa[up] @ fb[:, first:]
        room = threshold - ea[up].max() - eb.max() - ea[up].max() * eb.max()
        least = room / (sa[up].max() * sb.max()) if room > 0 else room / (sa[up].min() * sb.min())
        flat = np.flatnonzero(codes >= least * (1 - 1e-6 * np.sign(least)))
        i, j = flat // codes.shape[1] + at, flat % codes.shape[1] + first
        product = codes.ravel()[flat]
        del codes
        if same:
            ok = i < j
            i, j, product = i[ok], j[ok], product[ok]
        product, bound = product * sa[i] * sb[j], ea[i] + eb[j] + ea[i] * eb[j]
        ok = product + bound >= threshold
        yield i[ok], j[ok], product[ok] - bound[ok] >= threshold


def exact_links(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Those of the pairs ``(i, j)`` with cosine >= threshold in double precision."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    for k in range(0, len(i), 1 << 17):
        x, y = i[k : k + (1 << 17)], j[k : k + (1 << 17)]
        ok = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y]) >= threshold
        yield x[ok], y[ok]


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions ``(i, j)`` of the rows of ``a`` and ``b`` (double vectors) with cosine >= threshold; ``same``: i < j only."""
    for i, j, sure in close_pairs(quantise(unit_vectors(a)), quantise(unit_vectors(b)), threshold, same):
        yield i[sure], j[sure]
        yield from exact_links(a, b, i[~sure], j[~sure], threshold)


def _quantised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for _, own in pdf.groupby("dim"):
            codes, scale, err = quantise(unit_vectors(np.stack(own["v"].to_numpy()).astype(np.float64)))
            yield own[["rep", "copies", "dim", "tile"]].assign(code=[c.tobytes() for c in codes], scale=scale, err=err)


class _Sums:
    """Links of a task, as sums per vector and a spanning forest."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray):
        self.ids, self.copies, self.count, self.parts = ids, copies, np.zeros(len(ids), np.int64), []

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        if len(x):
            np.add.at(self.count, x, self.copies[y])
            np.add.at(self.count, y, self.copies[x])
            self.parts.append(forest(self.ids[x], self.ids[y]))

    def rows(self) -> pd.DataFrame:
        a, b = forest(*(np.concatenate(p) for p in zip(*self.parts, strict=True))) if self.parts else (np.empty(0, np.int64),) * 2
        linked = np.flatnonzero(self.count)
        return pd.concat([pd.DataFrame({"a": self.ids[linked], "b": self.ids[linked], "links": self.count[linked]}), pd.DataFrame({"a": a, "b": b, "links": np.zeros(len(a), np.int64)})])


def _tiles(pdf: pd.DataFrame, dim: int, i: int, j: int) -> tuple[np.ndarray, np.ndarray, Codes, Codes]:
    """The places of the rows of both tiles, and their codes."""
    tile, scale, err = pdf["tile"].to_numpy(), pdf["scale"].to_numpy(), pdf["err"].to_numpy()
    codes = np.frombuffer(b"".join(pdf["code"]), np.int8).reshape(-1, dim)
    left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
    return left, right, (codes[left], scale[left], err[left]), (codes[right], scale[right], err[right])


def _code_task(threshold: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dim, i, j = (int(k) for k in key)
        left, right, a, b = _tiles(pdf, dim, i, j)
        sums, open_ = _Sums(pdf["rep"].to_numpy(), pdf["copies"].to_numpy()), np.zeros(len(pdf), bool)
        if len(left) and len(right):
            for x, y, sure in close_pairs(a, b, threshold, i == j):
                x, y = left[x], right[y]
                sums.add(x[sure], y[sure])
                open_[x[~sure]] = open_[y[~sure]] = True
        got = sums.rows().assign(i=-1, j=-1)
        ids = sums.ids[open_]
        return pd.concat([got, pd.DataFrame({"a": ids, "b": ids, "links": np.zeros(len(ids), np.int64), "i": i, "j": j})])

    return run


def _exact_task(threshold: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dim, i, j = (int(k) for k in key)
        left, right, a, b = _tiles(pdf, dim, i, j)
        sums = _Sums(pdf["rep"].to_numpy(), pdf["copies"].to_numpy())
        if len(left) and len(right):
            m = np.stack(pdf["v"].to_numpy()).astype(np.float64)
            for x, y, sure in close_pairs(a, b, threshold, i == j):
                for u, w in exact_links(m, m, left[x[~sure]], right[y[~sure]], threshold):
                    sums.add(u, w)
        return sums.rows()

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(id, n_links, component)`` for every row of ``vectors``: cosine links >= ``threshold`` in double precision.

    Equal vectors are grouped first and compared once, with their number. Null,
    zero and non-finite vectors (and such with a null component) link with nothing and
    are their own component. Vectors of different lengths never link. Rows that
    repeat an id count as vectors of their own; rows with a null id are left out
    of groups. An empty table gives an empty result.

    A task compares two tiles and returns sums per vector, a spanning forest and the
    vectors in pairs that the codes leave open, never the pairs themselves, so a large group of near copies costs no more rows
    than its members in each tile.
    """
    kind = vectors.schema[vec_col].dataType
    v = F.col(vec_col) if isinstance(kind, ArrayType) and isinstance(kind.elementType, (FloatType, DoubleType)) else F.col(vec_col).cast(ArrayType(DoubleType()))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    big = F.lit(float("inf"))
    good = (
        F.col("id").isNotNull()
        & F.col("v").isNotNull()
        & (F.size("v") > 0)
        & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)), F.lit(False))
        & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    )
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    valid = rows.where("good").drop("good")
    reps = cut(valid.groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    n = reps.count()
    tiles = max(1, -(-n // tile_rows))
    dealt = reps.select("rep", "copies", F.size("v").alias("dim"), F.pmod(F.xxhash64("rep"), F.lit(tiles)).cast("int").alias("tile"), "v")
    codes = cut(dealt.mapInPandas(_quantised, "rep long, copies long, dim int, tile int, code binary, scale double, err double"))
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.lit(tiles - 1)), lambda t: F.struct(F.least(t, F.col("tile")).alias("i"), F.greatest(t, F.col("tile")).alias("j"))))
    first = cut(codes.select("*", pairs.alias("p")).select(*codes.columns, "p.i", "p.j").groupBy("dim", "i", "j").applyInPandas(_code_task(threshold), "a long, b long, links long, i int, j int"))
    found = first.where("i < 0").select("a", "b", "links")
    unsure = first.where("i >= 0").select(F.col("a").alias("rep"), "i", "j")
    if not unsure.isEmpty():
        whole = unsure.join(codes.join(reps.select("rep", "v"), "rep"), "rep")
        found = found.unionByName(cut(whole.groupBy("dim", "i", "j").applyInPandas(_exact_task(threshold), "a long, b long, links long")))
    groups = connected_components(found.where("a <> b").select("a", "b"))
    linked = found.where("links > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    of = (
        reps.join(linked, "rep", "left")
        .join(groups, F.col("rep") == F.col("node"), "left")
        .select(F.col("v").alias("of_v"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    return (
        valid.join(of, F.col("v") == F.col("of_v"))
        .select("id", "n_links", "component")
        .unionByName(rows.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))
    )
