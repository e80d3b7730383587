"""Kernel density of distances: one aggregation to bins with moments, then a sum over bins.

A bin holds count, sum and sum of squares of its distances from the bin's middle, so bins of
different tasks add up, and the kernel is expanded around the middle to second order. Bins
are a 64th of the bandwidth wide, which keeps the error under a millionth of the kernel's peak.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.operators.tiles import SLAB, TILE, dealt, matrix, meet, packed

PER_BANDWIDTH = 64


def bandwidths(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """``(by, n, low, high, bandwidth)``: Scott's rule from the moments of each group. A group of fewer than two different values has none and is left out."""
    known = values.where(F.col(value).isNotNull() & ~F.isnan(value))
    got = known.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.stddev_samp(value).alias("sd"))
    return got.where("sd > 0").select(*by, "n", "low", "high", (F.col("sd") * F.pow("n", F.lit(-0.2))).alias("bandwidth"))


def binned(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """``(by, bin, n, s1, s2)``: the filled bins of each group, bin 0 beginning at its least value."""
    stats = bandwidths(values, by, value).select(*by, "low", (F.col("bandwidth") / PER_BANDWIDTH).alias("width"))
    placed = values.where(F.col(value).isNotNull() & ~F.isnan(value)).join(stats, by).withColumn("bin", F.floor((F.col(value) - F.col("low")) / F.col("width")))
    off = F.col(value) - F.col("low") - (F.col("bin") + 0.5) * F.col("width")
    return placed.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.sum(off).alias("s1"), F.sum(off * off).alias("s2"))


def density(values: DataFrame, by: list[str], value: str, points: int = 200, beyond: float = 3.0) -> DataFrame:
    """``(by, x, density)``: the Gaussian kernel density of each group of ``by`` at ``points`` places that all groups share.

    The places reach from the least value to the greatest, and ``beyond`` bandwidths further, of all groups. Null
    and NaN values don't count; groups of fewer than two different values have no density. The sum over a
    group's bins is one task's, and their number depends on its spread in bandwidths, not on its rows.
    """
    stats = bandwidths(values, by, value)
    ends = stats.agg(F.min(F.col("low") - beyond * F.col("bandwidth")).alias("first"), F.max(F.col("high") + beyond * F.col("bandwidth")).alias("last"))
    whole = binned(values, by, value).join(stats.withColumnRenamed("n", "total"), by).crossJoin(F.broadcast(ends))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, low, total, first, last = (float(pdf[c].iloc[0]) for c in ("bandwidth", "low", "total", "first", "last"))
        x, middle = np.linspace(first, last, points), low + (pdf["bin"].to_numpy() + 0.5) * h / PER_BANDWIDTH
        n, s1, s2 = pdf["n"].to_numpy(np.float64), pdf["s1"].to_numpy() / h, pdf["s2"].to_numpy() / h**2
        out = np.zeros(points)
        for at in range(0, len(n), 4096):
            own = slice(at, at + 4096)
            z = (x[:, None] - middle[own][None, :]) / h
            out += (np.exp(-0.5 * z * z) * (n[own] + z * s1[own] + 0.5 * (z * z - 1) * s2[own])).sum(axis=1)
        return pdf[by].iloc[[0] * points].reset_index(drop=True).assign(x=x, density=np.maximum(out, 0) / (total * h * np.sqrt(2 * np.pi)))

    kinds = ", ".join(f"`{c}` {values.schema[c].dataType.simpleString()}" for c in by)
    return whole.groupBy(*by).applyInPandas(run, f"{kinds}, x double, density double")


def _distances(left: dict, right: dict, digits: int) -> Iterator[np.ndarray]:
    """1 - cosine of the pairs of two tiles, each pair of rows of different keys once."""
    x, y, same = matrix(left), matrix(right), left["t"] == right["t"]
    a, b = np.asarray(left["keys"]), np.asarray(right["keys"])
    for at in range(0, len(x), SLAB):
        d = np.round(1 - x[at : at + SLAB] @ y.T, digits)
        yield d[a[at : at + SLAB, None] < b[None, :]] if same else d.ravel()


def pair_bins(df: DataFrame, key: str, vec: str, by: str, digits: int = 9) -> DataFrame:
    """``(by, bin, n)``: the bins of ``binned`` over the distances, rounded to ``digits``, of all pairs of rows of a group.

    Pairs are formed a tile by a tile in tasks and leave them as moments, in a second pass as counts. Their
    number is the square of a group's rows, and so is the time.
    """
    rows = df.select(by, F.col(key).alias("key"), F.col(vec).alias("v")).where(F.col("v").isNotNull() & F.col(by).isNotNull())
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("rows"))
    ends = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, 0)  # a row for each group
    tiles = F.ceil(F.col("rows") / TILE)
    marks = sizes.select(F.col(by).alias("__by"), F.sum(tiles).over(ends).cast("int").alias("end"), tiles.cast("int").alias("tiles"))
    placed = rows.join(F.broadcast(marks), F.col(by) == F.col("__by"))
    tiled = packed(placed.select(by, "key", "v", "end", (F.col("end") - F.col("tiles") + dealt("key", F.col("tiles"))).alias("t")), [by, "end", "t"])
    kind, on = df.schema[by].dataType.simpleString(), "l_t <= r_t AND r_t < l_end"

    def moments(left: dict, right: dict) -> pd.DataFrame:
        n, low, s1, s2 = 0, np.inf, 0.0, 0.0
        for d in _distances(left, right, digits):
            if len(d):
                n, low = n + len(d), min(low, float(d.min()))
                d = d - 1
                s1, s2 = s1 + float(d.sum()), s2 + float(d @ d)
        return pd.DataFrame({by: [left[by]], "n": [n], "low": [low], "s1": [s1], "s2": [s2]} if n else {})

    sums = meet(tiled, tiled, on, moments, f"`{by}` {kind}, n long, low double, s1 double, s2 double").groupBy(by).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    width = F.sqrt((F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")) / (F.col("n") - 1)) * F.pow("n", F.lit(-0.2)) / PER_BANDWIDTH
    stats = sums.where("n > 1").withColumn("width", width).where("width > 0").select(F.col(by).alias("__by"), "low", "width")

    def counts(left: dict, right: dict) -> pd.DataFrame:
        held = np.zeros(0, np.int64)
        for d in _distances(left, right, digits):
            n = np.bincount(np.floor((d - left["low"]) / left["width"]).astype(np.int64))
            held, n = (held, n) if len(held) > len(n) else (n, held)
            held[: len(n)] += n
        bins = np.flatnonzero(held)
        return pd.DataFrame({by: left[by], "bin": bins, "n": held[bins]})

    own = tiled.join(F.broadcast(stats), F.col(by) == F.col("__by")).drop("__by")
    return meet(own, tiled, on, counts, f"`{by}` {kind}, bin long, n long").groupBy(by, "bin").agg(F.sum("n").alias("n"))
