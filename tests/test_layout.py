import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factweave.operators import density, layout, selection


def clusters(n, dim, centers, seed=0, spread=0.35):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((centers, dim)) * 2
    label = rng.integers(0, centers, n)
    return middle[label] + spread * rng.standard_normal((n, dim)), label


def frame(spark, x, **more):
    return spark.createDataFrame([(k, v.tolist(), *(c[k] for c in more.values())) for k, v in enumerate(x)], ", ".join(["ord long", "embedding array<double>", *(f"{c} string" for c in more)])).repartition(3)


def distances(x):
    d = np.sqrt(np.maximum(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2), 0))
    np.fill_diagonal(d, np.inf)
    return d


@pytest.mark.parametrize("shape", ["clusters", "noise", "ties"])
def test_neighbours_recall(spark, shape, monkeypatch):
    monkeypatch.setattr(layout, "RUN_ROWS", 64)  # so that most pairs never meet in a run
    k = 10
    x = clusters(900, 16, 12)[0] if shape == "clusters" else np.random.default_rng(1).standard_normal((700, 12))
    if shape == "ties":
        x = np.round(x[:400]) * 0.5
    got = layout.neighbours(frame(spark, x), "ord", "embedding", k).toPandas()
    d = distances(x)
    assert (got.groupby("id").size() == k).all() and len(got) == k * len(x) and (got["id"] != got["nbr"]).all()
    assert np.allclose(d[got["id"], got["nbr"]], got["distance"], atol=1e-6)
    limit = np.sort(d, axis=1)[:, k - 1]
    assert (got["distance"].to_numpy() <= limit[got["id"]] + 1e-9).mean() >= 0.9


def test_neighbours_of_few_rows(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (None, [1.0, 1.0]), (3, [5.0, 0.0])], "ord long, embedding array<double>")
    got = layout.neighbours(df, "ord", "embedding", 5)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 1.0), (0, 3, 5.0), (1, 0, 1.0), (1, 3, 4.0), (3, 0, 5.0), (3, 1, 4.0)]
    assert layout.neighbours(df.where("ord = 0"), "ord", "embedding").count() == 0
    assert [tuple(r) for r in layout.tsne(df.where("ord = 0"), "ord", "embedding").collect()] == [(0, 0.0, 0.0)]


def test_neighbours_in_blocks(spark, monkeypatch):
    """Tasks hold the neighbours of a few rows at a time; how many doesn't change what is found."""
    monkeypatch.setattr(layout, "RUN_ROWS", 32)
    x = clusters(150, 6, 4)[0]
    got = []
    for size in (4, 64):
        monkeypatch.setattr(layout, "BLOCK_ROWS", size)
        got.append(sorted(map(tuple, layout.neighbours(frame(spark, x), "ord", "embedding", 5, rounds=2).collect())))
    assert got[0] == got[1] and len(got[0]) == 5 * 150


def test_neighbours_are_exact(spark, monkeypatch):
    """Rows are compared with block after block of all rows; far ones are ruled out only if they are no neighbours."""
    monkeypatch.setattr(layout, "SENT_BYTES", 100 * 24 * 8)
    monkeypatch.setattr(layout, "WIDTH", 32)
    k = 12
    x = np.random.default_rng(5).standard_normal((600, 24)) * 0.01 + 1e3  # far from the origin: products alone don't tell them apart
    x[50:80] = x[50]  # more equal rows than neighbours
    x[7] = 1e30
    got = layout.neighbours(frame(spark, x), "ord", "embedding", k).toPandas().sort_values(["id", "distance", "nbr"])
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :k]
    assert (got["nbr"].to_numpy().reshape(-1, k) == want).all()
    assert (got["distance"].to_numpy().reshape(-1, k) == np.take_along_axis(d, want, 1)).all()


@pytest.mark.parametrize("slice_rows", [1 << 22, 4000])
def test_neighbours_by_descent(spark, slice_rows, monkeypatch):
    """What is shuffled at a time doesn't change what is found."""
    monkeypatch.setattr(layout, "EXACT_ROWS", 0)
    monkeypatch.setattr(layout, "RUN_ROWS", 64)
    monkeypatch.setattr(layout, "SLICE_ROWS", slice_rows)
    k = 10
    x = np.random.default_rng(1).standard_normal((500, 12))
    got = layout.neighbours(frame(spark, x), "ord", "embedding", k, rounds=3).toPandas()
    d = distances(x)
    assert (got.groupby("id").size() == k).all() and len(got) == k * len(x)
    assert (got["distance"].to_numpy() <= np.sort(d, axis=1)[:, k - 1][got["id"]] + 1e-9).mean() >= 0.9


def test_layout_leaves_one_table(spark, tmp_path, monkeypatch):
    """Tables of a step go when the next one is written, so disk doesn't grow with rounds and passes."""
    written, most = [], []
    real = layout.stored

    def stored(df):
        out = real(df)
        written.append(out.inputFiles()[0].removeprefix("file:").replace("//", "/").rpartition("/")[0])
        most.append(sum(os.path.exists(w) for w in written))
        return out

    monkeypatch.setattr(layout, "stored", stored)
    monkeypatch.setattr(layout, "PART_ROWS", 100)
    got = layout.tsne(frame(spark, clusters(300, 6, 3)[0]), "ord", "embedding", perplexity=8, passes=6, steps=4)
    assert len(written) > 10 and max(most) <= 5 and sum(os.path.exists(w) for w in written) == 1
    assert got.count() == 300


def test_affinities_have_the_perplexity(spark):
    x, _ = clusters(200, 8, 4)
    d = distances(x)
    at = np.argsort(d, axis=1)[:, :30]
    rows = [(i, int(j), float(d[i, j])) for i in range(len(x)) for j in at[i]]
    got = layout.affinities(spark.createDataFrame(rows, "id long, nbr long, distance double"), 10.0).toPandas()
    p = np.zeros((len(x), len(x)))
    p[got["id"], got["nbr"]] = got["p"]
    assert np.allclose(p, p.T) and abs(p.sum() - len(x)) < 1e-6
    want = np.zeros_like(p)
    for i in range(len(x)):
        low, high = 0.0, 1e6
        for _ in range(100):
            beta = (low + high) / 2
            e = np.exp(-beta * (d[i, at[i]] ** 2 - d[i, at[i]].min() ** 2))
            q = e / e.sum()
            low, high = (beta, high) if -(q * np.log(np.maximum(q, 1e-300))).sum() > math.log(10) else (low, beta)
        want[i, at[i]] = q
    assert np.allclose(p, (want + want.T) / 2, atol=1e-6)


def trustworthiness(x, y, k):
    rank = np.argsort(np.argsort(distances(x), axis=1), axis=1) + 1
    near = np.argsort(distances(y), axis=1)[:, :k]
    n = len(x)
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * sum(max(0, rank[i, j] - k) for i in range(n) for j in near[i])


@pytest.mark.parametrize("part_rows", [4096, 160])
def test_layout_keeps_neighbours(spark, part_rows, monkeypatch):
    monkeypatch.setattr(layout, "PART_ROWS", part_rows)
    x, label = clusters(480, 12, 6)
    got = layout.tsne(frame(spark, x), "ord", "embedding", perplexity=15, passes=12, steps=25).toPandas().sort_values("id")
    y = got[["x", "y"]].to_numpy()
    assert np.isfinite(y).all() and len(y) == len(x)
    assert trustworthiness(x, y, 10) >= 0.9
    nearest = distances(y).argmin(axis=1)
    assert (label[nearest] == label).mean() > 0.95


def test_density_equals_the_direct_sum(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(v)) for v in rng.normal(0.5, 0.1, 3000)] + [("b", float(v)) for v in np.r_[rng.normal(0.1, 0.01, 500), rng.normal(0.9, 0.02, 700)]]
    rows += [("one", 0.3), ("same", 0.4), ("same", 0.4), ("a", None), ("b", math.nan)]
    df = spark.createDataFrame(rows, "method string, distance double").repartition(5)
    got = density.density(df, ["method"], "distance", points=120).toPandas()
    assert set(got["method"]) == {"a", "b"}
    grids = [g["x"].to_numpy() for _, g in got.sort_values("x").groupby("method")]
    assert np.allclose(*grids) and len(grids[0]) == 120
    low, high = [], []
    for m, g in got.sort_values("x").groupby("method"):
        v = np.array([x for k, x in rows if k == m and x is not None and not math.isnan(x)])
        h = v.std(ddof=1) * len(v) ** -0.2
        want = np.exp(-0.5 * ((g["x"].to_numpy()[:, None] - v) / h) ** 2).sum(axis=1) / (len(v) * h * math.sqrt(2 * math.pi))
        assert np.abs(g["density"].to_numpy() - want).max() < 1e-6 * max(1.0, want.max())
        low.append(v.min() - 3 * h)
        high.append(v.max() + 3 * h)
    assert np.allclose([grids[0][0], grids[0][-1]], [min(low), max(high)])
    bins = density.binned(df, ["method"], "distance")
    assert bins.agg(F.sum("n")).first()[0] == 4200


def test_vendi_of_whole_groups(spark):
    x, label = clusters(2300, 24, 5)
    df = frame(spark, x, method=np.where(np.arange(len(x)) < 2000, "many", np.where(label < 3, "few", "rest")))
    got = {r["method"]: (r["vendi"], r["n"]) for r in selection.vendi(df, ["method"], "ord", "embedding").collect()}
    method = pd.Series(np.where(np.arange(len(x)) < 2000, "many", np.where(label < 3, "few", "rest")))
    for m, own in method.groupby(method):
        u = x[own.index] / np.linalg.norm(x[own.index], axis=1, keepdims=True)
        value = np.linalg.eigvalsh((u @ u.T + 1) / 2 / len(u))
        value = value[value > 1e-12]
        assert got[m][1] == len(u) and abs(got[m][0] - math.exp(-(value * np.log(value)).sum())) < 1e-6
