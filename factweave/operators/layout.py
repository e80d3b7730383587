"""Nearest-neighbour graph, and a t-SNE layout over it in passes.

Up to ``EXACT_ROWS`` rows the graph is exact: block after block of rows is sent to all tasks, and each row keeps
the nearest so far beside its vector, so nothing is shuffled. Beyond, it starts from exact neighbours within runs
of rows that lie close by a few random projections, and is improved by comparing the neighbours of each row with
one another: a neighbour's neighbour is likely one. A layout pass is one job: each task moves the rows of its part
by some gradient steps, with the attraction of all their edges (ends in other parts stand where the last
pass left them) and the repulsion of a sample of rows, which stands for all. Parts then send one another the
places of the rows that they have edges to, each once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from factweave.plans.checkpoint import drop, free, stored

#: Rows of a run that is compared in full, and of a part that one task moves.
RUN_ROWS, PART_ROWS = 1024, 4096
#: Rows whose neighbours a task compares at a time, with a copy of a vector for each neighbour of each of them, or whose forces it sums up.
BLOCK_ROWS = 64
PROJECTIONS = 4
#: Rows up to which all are compared with all; beyond, descent takes less time.
EXACT_ROWS = 1 << 22
#: Bytes of vectors that are sent to all tasks at a time, and rows on either side of a matrix of distances.
SENT_BYTES, SLAB, WIDTH = 16 << 20, 2048, 512
#: Neighbours whose vectors are shuffled at a time in a round of descent, and edges that are dealt to parts at a time.
SLICE_ROWS, SLICE_EDGES = 1 << 22, 1 << 24


def _vectors(codes: pd.Series, kind: type) -> np.ndarray:
    return np.stack([np.frombuffer(c, kind) for c in codes]).astype(np.float64) if len(codes) else np.empty((0, 0))


def _far(x: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``x``; a row is infinitely far from itself."""
    square = (x * x).sum(axis=1)
    d = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * (x @ x.T), 0))
    np.fill_diagonal(d, np.inf)
    return d


def _rows(ids: np.ndarray, x: np.ndarray, k: int, worst: np.ndarray | None = None) -> pd.DataFrame:
    """Of each row of ``x`` the ``k`` nearest others, as ``(id, nbr, distance)``; with ``worst`` only nearer ones."""
    k = min(k, len(ids) - 1)
    if k < 1:
        return pd.DataFrame({"id": ids[:0], "nbr": ids[:0], "distance": np.empty(0)})
    at = np.argpartition(_far(x), k - 1, axis=1)[:, :k].ravel()
    own = np.repeat(np.arange(len(ids)), k)
    far = np.concatenate([np.sqrt(((x[own[i : i + 4096]] - x[at[i : i + 4096]]) ** 2).sum(axis=1)) for i in range(0, len(own), 4096)])  # the same bits in any company
    out = pd.DataFrame({"id": ids[own], "nbr": ids[at], "distance": far})
    return out if worst is None else out[far < worst[own]]


def _nearest(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each id, ties by neighbour; what several tasks found counts once."""
    by = Window.partitionBy("id").orderBy("distance", "nbr")
    return found.withColumn("r", F.dense_rank().over(by)).where(F.col("r") <= k).dropDuplicates(["id", "nbr"]).drop("r")


def _packed(df: DataFrame, key: str, vec: str) -> tuple[DataFrame, type]:
    """``(id, code)`` with the bytes of the vectors, and the kind of their numbers."""
    found = df.schema[vec].dataType
    small = isinstance(found, ArrayType) and isinstance(found.elementType, FloatType)
    kind = np.float32 if small else np.float64

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "code": [np.asarray(v, kind).tobytes() for v in pdf["v"]]})

    own = df.select(F.col(key).cast("long").alias("id"), F.col(vec).cast(found if small else ArrayType(DoubleType())).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    return stored(own.dropDuplicates(["id"]).mapInPandas(run, "id long, code binary")), kind


def _hits(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few true fields."""
    if mask.size % 8 or not mask.flags.c_contiguous:
        return np.nonzero(mask)
    words = np.flatnonzero(mask.reshape(-1).view(np.uint64))
    word, byte = np.nonzero(mask.reshape(-1, 8)[words])
    return np.divmod(words[word] * 8 + byte, mask.shape[1])


def _closest(ids: np.ndarray, x: np.ndarray, nbrs: np.ndarray, far: np.ndarray, other: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest of each row of ``x``, out of those that it has (``nbrs`` at ``far``, NaN where there is none) and the rows of ``y``.

    Products in single precision, less their greatest error, rule pairs out; distances of the others are exact.
    """
    whole = x[np.isfinite(x).all(axis=1)]
    middle = whole.mean(axis=0) if len(whole) else np.zeros(x.shape[1])
    unit = np.abs(whole - middle).max(initial=0) or 1.0
    error = (x.shape[1] + 8) * np.finfo(np.float32).eps
    a = (x - middle) / unit
    square = (a * a).sum(axis=1)
    left = np.column_stack([a, np.ones(len(a)), np.sqrt(square)]).astype(np.float32)
    rows, cols, found, waiting = [], [], [], 0
    least, mask = (np.empty((len(x), min(WIDTH, len(y))), t) for t in (np.float32, bool))
    for low in range(0, len(y), WIDTH):
        own = y[low : low + WIDTH].astype(np.float64)
        b = (own - middle) / unit
        size = np.sqrt((b * b).sum(axis=1))
        if len(own) < least.shape[1]:
            least, mask = least[:, : len(own)].copy(), mask[:, : len(own)].copy()
        np.matmul(left, np.column_stack([-b, (0.5 - error) * size * size, -error * size]).astype(np.float32).T, out=least)
        near, fresh = (far[:, -1] / unit) ** 2, np.isnan(far[:, -1])
        limit = (near - square) / 2 + error * (near + square)
        if fresh.any():
            most = size.max()
            limit[fresh] = np.partition(least[fresh], k, axis=1)[:, k] + 2 * error * (np.sqrt(square[fresh]) * most + most * most) if len(own) > k else np.inf
        np.greater(least, np.nextafter(limit.astype(np.float32), np.float32(np.inf))[:, None], out=mask)
        row, col = _hits(np.logical_not(mask, out=mask))
        d = np.concatenate([np.sqrt(((x[row[i : i + 4096]] - own[col[i : i + 4096]]) ** 2).sum(axis=1)) for i in range(0, len(row), 4096)] or [np.empty(0)])  # the same bits in any company
        good = (other[low + col] != ids[row]) & ~(d > far[row, -1])
        rows.append(row[good])
        cols.append(other[low + col[good]])
        found.append(d[good])
        waiting += len(rows[-1])
        if waiting > len(x) * k // 2 or fresh.any() or low + WIDTH >= len(y):
            row, nbr, d = np.concatenate([np.repeat(np.arange(len(x)), k), *rows]), np.concatenate([nbrs.ravel(), *cols]), np.concatenate([far.ravel(), *found])
            order = np.argsort(d)
            order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]
            if ((row[order[1:]] == row[order[:-1]]) & ~(d[order[1:]] > d[order[:-1]])).any():
                order = np.lexsort((nbr, d, row))  # ties and rows without a distance
            count = np.bincount(row, minlength=len(x))
            order = order[np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) < k]
            nbrs, far = nbr[order].reshape(-1, k), d[order].reshape(-1, k)
            rows, cols, found, waiting = [], [], [], 0
    return nbrs, far


def _exact(points: DataFrame, n: int, k: int, kind: type) -> DataFrame:
    """The ``k`` nearest of all rows, ties by neighbour."""
    spark = points.sparkSession
    width = len(points.select("code").first()[0])
    blocks = max(1, -(-n * width // SENT_BYTES))

    def closer(sent, last: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            other, y = sent.value
            for pdf in batches:
                for low in range(0, len(pdf), SLAB):
                    own = pdf.iloc[low : low + SLAB]
                    if own["far"].iloc[0] is None:
                        nbrs, far = np.full((len(own), k), np.iinfo(np.int64).max), np.full((len(own), k), np.nan)
                    else:
                        nbrs, far = (np.stack([np.frombuffer(c, t) for c in own[name]]) for name, t in (("nbrs", np.int64), ("far", np.float64)))
                    nbrs, far = _closest(own["id"].to_numpy(), _vectors(own["code"], kind), nbrs, far, other, y, k)
                    yield pd.DataFrame({"id": own["id"].to_numpy(), "code": None if last else own["code"].to_numpy(), "nbrs": [r.tobytes() for r in nbrs], "far": [r.tobytes() for r in far]})

        return run

    lists = points.repartition(max(1, -(-n // PART_ROWS)), "id").select("id", "code", F.lit(None).cast("binary").alias("nbrs"), F.lit(None).cast("binary").alias("far"))
    for b in range(blocks):
        some = points.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        y = np.frombuffer(b"".join(some["code"].to_pylist()), kind).reshape(len(some), -1)
        sent = spark.sparkContext.broadcast((some["id"].to_numpy(), y))
        new = stored(lists.mapInPandas(closer(sent, b == blocks - 1), "id long, code binary, nbrs binary, far binary"))
        sent.destroy()
        if b:
            drop(lists)
        lists = new

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for low in range(0, len(pdf), SLAB):
                own = pdf.iloc[low : low + SLAB]
                yield pd.DataFrame({"id": np.repeat(own["id"].to_numpy(), k), "nbr": np.frombuffer(b"".join(own["nbrs"]), np.int64), "distance": np.frombuffer(b"".join(own["far"]), np.float64)})

    drop(points)
    return lists.select("id", "nbrs", "far").mapInPandas(edges, "id long, nbr long, distance double")


def _runs(points: DataFrame, n: int, k: int, seed: int, kind: type) -> DataFrame:
    """Exact neighbours within runs of rows in the order of a random projection."""

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _vectors(pdf["code"], kind)
            line = np.random.default_rng(seed).standard_normal(x.shape[1]) if len(x) else np.empty(0)
            yield pdf.assign(p=x @ line if len(x) else [])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            rest = pdf if rest is None else pd.concat([rest, pdf])
            while len(rest) > RUN_ROWS + RUN_ROWS // 2:
                yield _rows(rest["id"].to_numpy()[:RUN_ROWS], _vectors(rest["code"][:RUN_ROWS], kind), k)
                rest = rest.iloc[RUN_ROWS - RUN_ROWS // 4 :]  # runs overlap
        if rest is not None and len(rest):
            yield _rows(rest["id"].to_numpy(), _vectors(rest["code"], kind), k)

    placed = points.mapInPandas(project, "id long, code binary, p double")
    order = ["p", F.xxhash64("id")]  # equal vectors don't end up in one task
    return placed.repartitionByRange(max(1, -(-n // (4 * RUN_ROWS))), *order).sortWithinPartitions(*order).mapInPandas(compare, "id long, nbr long, distance double")


def neighbours(df: DataFrame, key: str, vec: str, k: int = 15, rounds: int = 8, settled: float = 0.001, seed: int = 42) -> DataFrame:
    """``(id, nbr, distance)``: the ``k`` nearest other rows of each row, by Euclidean distance; of more than ``EXACT_ROWS`` rows close to them.

    Rounds of descent end when fewer than ``settled`` of all places changed. A round compares the neighbours of
    a row and up to ``k`` rows (by hash) that have it as theirs. Rows without id or vector are left out,
    of rows that repeat an id one stays; distances are exact, the choice of neighbours by descent is not.
    """
    points, kind = _packed(df, key, vec)
    n = points.count()
    k = min(k, n - 1)
    if k < 1:
        return points.select("id", F.col("id").alias("nbr"), F.lit(0.0).alias("distance")).where("1 = 0")
    return _exact(points, n, k, kind) if n <= EXACT_ROWS else _descent(points, n, k, rounds, settled, seed, kind)


def _descent(points: DataFrame, n: int, k: int, rounds: int, settled: float, seed: int, kind: type) -> DataFrame:
    graph = stored(_nearest(_runs(points, n, k, seed, kind), k))
    for r in range(1, PROJECTIONS):
        old, graph = graph, stored(_nearest(graph.unionByName(_runs(points, n, k, seed + r, kind)), k))
        drop(old)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [_rows(own["id"].to_numpy(), _vectors(own["code"], kind), k, own["worst"].to_numpy()) for _, own in pdf.sort_values(["center", "id"]).groupby("center")]
        return pd.concat(out)

    blocks, slices = -(-n // BLOCK_ROWS), -(-2 * n * k // SLICE_ROWS)

    for _ in range(rounds):
        worst = graph.groupBy("id").agg(F.when(F.count(F.lit(1)) < k, F.lit(float("inf"))).otherwise(F.max("distance")).alias("worst"))
        held = stored(points.join(worst, "id"))
        new = graph
        for s in range(slices):  # the vectors of a slice are on disk at a time
            mine = lambda c, s=s: F.pmod(F.xxhash64(F.lit("slice"), c), F.lit(slices)) == s
            back = graph.select(F.col("nbr").alias("center"), "id").where(mine("center")).withColumn("r", F.row_number().over(Window.partitionBy("center").orderBy(F.xxhash64("id"), "id"))).where(F.col("r") <= k).drop("r")
            near = graph.where(mine("id")).select(F.col("id").alias("center"), F.col("nbr").alias("id")).unionByName(back).distinct()
            members = near.join(held, "id").withColumn("block", F.pmod(F.xxhash64("center"), F.lit(blocks)))
            better = members.groupBy("block").applyInPandas(meet, "id long, nbr long, distance double")
            old, new = new, stored(_nearest(new.unionByName(better), k))
            if s:
                drop(old)
            free(points.sparkSession)
        changed = new.join(graph, ["id", "nbr"], "left_anti").count()
        drop(graph)
        drop(held)
        graph = new
        if changed <= settled * n * k:
            break
    drop(points)
    return graph


def affinities(graph: DataFrame, perplexity: float) -> DataFrame:
    """``(id, nbr, p)``: symmetric affinities of the edges of ``graph(id, nbr, distance)``, before they are divided by their sum.

    The width of each row's kernel is found by bisection, so that the entropy of its affinities is that of ``perplexity`` equal ones.
    ``graph`` is read before this returns, and only then.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = pdf["d"].map(len).to_numpy()
            d = np.full((len(pdf), max(size, default=0)), np.inf)
            for k, own in enumerate(pdf["d"]):
                d[k, : size[k]] = np.asarray(own) ** 2
            d -= d.min(axis=1, keepdims=True, initial=np.inf)
            low, high, beta = np.zeros(len(pdf)), np.full(len(pdf), np.inf), 1 / np.maximum(np.where(np.isfinite(d), d, 0).sum(axis=1) / np.maximum(size, 1), 1e-12)
            want = np.log(np.minimum(perplexity, np.maximum(size, 1)))
            for _ in range(64):
                e = np.exp(-np.where(np.isfinite(d), d * beta[:, None], np.inf))
                p = e / e.sum(axis=1, keepdims=True)
                entropy = -(p * np.log(np.where(p > 0, p, 1))).sum(axis=1)
                flat = entropy > want
                low, high = np.where(flat, beta, low), np.where(flat, high, beta)
                beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
            yield pd.DataFrame({"id": pdf["id"], "nbrs": pdf["nbrs"], "p": [row[:s] for row, s in zip(p, size, strict=True)]})

    lists = graph.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("distance", "nbr"))).alias("x")).select("id", F.col("x.nbr").alias("nbrs"), F.col("x.distance").alias("d"))
    one = stored(lists.mapInPandas(run, "id long, nbrs array<long>, p array<double>").select("id", F.explode(F.arrays_zip("nbrs", "p")).alias("e")).select("id", F.col("e.nbrs").alias("nbr"), F.col("e.p").alias("p")))
    return one.unionByName(one.select(F.col("nbr").alias("id"), F.col("id").alias("nbr"), "p")).groupBy("id", "nbr").agg((F.sum("p") / 2).alias("p"))


#: Of a part: its rows (``ids``, and as ``held`` their places, speeds and gains), or, with ``peer``, the places ``sent`` by that part.
STATE = "part int, peer int, ids binary, held binary, sent binary"
#: Of a part: its edges (``ids``, of each so many, and of all ``ends``, in the order of what is sent, and ``p``), or, with ``peer``, the ``ids`` whose places go to that part.
LINKS = "part int, peer int, ids binary, many binary, ends binary, p binary"


def _floats(code: bytes, width: int) -> np.ndarray:
    return np.frombuffer(code, np.float64).reshape(-1, width)


def _links(pdf: pd.DataFrame) -> pd.DataFrame:
    """The edges of a part, ``(part, id, nbr, p, src)`` with the part ``src`` of each end, as ``LINKS``."""
    pdf = pdf.sort_values(["id", "nbr"], ignore_index=True)
    part = int(pdf["part"].iloc[0])
    ids, many = np.unique(pdf["id"].to_numpy(), return_counts=True)
    src, nbr = pdf["src"].to_numpy(), pdf["nbr"].to_numpy()
    order = np.lexsort((nbr, src))
    first = np.r_[True, (np.diff(src[order]) != 0) | (np.diff(nbr[order]) != 0)]
    ends = np.empty(len(pdf), np.int32)
    ends[order] = np.cumsum(first) - 1
    asked = pd.DataFrame({"src": src[order][first], "nbr": nbr[order][first]})
    rows = [(part, None, ids.tobytes(), many.astype(np.int32).tobytes(), ends.tobytes(), pdf["p"].to_numpy().tobytes())]
    rows += [(int(s), part, own.to_numpy().tobytes(), None, None, None) for s, own in asked.groupby("src")["nbr"]]
    return pd.DataFrame(rows, columns=["part", "peer", "ids", "many", "ends", "p"]).astype({"peer": "Int32"})


def _steps(n: int, sample: np.ndarray, sample_ids: np.ndarray, steps: int, rate: float, momentum: float, pull: float, send: bool):
    """Moves a part's rows: ``pull`` exaggerates the attraction, ``sample`` stands for all ``n`` rows in the repulsion."""

    def run(now: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        part, rows = int(now["part"].iloc[0]), now[now["peer"].isna()].iloc[0]
        ids = np.frombuffer(rows["ids"], np.int64)
        at, speed, gain = (np.ascontiguousarray(x) for x in np.hsplit(_floats(rows["held"], 6), 3))
        asked = {int(q): np.searchsorted(ids, np.frombuffer(c, np.int64)) for q, c in links.loc[links["peer"].notna(), ["peer", "ids"]].itertuples(index=False)}
        if steps:
            edges = links[links["peer"].isna()].iloc[0]
            own = np.repeat(np.searchsorted(ids, np.frombuffer(edges["ids"], np.int64)), np.frombuffer(edges["many"], np.int32))
            ends, p = np.frombuffer(edges["ends"], np.int32), np.frombuffer(edges["p"], np.float64)
            sent = {int(q): _floats(c, 2) for q, c in now.loc[now["peer"].notna(), ["peer", "sent"]].itertuples(index=False)}
            if part in asked:
                sent[part] = at[asked[part]]
            places = np.concatenate([sent[q] for q in sorted(sent)])
            low = sum(len(sent[q]) for q in sent if q < part)
            mine = slice(low, low + len(sent.get(part, ())))
            here = np.flatnonzero((ends >= mine.start) & (ends < mine.stop))
            there = asked[part][ends[here] - low] if part in asked else here
            x, y = np.ascontiguousarray(places[:, 0])[ends], np.ascontiguousarray(places[:, 1])[ends]
            inside = np.flatnonzero(np.isin(sample_ids, ids))
            inside_at = np.searchsorted(ids, sample_ids[inside])
            scale, points = n / len(sample), sample.copy()
            many = np.bincount(own, minlength=len(ids))
            after = np.cumsum(many)
        for _ in range(steps):
            x[here], y[here] = at[:, 0][there], at[:, 1][there]
            points[inside] = at[inside_at]
            forces, total = np.zeros((len(at), 4)), 0.0  # attraction and repulsion
            fields = np.column_stack([np.ones(len(points)), points])
            for low in range(0, len(at), BLOCK_ROWS):
                some = slice(low, low + BLOCK_ROWS)
                edge = slice(after[low] - many[low], after[some][-1])
                ax, ay = np.repeat(at[some, 0], many[some]), np.repeat(at[some, 1], many[some])
                ax -= x[edge]
                ay -= y[edge]
                force = p[edge] / (1 + ax * ax + ay * ay)
                forces[some, 0], forces[some, 1] = (np.bincount(own[edge] - low, weights=force * c, minlength=len(at[some])) for c in (ax, ay))
                dx, dy = at[some, :1] - points[None, :, 0], at[some, 1:] - points[None, :, 1]
                dx *= dx
                dy *= dy
                dx += dy
                dx += 1
                q = np.reciprocal(dx, out=dx)
                itself = (inside_at >= low) & (inside_at < low + BLOCK_ROWS)
                q[inside_at[itself] - low, inside[itself]] = 0
                total += q.sum()
                q *= q
                pushed = q @ fields
                forces[some, 2:] = at[some] * pushed[:, :1] - pushed[:, 1:]
            z = max(total * scale * n / len(at), 1e-12)
            slope = 4 * (pull * forces[:, :2] - forces[:, 2:] * scale / z)
            gain = np.where(np.sign(slope) != np.sign(speed), gain + 0.2, gain * 0.8).clip(0.01)
            speed = momentum * speed - rate * gain * slope
            at = at + speed
        out = [(part, None, rows["ids"], np.hstack([at, speed, gain]).tobytes(), None)]
        if send:
            out += [(q, part, None, None, at[a].tobytes()) for q, a in asked.items() if q != part]
        return pd.DataFrame(out, columns=["part", "peer", "ids", "held", "sent"]).astype({"peer": "Int32"})

    return run


def _places(state: DataFrame, some: np.ndarray | None = None) -> DataFrame:
    """``(id, x, y)`` of the rows, or of ``some`` of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for code, held in zip(pdf["ids"], pdf["held"], strict=True):
                ids, at = np.frombuffer(code, np.int64), _floats(held, 6)
                own = slice(None) if some is None else np.isin(ids, some)
                yield pd.DataFrame({"id": ids[own], "x": at[own, 0], "y": at[own, 1]})

    return state.where("held IS NOT NULL").select("ids", "held").mapInPandas(run, "id long, x double, y double")


def tsne(df: DataFrame, key: str, vec: str, perplexity: float = 30.0, passes: int = 16, steps: int = 25, sample: int = 1_000, exaggeration: float = 12.0, seed: int = 42) -> DataFrame:
    """``(id, x, y)``: a layout of all rows in which near ones stay near.

    The affinities come from three times ``perplexity`` neighbours of each row. The first quarter of the ``passes``
    exaggerates the attraction. The repulsion is that of ``sample`` rows of smallest hash, scaled to all;
    their places, and before that a block of vectors, are what the driver holds. Rows without id or vector are left out, of rows that repeat an id
    one stays. The same rows give the same layout up to the rounding of sums.
    """
    graph = neighbours(df, key, vec, k=int(3 * perplexity), seed=seed)
    points = stored(df.select(F.col(key).cast("long").alias("id")).where(F.col("id").isNotNull() & F.col(vec).isNotNull()).distinct())
    n = points.count()
    if n < 3:
        return points.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    parts = max(1, -(-n // PART_ROWS))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    edges = affinities(graph, min(perplexity, (n - 1) / 3))
    drop(graph)
    slices = min(parts, -(-2 * n * int(3 * perplexity) // SLICE_EDGES))
    links = None
    for s in range(slices):
        some = edges.where(F.pmod(part("id"), F.lit(slices)) == s).select(part("id").alias("part"), "id", "nbr", (F.col("p") / n).alias("p"), part("nbr").alias("src"))
        own = stored(some.groupBy("part").applyInPandas(_links, LINKS))
        links = own if links is None else links.unionByName(own)
        free(df.sparkSession)
    drop(edges)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        held = np.hstack([pdf[["x", "y"]].to_numpy(np.float64), np.zeros((len(pdf), 2)), np.ones((len(pdf), 2))])
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "peer": pd.array([None], "Int32"), "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "held": [held.tobytes()], "sent": [None]})

    unit = lambda c: F.pmod(F.xxhash64(F.lit(f"{seed}{c}"), "id"), F.lit(1 << 20)) / (1 << 20) - 0.5
    state = points.select(part("id").alias("part"), "id", *[(unit(c) * 1e-3).alias(c) for c in ("x", "y")]).groupBy("part").applyInPandas(pack, STATE)
    some = np.array([r[0] for r in points.orderBy(F.xxhash64(F.lit(seed), "id")).limit(sample).collect()], np.int64)
    nowhere = np.empty((0, 2))
    state = stored(state.groupBy("part").cogroup(links.groupBy("part")).applyInPandas(_steps(n, nowhere, some, 0, 0.0, 0.0, 0.0, True), STATE))
    drop(points)
    early = max(1, passes // 4)
    for k in range(passes):
        held = _places(state, some).toPandas().sort_values("id")
        pull, momentum = (exaggeration, 0.5) if k < early else (1.0, 0.8)
        move = _steps(n, held[["x", "y"]].to_numpy(np.float64), held["id"].to_numpy(), steps, max(n / exaggeration / 4, 50.0), momentum, pull, k < passes - 1)
        old, state = state, stored(state.groupBy("part").cogroup(links.groupBy("part")).applyInPandas(move, STATE))
        drop(old)
    drop(links)
    return _places(state)
