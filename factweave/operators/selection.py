"""Diversity selection within groups of vectors, and diversity scores.

Each method sees its whole group. A group that fits a task is chosen from in one;
a larger one takes passes over its rows, an aggregation a step, with the same
result up to the rounding of sums.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.operators.tiles import SLAB, TILE, dealt, matrix, meet, packed
from factweave.plans.checkpoint import cut

#: Groups of more rows are not held in one task; facility location's task holds the square of its rows.
MAX_GROUP = 20_000
MAX_SQUARE = 6_000
#: Candidates of a group whose gain a step of facility location over large groups works out first.
CANDIDATES = 256


def unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1.0, norm)


def farthest_points(m: np.ndarray, budget: int) -> list[int]:
    """The vector nearest to the centroid, then each time that of least similarity to those taken (ties: the first). One even for budget 0."""
    if not len(m):
        return []
    x = unit(m)
    centre = x.mean(axis=0)
    size = np.linalg.norm(centre)
    taken = [int(np.argmax(np.round(x @ (centre / (size if size else 1.0)), 12)))]
    far = np.round(1 - x @ x[taken[0]], 12)
    far[taken[0]] = -np.inf
    while len(taken) < min(budget, len(m)):
        k = int(np.argmax(far))
        taken.append(k)
        far = np.minimum(far, np.round(1 - x @ x[k], 12))
        far[k] = -np.inf
    return taken


def facility_location(m: np.ndarray, budget: int) -> list[int]:
    """Greedy choice of the vector that adds most to the sum of each vector's greatest similarity to the chosen (ties: the first)."""
    x = unit(m)
    best, taken, free = np.full(len(m), -1.0), [], np.ones(len(m), bool)
    sim = x @ x.T
    while len(taken) < min(budget, len(m)):
        gain = np.concatenate([np.maximum(sim[a : a + 512] - best[None, :], 0).sum(axis=1) for a in range(0, len(m), 512)])
        gain = np.round(gain, 9)
        gain[~free] = -np.inf
        k = int(np.argmax(gain))
        taken.append(k)
        free[k] = False
        best = np.maximum(best, sim[k])
    return taken


def race(mark: np.ndarray, start: int, step: int, seed: int) -> np.ndarray:
    """An exponential variate of each row, fixed by its mark: the least of them over the weight is a weighted draw, however the rows are dealt."""
    z = mark.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (1 + start + 1_000 * step + 1_000_003 * seed)) & 0xFFFFFFFFFFFFFFFF)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
    return -np.log(((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54)


#: Applies a function of keys, marks and vectors to all parts of a group, and gives the results.
Run = Callable[[Callable], list]


def in_memory(m: np.ndarray, mark: np.ndarray | None) -> Run:
    keys = np.arange(len(m))
    return lambda f: [f(keys, keys if mark is None else mark, m)]


def squares(m: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.maximum((m**2).sum(axis=1)[:, None] - 2 * m @ centre.T + (centre**2).sum(axis=1)[None, :], 0)


def kmeans(run: Run, k: int, seed: int = 42, starts: int = 10, steps: int = 100) -> np.ndarray:
    """Centroids of the best of several seeded starts of Lloyd's algorithm with k-means++ seeding; a pass serves all starts."""
    chosen: list[list[np.ndarray]] = [[] for _ in range(starts)]
    for step in range(k):

        def draw(keys, mark, m, step=step):
            out = []
            for s, own in enumerate(chosen):
                e = race(mark, s, step, seed)
                weight = squares(m, np.stack(own)).min(axis=1) if own else np.ones(len(m))
                weight[weight < 1e-12 * (m**2).sum(axis=1)] = 0  # the chosen themselves, but for rounding
                with np.errstate(divide="ignore"):
                    at, plain = int(np.argmin(e / weight)), int(np.argmin(e))
                out.append((False, e[at] / weight[at], keys[at], m[at]) if weight[at] > 0 else (True, e[plain], keys[plain], m[plain]))
            return out

        got = run(draw)
        for s in range(starts):
            chosen[s].append(min((g[s] for g in got), key=lambda x: x[:3])[3])
    centres, done = [np.stack(c).astype(float) for c in chosen], [np.inf] * starts
    active = list(range(starts))
    for step in range(steps):

        def sums(keys, mark, m):
            out = []
            for s in active:
                d = squares(m, centres[s])
                of = d.argmin(axis=1)
                one = np.zeros((len(m), k))
                one[np.arange(len(m)), of] = 1
                out.append((one.T @ m, one.sum(axis=0), float(d[np.arange(len(m)), of].sum())))
            return out

        got, moving = run(sums), []
        for i, s in enumerate(active):
            total, size = sum(g[i][0] for g in got), sum(g[i][1] for g in got)
            done[s] = sum(g[i][2] for g in got)
            new = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres[s])
            if not np.allclose(new, centres[s]) and step < steps - 1:
                centres[s] = new
                moving.append(s)
        active = moving
        if not active:
            break
    best = 0
    for s in range(1, starts):
        if done[s] < done[best] * (1 - 1e-12) - 1e-12:
            best = s
    return centres[best]


def nearest_unused(run: Run, centre: np.ndarray) -> list:
    """For each centroid in turn the key of the unused vector of greatest cosine."""
    c, taken, depth = unit(centre), [], 8
    while len(taken) < len(c):
        at, used = len(taken), set(taken)

        def tops(keys, mark, m):
            free = np.array([k not in used for k in keys], bool)
            keys, sim = [k for k in keys if k not in used], np.round(unit(m[free]) @ c[at:].T, 12)
            return [[(-sim[i, j], keys[i]) for i in np.argsort(-sim[:, j], kind="stable")[:depth]] for j in range(sim.shape[1])]

        got = run(tops)
        for j in range(len(c) - at):
            left = [k for _, k in sorted(x for g in got for x in g[j])[:depth] if k not in taken]
            if not left:
                break
            taken.append(left[0])
    return taken


def nearest_members(run: Run, centre: np.ndarray) -> list:
    """The key of one member of each cluster, nearest to its centroid."""

    def members(keys, mark, m):
        d, out = squares(m, centre), {}
        of = d.argmin(axis=1)
        for c in np.unique(of):
            own = np.flatnonzero(of == c)
            at = own[np.argmin(np.round(d[own, c], 9))]
            out[int(c)] = (round(float(d[at, c]), 9), keys[at])
        return out

    got = run(members)
    return [min(g[c] for g in got if c in g)[1] for c in sorted(set().union(*got))]


def kmeans_nearest(m: np.ndarray, budget: int, mark: np.ndarray | None = None, seed: int = 42) -> list[int]:
    """For each of ``budget`` centroids the unused vector of greatest cosine; all vectors if there are no more."""
    if budget >= len(m):
        return list(range(len(m)))
    if budget <= 0:
        return []
    run = in_memory(m, mark)
    return [int(k) for k in nearest_unused(run, kmeans(run, budget, seed))]


def kmeans_prefilter(m: np.ndarray, keep: int, mark: np.ndarray | None = None, seed: int = 42) -> list[int]:
    """One member of each cluster, nearest to its centroid."""
    if keep >= len(m):
        return list(range(len(m)))
    if keep <= 0:
        return []
    run = in_memory(m, mark)
    return sorted(int(k) for k in nearest_members(run, kmeans(run, keep, seed)))


def kdpp(m: np.ndarray, budget: int, seed: int = 42) -> list[int]:
    """A seeded sample of a determinantal point process of fixed size over the kernel ``(cosine + 1) / 2``."""
    n = len(m)
    if budget >= n:
        return list(range(n))
    if budget <= 0:
        return []
    x, rng = unit(m), np.random.default_rng(seed)
    kernel = (x @ x.T + 1) / 2
    np.fill_diagonal(kernel, 1 + 1e-6)
    value, vector = np.linalg.eigh(kernel)
    value = np.maximum(value, 0) / max(value.max(), 1e-12)
    # Elementary symmetric polynomials give the chance that an eigenvector takes part.
    e = np.zeros((budget + 1, n + 1))
    e[0] = 1
    for j in range(1, n + 1):
        e[1:, j] = e[1:, j - 1] + value[j - 1] * e[:-1, j - 1]
    chosen, left = [], budget
    for j in range(n, 0, -1):
        if not left:
            break
        if j == left or e[left, j] <= 0 or rng.random() < value[j - 1] * e[left - 1, j - 1] / e[left, j]:
            chosen.append(j - 1)
            left -= 1
    basis, taken = vector[:, chosen], []
    for _ in range(budget):
        p = np.maximum((basis**2).sum(axis=1), 0)
        p[taken] = 0
        k = int(rng.choice(n, p=p / p.sum())) if p.sum() > 0 else next(i for i in range(n) if i not in taken)
        taken.append(k)
        if basis.shape[1] > 1:
            pivot = int(np.argmax(np.abs(basis[k])))
            if abs(basis[k, pivot]) > 1e-12:
                basis = np.delete(basis - np.outer(basis[:, pivot] / basis[k, pivot], basis[k]), pivot, axis=1)
                basis, _ = np.linalg.qr(basis)
    return sorted(taken)


def kmeans_kdpp(m: np.ndarray, budget: int, mark: np.ndarray | None = None, seed: int = 42) -> list[int]:
    """A determinantal sample of three times as many prefiltered vectors."""
    own = kmeans_prefilter(m, 3 * budget, mark, seed)
    return [own[k] for k in kdpp(m[own], budget, seed)]


METHODS: dict[str, Callable[[np.ndarray, int, np.ndarray], list[int]]] = {"farthest": lambda m, n, _: farthest_points(m, n), "facility": lambda m, n, _: facility_location(m, n), "kmeans": kmeans_nearest, "kdpp": kmeans_kdpp}


def in_passes(rows: DataFrame) -> Run:
    """Passes over the Arrow batches of ``rows(__key, __mark, __vec)``."""

    def run(f: Callable) -> list:
        def each(batches):
            for pdf in batches:
                if len(pdf):
                    pdf = pdf.sort_values("__key")
                    yield pd.DataFrame({"x": [pickle.dumps(f(pdf["__key"].tolist(), pdf["__mark"].to_numpy(), np.stack(pdf["__vec"].to_numpy()).astype(np.float64)))]})

        return [pickle.loads(r["x"]) for r in rows.mapInPandas(each, "x binary").collect()]

    return run


def farthest_in_passes(run: Run, budget: int) -> list:
    """``farthest_points`` of a group of any size."""
    centre = sum(run(lambda keys, mark, m: unit(m).sum(axis=0)))
    size = np.linalg.norm(centre)
    centre = centre / (size if size else 1.0)

    def nearest(keys, mark, m):
        sim = np.round(unit(m) @ centre, 12)
        return -sim.max(), keys[int(np.argmax(sim))], m[int(np.argmax(sim))]

    taken = [min(run(nearest), key=lambda x: x[:2])]
    while len(taken) < budget:
        x, used = unit(np.stack([t[2] for t in taken])), {t[1] for t in taken}

        def farthest(keys, mark, m):
            far = np.round(1 - (unit(m) @ x.T).max(axis=1), 12)
            far[[k in used for k in keys]] = -np.inf
            return -far.max(), keys[int(np.argmax(far))], m[int(np.argmax(far))]

        taken.append(min(run(farthest), key=lambda x: x[:2]))
    return [t[1] for t in taken]


def gains(some: DataFrame, tiles: DataFrame, taken: dict[int, list[tuple]]) -> DataFrame:
    """``(group, key, gain)``: what each other row of the tiles ``some`` adds to what the rows taken reach, summed over all ``tiles`` of its group (from pairs of tiles, each once if both are one table)."""
    chosen = {g: (unit(np.stack([t[1] for t in own])).T, {t[0] for t in own}) for g, own in taken.items()}
    both = some is tiles

    def run(left: dict, right: dict) -> pd.DataFrame:
        x, y, (c, used) = matrix(left), matrix(right), chosen[left["group"]]
        a, b, gain, other = (x @ c).max(axis=1), (y @ c).max(axis=1), np.empty(len(x)), np.zeros(len(y))
        for at in range(0, len(x), SLAB):
            own = slice(at, at + SLAB)
            sim = x[own] @ y.T
            gain[own] = np.maximum(sim - b[None, :], 0).sum(axis=1)
            if both and left["t"] != right["t"]:
                other += np.maximum(sim - a[own, None], 0).sum(axis=0)
        out = pd.DataFrame({"group": left["group"], "key": left["keys"], "gain": gain})
        if both and left["t"] != right["t"]:
            out = pd.concat([out, pd.DataFrame({"group": left["group"], "key": right["keys"], "gain": other})])
        return out[[k not in used for k in out["key"]]]

    some, tiles = (df.where(F.col("group").isin(*taken)) for df in (some, tiles))
    kind = tiles.schema["keys"].dataType.elementType.simpleString()
    on = "r_t >= l_t AND r_t < l_end" if both else "r_t >= l_low AND r_t < l_end"
    return meet(some, tiles, on, run, f"group int, key {kind}, gain double").groupBy("group", "key").agg(F.sum("gain").alias("gain"))


def facility_in_passes(rows: DataFrame, budgets: dict[int, int]) -> dict[int, list]:
    """``facility_location`` of groups of any size, of all together: the keys taken in each group of ``rows(group, low, end, key, v)``, whose tiles are ``low`` to ``end``.

    Against no choice a gain is linear, so the first needs sums only. The gains over the first choice come from all pairs of tiles;
    as gains only shrink, they bound the later ones. A step works out those of the highest bounds (unless that failed
    the last time; then at powers of two), and where another row could have a greater one, those of all rows, which
    are the bounds from then on. The driver holds the chosen rows.
    """
    place = (F.col("low") + dealt("key", F.col("end") - F.col("low"))).alias("t")
    tiles = packed(rows.select("*", place), ["group", "low", "end", "t"])
    kind = tiles.schema["keys"].dataType.elementType.simpleString()

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for tile in pdf.to_dict("records"):
                yield pd.DataFrame({"group": [tile["group"]], "t": [tile["t"]], "s": [matrix(tile).sum(axis=0)]})

    total: dict[int, np.ndarray] = {}
    for r in tiles.mapInPandas(sums, "group int, t int, s array<double>").orderBy("t").collect():  # a row for each tile
        total[r["group"]] = total.get(r["group"], 0) + np.array(r["s"])

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for tile in pdf.to_dict("records"):
                gain = matrix(tile) @ total[tile["group"]]
                at = int(np.argmax(np.round(gain, 9)))
                yield pd.DataFrame({"group": [tile["group"]], "key": [tile["keys"][at]], "gain": [gain[at]]})

    taken: dict[int, list[tuple]] = {g: [] for g in budgets}
    bounds: dict[int, DataFrame] = {}  # by group, the table that holds them
    settled: set[int] = set()
    found, spark = tiles.mapInPandas(first, f"group int, key {kind}, gain double"), rows.sparkSession

    def take(found: DataFrame, rest: dict[int, float]) -> None:
        best = found.groupBy("group").agg(F.min_by(F.struct("key", "gain"), F.struct(-F.round("gain", 9), "key")).alias("b")).select("group", "b.*")
        for r in rows.join(F.broadcast(best), ["group", "key"]).dropDuplicates(["group", "key"]).select("group", "key", "gain", "v").collect():
            if r["gain"] > rest.get(r["group"], -np.inf) + 1e-6:
                taken[r["group"]].append((r["key"], np.array(r["v"], np.float64)))

    take(found, {})
    while left := {g: own for g, own in taken.items() if len(own) < budgets[g]}:
        before = {g: len(own) for g, own in taken.items()}
        tried = {g: own for g, own in left.items() if g in bounds and (g in settled or not len(own) & (len(own) - 1))}
        known = [table.where(F.col("group").isin([g for g in tried if bounds[g] is table])) for table in {id(bounds[g]): bounds[g] for g in tried}.values()]
        if known:
            used = spark.createDataFrame([(g, t[0]) for g, own in tried.items() for t in own], f"group int, key {kind}")
            by = Window.partitionBy("group").orderBy(F.desc("gain"), "key")
            top = reduce(DataFrame.unionByName, known).join(F.broadcast(used), ["group", "key"], "left_anti")
            top = cut(top.withColumn("r", F.row_number().over(by)).where(F.col("r") <= CANDIDATES + 1))
            rest = {r["group"]: r["gain"] for r in top.where(F.col("r") > CANDIDATES).collect()}
            own = rows.join(F.broadcast(top.where(F.col("r") <= CANDIDATES).select("group", "key")), ["group", "key"]).withColumn("t", F.lit(0))
            take(gains(packed(own, ["group", "low", "end", "t"]), tiles, tried), rest)
            settled = {g for g in settled | set(tried) if len(taken[g]) > before[g] or g not in tried}
        open_ = {g: own for g, own in left.items() if len(taken[g]) == before[g]}
        if open_:
            every = cut(gains(tiles, tiles, open_))
            bounds |= dict.fromkeys(open_, every)
            take(every, {})
            budgets = budgets | {g: len(taken[g]) for g in open_ if len(taken[g]) == before[g]}  # keys that repeat run out before the rows
    return {g: [t[0] for t in own] for g, own in taken.items()}


def select(df: DataFrame, method: str, by: list[str], key: str, vec: str, budget: str | int, max_group: int = MAX_GROUP) -> DataFrame:
    """Rows of each group that ``method`` takes. ``budget`` is a number or a column that is constant in a group.

    ``max_group`` bounds the rows that one task holds, not those that are looked at:
    larger groups take passes over all their rows, one group after the other (facility location: all together).
    """
    pick = METHODS[method]
    quota = F.lit(budget) if isinstance(budget, int) else F.col(budget)
    most = min(max_group, MAX_SQUARE) if method == "facility" else max_group
    own = df.select(*by, F.col(key).alias("__key"), F.xxhash64(key).alias("__mark"), F.col(vec).alias("__vec"), quota.cast("int").alias("__budget"))
    sizes = own.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.max("__budget").alias("__b"))
    large = sizes.where(F.col("__n") > most).collect()
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by) + ", " * bool(by) + f"__key {df.schema[key].dataType.simpleString()}"

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__key")
        own = pick(np.stack(pdf["__vec"].to_numpy()).astype(np.float64), int(pdf["__budget"].iloc[0]), pdf["__mark"].to_numpy())
        return pdf.iloc[sorted(set(own))][[*by, "__key"]]

    small, again, done = own, [], []
    whole = [(g, r, min(r["__b"], r["__n"])) for g, r in enumerate(large)] if method == "facility" else []
    if any(n > 0 for _, _, n in whole):
        marks, end = [], 0
        for g, r, n in whole:
            low, end = end, end + max(1, -(-r["__n"] // TILE))
            if n > 0:
                marks.append((*[r[c] for c in by], g, low, end))
        numbers = df.sparkSession.createDataFrame(marks, ", ".join([*[f"__{k} {df.schema[c].dataType.simpleString()}" for k, c in enumerate(by)], "group int, low int, end int"]))
        same = F.lit(True)
        for k, c in enumerate(by):
            same &= F.col(c).eqNullSafe(F.col(f"__{k}"))
        rows = own.join(F.broadcast(numbers), same).select("group", "low", "end", F.col("__key").alias("key"), F.col("__vec").alias("v"))
        chosen = facility_in_passes(rows, {m[-3]: whole[m[-3]][2] for m in marks})
    for g, r in enumerate(large):
        here = F.lit(True)
        for c in by:
            here &= F.col(c).eqNullSafe(F.lit(r[c]).cast(df.schema[c].dataType))
        rows, n = own.where(here) if method == "facility" else cut(own.where(here)), min(r["__b"], r["__n"])
        small = small.where(~here)
        run = in_passes(rows.select("__key", "__mark", "__vec"))
        if method == "farthest":
            keys = farthest_in_passes(run, n)
        elif n <= 0:
            continue
        elif method == "facility":
            keys = chosen[g]
        elif r["__n"] <= (n if method == "kmeans" else 3 * n):
            again.append(rows)  # no more than the budget or the sample's kernel takes in
            continue
        else:
            keys = (nearest_unused if method == "kmeans" else nearest_members)(run, kmeans(run, n if method == "kmeans" else 3 * n))
        picked = df.sparkSession.createDataFrame([(k,) for k in keys], f"__key {df.schema[key].dataType.simpleString()}")
        (again if method == "kdpp" else done).append(rows.join(F.broadcast(picked), "__key", "left_semi").select(own.columns))
    for x in again:
        small = small.unionByName(x)
    taken = small.groupBy(*(by or [F.lit(0).alias("__all")])).applyInPandas(rank, kinds)
    for x in done:
        taken = taken.unionByName(x.select(*by, "__key"))
    return df.join(taken.select(F.col("__key").alias(key)), key, "left_semi")


def vendi_of(kernel: np.ndarray) -> float:
    """``exp`` of the entropy of the kernel's eigenvalues over its size, those of 0 and under left out."""
    value = np.linalg.eigvalsh(kernel / len(kernel))
    value = value[value > 0]
    return float(np.exp(-(value * np.log(value)).sum()))


def vendi(df: DataFrame, by: list[str], key: str, vec: str) -> DataFrame:
    """Vendi score ``(by, vendi, n)`` of each group over ``(cosine + 1) / 2``, exact over all its rows.

    That kernel is the product of the matrix of rows ``(x, 1) / sqrt(2)`` (``x`` of norm 1) with its transpose, so its
    eigenvalues are those of the moment matrix of these rows, whose side is the dimension and one. Tasks add up
    the moments of their rows group by group, the sums of tasks are added row by row of the matrix.
    """

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None  # group, its columns, moments, rows
        out = lambda g: g[1].iloc[[0] * len(g[2])].reset_index(drop=True).assign(i=np.arange(len(g[2])), m=list(g[2]), n=g[3])
        for pdf in batches:
            for own, part in pdf.groupby(by, dropna=False, sort=False):
                x = unit(np.stack(part[vec].to_numpy()).astype(np.float64))
                z = np.column_stack([x, np.ones(len(x))]) / np.sqrt(2)
                same = held is not None and all(a == b or a != a and b != b or a is None and b is None for a, b in zip(held[0], own, strict=True))
                if held is not None and not same:
                    yield out(held)
                held = (own, part[by].iloc[:1], z.T @ z + (held[2] if same else 0), len(x) + (held[3] if same else 0))
        if held is not None:
            yield out(held)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[[*by, "i"]].iloc[:1].assign(m=[np.sum(np.stack(pdf["m"].to_numpy()), axis=0)], n=pdf["n"].sum())

    def value(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        v = np.linalg.eigvalsh(np.stack(pdf.sort_values("i")["m"].to_numpy()) / n)
        v = v[v > 1e-15]
        return pdf[by].iloc[:1].assign(vendi=float(np.exp(-(v * np.log(v)).sum())), n=n)

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    rows = df.where(F.col(vec).isNotNull()).select(*by, vec).sortWithinPartitions(*by)
    sums = rows.mapInPandas(moments, f"{kinds}, i long, m array<double>, n long").groupBy(*by, "i").applyInPandas(add, f"{kinds}, i long, m array<double>, n long")
    return sums.groupBy(*by).applyInPandas(value, kinds + ", vendi double, n long")


def pca_coverage(df: DataFrame, vec: str, chosen: str, bins: int = 50, pad: float = 0.05) -> DataFrame:
    """Cells of a grid over the first two principal components that all rows, and the chosen rows, occupy; and their ratio.

    The covariance comes from one aggregation of sums of products (its size is
    the square of the dimension); the projection is native arithmetic.
    """
    d = df.select(F.size(vec).alias("d")).agg(F.max("d")).first()[0] or 0

    def moments(batches):
        s, p, n = np.zeros(d), np.zeros((d, d)), 0
        for pdf in batches:
            m = np.stack(pdf["v"].to_numpy()).astype(np.float64) if len(pdf) else np.zeros((0, d))
            s, p, n = s + m.sum(axis=0), p + m.T @ m, n + len(m)
        yield pd.DataFrame({"k": np.arange(d * d + d + 1), "x": np.r_[n, s, p.ravel()]})

    got = df.select(F.col(vec).alias("v")).mapInPandas(moments, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).orderBy("k").collect()
    x = np.array([r["x"] for r in got])
    n, s, p = x[0], x[1 : d + 1], x[d + 1 :].reshape(d, d)
    mean = s / n
    _, axes = np.linalg.eigh(p / n - np.outer(mean, mean))
    axes = axes[:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), [0, 1]])
    coord = lambda k: F.aggregate(F.zip_with(vec, F.array(*map(F.lit, axes[:, k].tolist())), lambda a, b: a.cast("double") * b), F.lit(-float(mean @ axes[:, k])), lambda a, b: a + b)
    at = df.select(coord(0).alias("x"), coord(1).alias("y"), F.col(chosen).alias("c"))
    low = at.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("x", "y") for f in (F.min, F.max)])
    cell = lambda c: F.least(F.lit(bins - 1), F.floor(bins * (F.col(c) - F.col(f"min_{c}") + pad * (F.col(f"max_{c}") - F.col(f"min_{c}"))) / ((1 + 2 * pad) * F.greatest(F.col(f"max_{c}") - F.col(f"min_{c}"), F.lit(1e-12)))))
    cells = at.crossJoin(F.broadcast(low)).groupBy(cell("x").alias("i"), cell("y").alias("j")).agg(F.max(F.col("c").cast("int")).alias("c"))
    return cells.agg(F.count(F.lit(1)).alias("cells"), F.sum("c").alias("covered")).withColumn("coverage", F.col("covered") / F.col("cells"))
