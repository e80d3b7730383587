"""SimHash and embedding groups against all pairs."""

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from factweave.llm import embed_dedup, simhash
from factweave.llm.common import connected_components, forest


def plain_components(ids, links):
    low = {i: i for i in ids}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        low[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    each = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in each]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \t", "One", "a b c", "A b C d", "a b c d e", "x y É é İ " * 40, "the same words " * 50])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_forest_and_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000, k) for k in range(1001, 1200)] + [(k, k + 1) for k in range(2000, 2040)]
    want = plain_components({x for p in links for x in p}, links)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] for p in links)}
    a, b = forest(*np.array(links).T)
    assert {**{x: x for x in want}, **dict(zip(a.tolist(), b.tolist(), strict=True))} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def spread(n, seed=2):
    """Fingerprints at random, with dense groups around some of them."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 64, n, dtype=np.uint64)
    out = [*base.tolist()]
    for c in base[:6].tolist():
        for _ in range(60):
            x = c
            for b in rng.choice(64, rng.integers(1, 6), replace=False).tolist():
                x ^= 1 << b
            out.append(x)
    return np.unique(np.array(out, np.uint64))


def test_vantage_tree_finds_all():
    points = spread(800)
    tree = simhash.VantageTree(points, leaf=16)
    for q in points[::7]:
        want = np.flatnonzero(np.bitwise_count(points ^ q) <= 4)
        assert sorted(tree.within(q, 4).tolist()) == want.tolist()


@pytest.mark.parametrize(("blocks", "shard_rows"), [(None, 20_000), (6, 40), (7, 100), (5, 30)])
def test_links_join_what_all_pairs_join(spark, blocks, shard_rows):
    points = spread(400)
    rows = [(int(p), k) for k, p in enumerate(points.view(np.int64))]
    got = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame(rows, "fp long, rep long"), 4, blocks, shard_rows).collect()]
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 4
    assert all(near[a, b] or plain_components(range(len(points)), got)[a] == plain_components(range(len(points)), got)[b] for a, b in got[:20])
    all_pairs = list(zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1))), strict=True))
    assert plain_components(range(len(points)), got) == plain_components(range(len(points)), all_pairs)


def test_near_duplicates_over_messy_rows(messy, empty):
    rows = messy.collect()
    fp = [plain_fingerprint(r["text"]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4]
    of = plain_components(range(len(rows)), links)
    least = {}
    for k, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[of[k]] = min(r["doc_id"], least.get(of[k], 1 << 60))
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, fp[k], least.get(of[k])) for k, r in enumerate(rows))
    got = sorted((r["id"] is None, r["id"] or 0, r["fp"] % (1 << 64), r["component"]) for r in simhash.near_duplicates(messy).collect())
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0


def test_keep_one(messy, empty):
    own = simhash.near_duplicates(messy).collect()
    keep = {r["id"] for r in own if r["id"] is not None and r["id"] == r["component"]}
    got = simhash.keep_one(messy)
    assert got.columns == messy.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(keep)
    assert ids.count(None) == 2
    assert simhash.keep_one(empty).count() == 0


vector = st.lists(st.floats(-1e6, 1e6, width=32).filter(lambda x: x == 0 or abs(x) > 1e-3), min_size=8, max_size=8).filter(any)


@settings(max_examples=60, deadline=None)
@given(st.lists(vector, min_size=2, max_size=12))
def test_error_bound_is_rigorous(vectors):
    m = np.array(vectors, np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    q, s, e = embed_dedup.quantise(unit)
    near = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s[None, :]
    assert (np.abs(unit @ unit.T - near) <= e[:, None] + e[None, :] + e[:, None] * e[None, :] + 1e-12).all()


def test_tile_links_equal_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 64))
    m = np.concatenate([rng.normal(size=(1500, 64)), base, base + rng.normal(size=base.shape) * 0.35, base * 3.0, base * 1e-30])
    want = np.triu((m / np.linalg.norm(m, axis=1, keepdims=True)) @ (m / np.linalg.norm(m, axis=1, keepdims=True)).T >= 0.9, 1)
    got = np.zeros_like(want)
    for i, j in embed_dedup.tile_links(m, m, 0.9, True):
        got[i, j] = True
    assert (got == want).all() and want.sum() > 100
    got = np.zeros((900, len(m) - 900), bool)
    for i, j in embed_dedup.tile_links(m[:900], m[900:], 0.9, False):
        got[i, j] = True
    assert (got == want[:900, 900:]).all()


@pytest.mark.parametrize("tile_rows", [4096, 16])
def test_embedding_groups(spark, tile_rows):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16)).astype(np.float32)
    good = np.concatenate([rng.normal(size=(60, 16)), base, base + rng.normal(size=base.shape) * 0.2, base, base[:2] * 2]).astype(np.float32)
    rows = [(k, v.tolist(), "x") for k, v in enumerate(good)] + [(500, None, ""), (501, [0.0] * 16, ""), (502, [float("nan")] * 16, ""), (503, [None] + [1.0] * 15, ""), (504, [float("inf")] + [1.0] * 15, ""), (505, [], ""), (506, [1.0, 2.0], ""), (507, [1.0, 2.0], "")]
    m = good.astype(np.float64)
    cos = (m @ m.T) / np.linalg.norm(m, axis=1)[:, None] / np.linalg.norm(m, axis=1)[None, :] >= 0.9
    np.fill_diagonal(cos, False)
    comp = plain_components(range(len(good)), zip(*(x.tolist() for x in np.nonzero(cos)), strict=True))
    want = {k: (int(cos[k].sum()), comp[k]) for k in range(len(good))} | {k: (0, k) for k in range(500, 506)} | {506: (1, 506), 507: (1, 506)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string").repartition(3)
    got = {r["id"]: (r["n_links"], r["component"]) for r in embed_dedup.near_duplicates(df, tile_rows=tile_rows).collect()}
    assert got == want
    assert embed_dedup.near_duplicates(df.where("1 = 0")).count() == 0


def test_pairs_between_the_bounds_are_recomputed(spark):
    """Vectors around the threshold, many in a group of near copies: each link is decided in one of the two passes."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=64)
    turned = []
    for cosine in np.r_[np.linspace(0.88, 0.92, 120), [1.0] * 40]:
        other = rng.normal(size=64)
        other -= base * (other @ base) / (base @ base)
        turned.append(cosine * base / np.linalg.norm(base) + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other))
    m = np.concatenate([np.array(turned), [base]]).astype(np.float32)
    x = m.astype(np.float64)
    cos = (x @ x.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None, :] >= 0.9
    np.fill_diagonal(cos, False)
    codes = embed_dedup.quantise(embed_dedup.unit_vectors(x))
    kinds = [sure for _, _, sure in embed_dedup.close_pairs(codes, codes, 0.9, True)]
    assert {False, True} <= set(np.concatenate(kinds).tolist())
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "vec_id long, embedding array<float>").repartition(3)
    got = {r["id"]: r["n_links"] for r in embed_dedup.near_duplicates(df, tile_rows=30).collect()}
    assert got == {k: int(cos[k].sum()) for k in range(len(m))}
