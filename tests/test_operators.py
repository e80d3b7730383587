"""Operators: hand-worked cases, brute force and invariants. Rows come in shuffled order."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.operators import aggregates, components, dedup, filters, judgelog, providers, records, rewards, sampling, selection, similarity
from factweave.plans import curation, qacheck
from factweave.sources import corpora, files, raw


def table(spark, rows, schema):
    rows = list(rows)
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, schema).repartition(3)


def plain_greedy(keys, similar):
    kept = []
    for k in sorted(keys):
        if not any(similar(a, k) for a in kept):
            kept.append(k)
    return kept


def test_greedy_chain(spark):
    nodes = table(spark, [(k,) for k in range(6)], "ord long")
    pairs = table(spark, [(0, 1), (1, 2), (3, 4), (4, 5), (2, 3)], "a long, b long")
    assert sorted(r[0] for r in dedup.greedy_keep(nodes, pairs).collect()) == [0, 2, 4]


def test_greedy_equals_the_sequential_pass(spark):
    rng = random.Random(1)
    links = {tuple(sorted(rng.sample(range(80), 2))) for _ in range(160)}
    got = dedup.greedy_keep(table(spark, [(k,) for k in range(80)], "ord long"), table(spark, links, "a long, b long"))
    assert sorted(r[0] for r in got.collect()) == plain_greedy(range(80), lambda a, b: (a, b) in links)


def test_jaccard_dedup(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.sample(words, 20)) for _ in range(25)]
    for _ in range(40):
        w = rng.choice(texts).split()
        w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    texts += [texts[3], texts[3].upper(), "", " ", None]
    sets = [set((t or "").lower().split()) for t in texts]
    jac = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7 if sets[a] | sets[b] else False
    df = table(spark, enumerate(texts), "ord long, claim string")
    assert sorted(r["ord"] for r in dedup.jaccard_dedup(df).collect()) == plain_greedy(range(len(texts)), jac)
    assert dedup.jaccard_dedup(df.where("1 = 0")).count() == 0


def test_decontamination(spark):
    df = table(spark, [(0, " The Claim "), (1, "other words here now"), (2, None), (3, "a b c d e f g h i j")], "ord long, claim string")
    refs = table(spark, [(0, "the claim"), (1, "a b c d e f g h i x")], "ord long, claim string")
    assert sorted(r["ord"] for r in dedup.exact_decontaminate(df, refs, "claim", "claim").collect()) == [1, 2, 3]
    assert sorted(r["ord"] for r in dedup.jaccard_decontaminate(df, refs, "ord", "claim", "ord", "claim").collect()) == [1, 2]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(90, 6)).astype(np.float32)
    m[60:75] = m[:15] + rng.normal(size=(15, 6)) * 0.1
    return m, table(spark, [(k, v.tolist(), k % 3) for k, v in enumerate(m)], "k long, v array<float>, g int")


@pytest.mark.parametrize("tile", [2048, 13])
def test_semantic(vectors, tile, monkeypatch):
    monkeypatch.setattr(similarity, "TILE", tile)
    m, df = vectors
    x = selection.unit(m.astype(np.float64))
    sim = x @ x.T
    got = {(r["a"], r["b"]) for r in similarity.similar_pairs(df, "k", "v", 0.7).collect()}
    assert got == {(i, j) for i in range(90) for j in range(i + 1, 90) if sim[i, j] >= 0.7}
    assert sorted(r["k"] for r in similarity.semantic_dedup(df, "k", "v", 0.7).collect()) == plain_greedy(range(90), lambda a, b: sim[a, b] >= 0.7)
    own, refs = df.where("g = 0"), df.where("g = 1")
    best = {r["k"]: r["best"] for r in similarity.best_similarity(own, refs, "k", "v", "k", "v").collect()}
    assert best == pytest.approx({k: sim[k, 1::3].max() for k in range(0, 90, 3)})
    assert sorted(r["k"] for r in similarity.semantic_decontaminate(own, refs, "k", "v", "k", "v", 0.6).collect()) == [k for k in range(0, 90, 3) if best[k] < 0.6]
    assert similarity.semantic_decontaminate(own, refs.where("1 = 0"), "k", "v", "k", "v").count() == 30


def test_avg_cosine_distance(vectors):
    m, df = vectors
    x = selection.unit(m.astype(np.float64))
    iu = np.triu_indices(90, 1)
    assert similarity.avg_cosine_distance(df, "v").first()[0] == pytest.approx((1 - (x @ x.T)[iu]).mean())


def counts(spark, rows):
    return table(spark, [(s, n, k, 0) for k, (s, n) in enumerate(rows)], "src string, n long, first_ord long, g int")


@pytest.mark.parametrize(("rows", "budget", "want"), [([("a", 4), ("b", 4)], 3, {"a": 2, "b": 2}), ([("a", 100), ("b", 1)], 20, {"a": 19, "b": 1}), ([("a", 5), ("b", 3)], 100, {"a": 5, "b": 3})])
def test_source_budgets(spark, rows, budget, want):
    assert {r["src"]: r["budget"] for r in sampling.source_budgets(counts(spark, rows), budget, ["g"]).collect()} == want


def test_waterfill(spark):
    rows = [("a", 18), ("b", 23), ("c", 474), ("d", 2402), ("e", 2441), ("f", 41060)]
    got = {r["label"]: r["budget"] for r in sampling.waterfill(table(spark, rows, "label string, n long"), 5000).collect()}
    assert got == {"a": 18, "b": 23, "c": 474, "d": 1495, "e": 1495, "f": 1495}
    assert sum(r["budget"] for r in sampling.waterfill(table(spark, rows, "label string, n long"), 10**6).collect()) == sum(n for _, n in rows)


def test_components(spark):
    rng = random.Random(13)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1700)] + [(5000, 5000)]
    parent = {k: k for link in links for k in link}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in components.components(table(spark, links, "a long, b long")).collect()}
    assert got == {k: root(k) for a, b in links if a != b for k in (a, b)}
    assert components.components(table(spark, [], "a long, b long")).count() == 0


@pytest.mark.parametrize("walk", [dedup.WALK, 40])
def test_large_groups_take_rounds(spark, walk):
    rng = random.Random(14)
    links = {tuple(sorted(rng.sample(range(200), 2))) for _ in range(260)}
    got = dedup.greedy_keep(table(spark, [(k,) for k in range(200)], "ord long"), table(spark, list(links), "a long, b long"), walk=walk)
    assert sorted(r[0] for r in got.collect()) == plain_greedy(range(200), lambda a, b: (a, b) in links)


def test_chain_of_a_thousand(spark):
    chain = table(spark, [(k, k + 1) for k in range(1000)], "a long, b long")
    assert sorted(r[0] for r in dedup.greedy_keep(table(spark, [(k,) for k in range(1001)], "ord long"), chain).collect()) == list(range(0, 1001, 2))


def test_near_copies_are_not_paired(spark, monkeypatch):
    """Thousands of near copies and a few texts beside them: what the pass keeps, from few candidate pairs."""
    rng = random.Random(15)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base[:k] + [f"x{rng.randrange(10**6)}"] + base[k + 1 :]) for k in (rng.randrange(60) for _ in range(3000))] + [" ".join(f"y{rng.randrange(300)}" for _ in range(20)) for _ in range(40)]
    order = rng.sample(range(len(texts)), len(texts))
    sets = [frozenset(t.split()) for t in texts]
    jac = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7
    seen = []
    real = dedup.candidates
    monkeypatch.setattr(dedup, "candidates", lambda *a: (seen.append(out := real(*a)), out)[1])
    df = table(spark, [(k, texts[k]) for k in order], "ord long, claim string").repartition(4)
    first = min(k for k in range(3000))
    assert sorted(r["ord"] for r in dedup.jaccard_dedup(df).collect()) == [first] + [k for k in plain_greedy(range(3000, 3040), jac)]
    assert seen[-1].count() < 1000
    m = np.random.default_rng(3)
    v = np.concatenate([m.normal(size=8) + 0.05 * m.normal(size=(3000, 8)), m.normal(size=(40, 8))])
    x = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim = x @ x.T
    made = []
    monkeypatch.setattr(similarity, "similar_pairs", lambda d, *a, real=similarity.similar_pairs: (made.append(d), real(d, *a))[1])
    got = similarity.semantic_dedup(table(spark, [(k, r.tolist()) for k, r in enumerate(v)], "k long, v array<double>").repartition(3), "k", "v", 0.9)
    assert sorted(r["k"] for r in got.collect()) == plain_greedy(range(len(v)), lambda a, b: sim[a, b] >= 0.9)
    assert made[0].count() < 100


def test_greedy_pass_settles_long_chains(spark):
    nodes = table(spark, [(k,) for k in range(106)], "ord long")
    chain = table(spark, [(k, k + 1) for k in range(105)], "a long, b long")
    assert sorted(r[0] for r in dedup.greedy_keep(nodes, chain).collect()) == list(range(0, 106, 2))


def test_samples(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, 0).otherwise(1).alias("label"), sampling.hash_split(F.col("id").cast("string")).alias("split"))
    got = sampling.random_select(df, "label", "k", 400).collect()
    assert sorted(got) == sorted(sampling.random_select(df.repartition(7), "label", "k", 400).collect())
    assert sum(r["label"] == 0 for r in got) == 300 and sum(r["label"] == 1 for r in got) == 400
    per = {}
    for r in sampling.balanced(df, "label", "k").collect():
        per[r["split"], r["label"]] = per.get((r["split"], r["label"]), 0) + 1
    assert all(per[s, 0] == per[s, 1] for s in ("train", "validation", "test"))
    share = {r["split"]: r["count"] / 3000 for r in df.groupBy("split").count().collect()}
    assert share["train"] == pytest.approx(0.9, abs=0.03)
    assert sampling.stratified(df, "label", "k", 500).count() == 500
    with pytest.raises(Exception, match="whole numbers"):
        sampling.stratified(df.withColumn("label", F.lit(0.5)), "label", "k", 5).collect()


def test_farthest_points():
    m = np.array([[1, 0], [0.9, 0.1], [0, 1], [-1, 0.05], [0.5, 0.5]])
    got = selection.farthest_points(m, 3)
    x = selection.unit(m)
    first = int(np.argmax(x @ x.mean(axis=0)))
    assert got[0] == first and got[1] == int(np.argmin(x @ x[first])) and len(set(got)) == 3
    assert len(selection.farthest_points(m, 0)) == 1 and len(selection.farthest_points(m, 99)) == 5


def test_facility_location_is_greedy():
    m = np.random.default_rng(5).normal(size=(12, 3))
    x = selection.unit(m)
    got = selection.facility_location(m, 3)
    value = lambda s: (x @ x[list(s)].T).max(axis=1).sum()
    for k in range(1, 4):
        assert value(got[:k]) == pytest.approx(max(value([*got[: k - 1], j]) for j in range(12) if j not in got[: k - 1]))


@pytest.mark.parametrize("method", ["farthest", "facility", "kmeans", "kdpp"])
@pytest.mark.parametrize("max_group", [20_000, 12])
def test_selection_fills_the_budget(vectors, method, max_group):
    _, df = vectors
    rows = selection.select(df, method, ["g"], "k", "v", 5, max_group).collect()
    assert sorted(rows) == sorted(selection.select(df.repartition(5), method, ["g"], "k", "v", 5, max_group).collect())
    assert len({r["k"] for r in rows}) == 15 and {sum(r["g"] == g for r in rows) for g in range(3)} == {5}


@pytest.mark.parametrize("method", ["farthest", "facility", "kmeans", "kdpp"])
def test_large_groups_are_selected_from_as_a_whole(spark, method, monkeypatch):
    monkeypatch.setattr(selection, "CANDIDATES", 8)
    rng = np.random.default_rng(9)
    m = np.concatenate([rng.normal(size=(6, 8)) * 0.2 + c for c in rng.normal(size=(40, 8))] + [rng.normal(size=(4, 8)) * 5])
    df = table(spark, [(k, [float(x) for x in v], None if k % 5 == 0 else k % 5 // 3) for k, v in enumerate(m)], "k long, v array<double>, g int").repartition(3)
    whole = selection.select(df, method, ["g"], "k", "v", 6).collect()
    assert sorted(r["k"] for r in selection.select(df, method, ["g"], "k", "v", 6, 15).collect()) == sorted(r["k"] for r in whole)
    assert len(whole) >= 12


def test_diversity_scores(spark, vectors):
    m, df = vectors
    same = table(spark, [(k, [1.0, 0.0], 0) for k in range(4)], "k long, v array<double>, g int")
    assert selection.vendi(same, ["g"], "k", "v").first()["vendi"] == pytest.approx(1.0)
    x = m.astype(np.float64) - m.mean(axis=0)
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    xy = x @ vt[:2].T
    cell = lambda c: np.minimum(49, np.floor(50 * (c - c.min() + 0.05 * np.ptp(c)) / (1.1 * np.ptp(c)))).astype(int)
    got = selection.pca_coverage(df.withColumn("c", F.col("g") == 0), "v", "c").first()
    assert abs(got["cells"] - len({*zip(cell(xy[:, 0]), cell(xy[:, 1]), strict=True)})) <= 2 and 0 < got["coverage"] < 1


def test_metrics(spark):
    got = aggregates.binary_metrics(table(spark, [("S", None), ("R", None)], "gt_label string, pred_label string").select(F.when(F.col("gt_label") == "S", "Supported").otherwise("Refuted").alias("gt_label"), "pred_label")).first()
    assert (got["accuracy"], got["precision"], got["recall"], got["f1"], got["unparsed"]) == (0.5, 0, 0, 0, 2)
    rows = [(0, 0), (0, 1), (1, 1), (2, 1), (2, 2), (2, 2)]
    got = aggregates.multiclass_metrics(table(spark, rows, "label int, pred int"), [0, 1, 2]).first()
    f1 = [2 / 3, 1 / 2, 4 / 5]
    assert got["accuracy"] == pytest.approx(4 / 6) and got["macro_f1"] == pytest.approx(sum(f1) / 3)
    assert got["weighted_f1"] == pytest.approx((2 * f1[0] + f1[1] + 3 * f1[2]) / 6) and got["balanced_accuracy"] == pytest.approx((1 / 2 + 1 + 2 / 3) / 3)
    votes = table(spark, [(1, "supported"), (1, "refuted"), (2, "b"), (2, "b"), (2, "a"), (3, None)], "p long, v string")
    assert {r["p"]: r["majority"] for r in aggregates.majority_vote(votes, ["p"], "v").collect()} == {1: "refuted", 2: "b"}


def test_nearest_rank(spark):
    values = [random.Random(4).randrange(50) for _ in range(101)]
    got = aggregates.nearest_rank(table(spark, [(v, 0) for v in values], "v int, g int"), F.col("v"), ["g"], [0, 25, 50, 99, 100]).first()
    own = sorted(values)
    assert [got[f"p{p}"] for p in (0, 25, 50, 99, 100)] == [own[round(p / 100 * 100)] for p in (0, 25, 50, 99, 100)]


def verdicts(spark, full, rest, truth="Supported"):
    rows = [(0, 0, len(rest), 0, full, truth)] + [(0, 0, len(rest), k, v, truth) for k, v in enumerate(rest, 1)]
    return table(spark, rows, "prompt_id long, gen_idx int, n int, left_out int, verdict string, truth string")


def test_necessity(spark):
    got = rewards.necessity(verdicts(spark, "supported", ["refuted", "supported"]), True).first()
    assert (got["score"], got["per_q"]) == (0.75, [1.0, 0.5])
    assert rewards.necessity(verdicts(spark, "supported", ["refuted", "supported"]), True, "min").first()["score"] == 0.5
    got = rewards.necessity(verdicts(spark, "refuted", ["supported", "refuted"]), True).first()
    assert (got["score"], got["per_q"]) == (-0.5, [-1.0, 0.0])
    assert rewards.necessity(verdicts(spark, None, ["supported"]), False).first()["score"] == 1.0
    assert rewards.necessity(verdicts(spark, None, [None, "supported"]), False).first()["per_q"] == [0.0, 1.0]


def test_leave_one_out(spark):
    qa = table(spark, [(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 0, 3, "c")], "prompt_id long, gen_idx int, index int, answer string")
    got = {r["left_out"]: r["answers"] for r in rewards.leave_one_out(qa).collect()}
    assert got == {0: ["a", "b", "c"], 1: ["b", "c"], 2: ["a", "c"], 3: ["a", "b"]}


def test_question_scores(spark):
    rows = [("I don't know.", 0, 1, 1.0), ("I don't know.", 1, 1, 0.0), ("yes", 1, 0, 1.0), ("yes", None, None, 0.0)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, answer string, able int, right int, want double").orderBy("k")
    assert [r[0] for r in df.select(rewards.answerable_score(F.col("answer"), F.col("able"))).collect()] == [r[3] for r in rows]
    five = F.array(*[F.lit(x) for x in (1, 1, 0, None, 1)])
    assert [r[0] for r in df.select(rewards.joint_score(F.col("answer"), F.col("able"), five, F.col("right"))).collect()] == pytest.approx([0.6, 0.0, 0.0, 0.0])
    scored = df.select(F.lit(1).alias("prompt_id"), F.lit(0).alias("gen_idx"), F.col("k").alias("index"), F.col("want").alias("score"))
    got = rewards.per_generation(table(spark, [(1, 0), (2, 0)], "prompt_id int, gen_idx int"), scored).collect()
    assert {r["prompt_id"]: (r["score"], r["per_q"]) for r in got} == {1: (0.5, [1.0, 0.0, 1.0, 0.0]), 2: (0.0, [])}


def test_margin_and_vendi(spark):
    rows = [(1, 0, 1, [1.0, 0.0]), (1, 0, 2, [1.0, 0.0]), (1, 0, 3, [0.0, 1.0]), (2, 0, 1, [1.0, 0.0])]
    df = table(spark, rows, "prompt_id long, gen_idx int, index int, v array<double>")
    assert {r["prompt_id"]: r["score"] for r in rewards.margin_reward(df, "v", "v").collect()} == pytest.approx({1: -1 / 3, 2: -1.0})
    p = np.array([2 / 3, 1 / 3])
    assert {r["prompt_id"]: r["score"] for r in rewards.vendi_reward(df, "v").collect()} == pytest.approx({1: float(np.exp(-(p * np.log(p)).sum()) / 3), 2: 0.0})


def test_records_and_joins(spark, tmp_path):
    df = table(spark, [(k, f"t{k % 4}") for k in range(50)], "k long, t string")
    assert [r["ord"] for r in records.with_order(df, "k").orderBy("k").collect()] == list(range(50))
    assert sorted((r["t"], r["k"]) for r in records.first_by(df, ["t"], "k").collect()) == [("t0", 0), ("t1", 1), ("t2", 2), ("t3", 3)]
    cache = table(spark, [("t0", [1.0]), ("t1", [2.0])], "t string, e array<double>")
    assert sorted(r["t"] for r in records.misses(df, cache, "t").collect()) == ["t2", "t3"]
    with pytest.raises(Exception, match="no embedding for t"):
        records.require(df, cache, "t", "e", "embedding").collect()
    kb = table(spark, [("New York", "ny"), ("new york", "NY2"), ("Rome", "r")], "id string, text string")
    rows = table(spark, [(1, ["Rome", "New_York", "rome"]), (2, ["x"]), (3, None)], "k long, e array<string>")
    got = {r["k"]: r["evidence"] for r in records.entity_evidence(rows, kb, "k", "e", "id", "text").collect()}
    assert got == {1: "r\nNY2", 2: None, 3: None}


def test_cache_upsert_and_provider(spark):
    old = table(spark, [("a", "1", "2024-01-01T00:00:00"), ("b", "1", "2024-01-01T00:00:00")], "key string, value string, created_at string")
    new = table(spark, [("a", "2", "2024-02-01T00:00:00"), ("c", "3", "2024-02-01T00:00:00")], "key string, value string, created_at string")
    whole = providers.upsert(old, new)
    assert {r["key"]: r["value"] for r in whole.collect()} == {"a": "2", "b": "1", "c": "3"}
    df = table(spark, [("a",), ("d",), ("d",)], "key string")
    got, more, failed = providers.provide(df, whole, "key", "value", str.upper)
    assert failed.count() == 0
    assert sorted((r["key"], r["value"]) for r in got.collect()) == [("a", "2"), ("d", "D"), ("d", "D")] and more.count() == 4
    assert tuple(providers.cache_stats(df, whole, "key").first()) == (1, 2)


def test_provider_calls_each_key_once_and_marks_failures(spark, tmp_path):
    import collections
    import threading
    import uuid

    folder = str(tmp_path)

    def call(request):
        """Counts its calls in files; keys fail 0 to 3 times, some for good, and values differ from call to call."""
        import os

        key, fails = request.split(":")
        with open(f"{folder}/{key}.{threading.get_ident()}.{uuid.uuid4().hex}", "x"):
            pass
        seen = sum(f.startswith(f"{key}.") for f in os.listdir(folder))
        if fails == "never":
            raise providers.Refused("bad request")
        if fails == "cut":
            raise providers.Unusable("cut off")
        if fails == "down" or seen <= int(fails):
            raise TimeoutError("busy")
        return uuid.uuid4().hex

    kinds = ["0", "1", "2", "3", "never", "cut", "down"]
    rows = [(f"k{k}", f"k{k}:{kinds[k % 7]}") for k in range(70)] * 2 + [("old", "old:0"), (None, "none:0")]
    df = table(spark, rows, "key string, prompt string")
    cache = table(spark, [("old", "v")], "key string, value string")
    limits = providers.Limits(workers=3, in_flight=5, attempts=5, unusable=2, wait=0.001, most_wait=0.004)
    got = providers.provide(df, cache, "key", "value", call, limits, request="prompt")
    for _ in range(2):  # actions do not call again
        values = {r["key"]: r["value"] for r in got.rows.collect()}
        kept = {r["key"]: r["value"] for r in got.cache.collect()}
        assert got.rows.count() == len(rows) and kept["old"] == values["old"] == "v" and "none" not in kept
        assert all(values[k] == v for k, v in kept.items()) and len(kept) == 41
    failed = {r["key"]: (r["status"], r["attempts"]) for r in got.failed.collect()}
    assert failed == {f"k{k}": {"never": ("refused", 1), "cut": ("unusable", 2), "down": ("exhausted", 5)}[kinds[k % 7]] for k in range(70) if k % 7 > 3}
    calls = collections.Counter(f.name.split(".")[0] for f in tmp_path.iterdir())
    assert calls == {f"k{k}": failed.get(f"k{k}", (0, k % 7 + 1))[1] for k in range(70)}
    assert len({f.name.split(".")[1] for f in tmp_path.iterdir()}) > 3  # threads of the tasks


def test_attempts_wait_longer_up_to_a_cap():
    waits = []

    class Busy(Exception):
        retry_after = 0.0

    def call(_):
        if len(waits) == 3:
            Busy.retry_after = 5.0
        raise Busy("x")

    got = providers.attempt(call, "r", providers.Limits(attempts=7, wait=1.0, most_wait=6.0), waits.append)
    assert got == (None, "exhausted", 7, "Busy: x") and len(waits) == 6
    assert all(a <= w <= 1.1 * a for a, w in zip((1, 2, 4), waits[:3], strict=True)) and waits[3] == 6.0 and max(waits) == 6.0


#: One row of each corpus in the fields of its files, and what the record says.
CORPUS_ROWS = {
    "pubmedclaim": ({"claim": " c ", "final_decision": "yes", "context": {"labels": ["H", "I"], "contexts": ["x", "y", "z"]}}, "## H\nx\n\n## I\ny", "Supported", "yes"),
    "claimdecomp": ({"claim": "c", "label": "barely-true", "justification": "e\n"}, "e", "Refuted", "barely-true"),
    "wice": ({"claim": "c", "label": "supported", "evidence": ["a", "b"]}, "a\nb", "Supported", "supported"),
    "scifact": ({"claim": "c", "evidence_label": "CONTRADICT", "evidence": "e"}, "e", "Refuted", "CONTRADICT"),
    "matter_of_fact": ({"claim_text": "c", "gold_label": True, "metadata": {"supporting_facts_from_paper": ["a", "b"]}}, "a\nb", "Supported", "true"),
    "ex_fever": ({"claim": "c", "label": "SUPPORT", "golden entity": "['New_York']", "mention": None, "result entity": "['rome', 'nowhere']"}, "ny\nr", "Supported", "SUPPORT"),
    "healthver": ({"claim": "c", "label": "Refutes", "evidence": "e, \"f\""}, "e, \"f\"", "Refuted", "Refutes"),
    "pubhealthfact": ({"claim": "c", "label": 0, "main_text": "m"}, "m", "Supported", "0"),
    "fever": ({"sent1": "e", "sent2": "c", "label": "entailment"}, "e", "Supported", "entailment"),
    "covidfact": ({"sent1": "e", "sent2": "c", "label": "not_entailment"}, "e", "Refuted", "not_entailment"),
    "fool_me_twice": ({"text": "c", "label": "REFUTES", "retrieved_evidence": [{"section_header": "h", "text": "t"}, {"section_header": "i", "text": "u"}]}, "## h\nt\n\n## i\nu", "Refuted", "REFUTES"),
    "coverbench": ({"claim": "c", "label": False, "context": "x y"}, "x y", "Refuted", "false"),
    "llmaggrefact": ({"claim": "c", "label": 1, "doc": "d"}, "d", "Supported", "1"),
    "pubhealthtab": ({"claim": "c", "label": "SUPPORTS", "evidence": "| a |", "table": {"html_code": "<table>"}}, "| a |", "Supported", "SUPPORTS"),
    "faviq_a_set": ({"claim": "c", "label": "SUPPORTS", "evidence": "e"}, "e", "Supported", "SUPPORTS"),
    "faviq_r_set": ({"claim": "c", "label": "SUPPORTS", "evidence": "e"}, "e", "Supported", "SUPPORTS"),
    "snopes": ({"claim": "c", "rate": "False", "origin": "o"}, "o", "Refuted", "False"),
    "uphill": ({"claim": "c", "claim_veracity": "true", "main_text": "m"}, "m", "Supported", "true"),
    "ambifc": ({"claim": "c", "labels": {"passage": "refuting"}, "sentences": {"0": "x", "1": "y"}}, "x\ny", "Refuted", "refuting"),
    "hover": ({"claim": "c", "label": "supports", "evidence": "e"}, "e", "Supported", "supports"),
    "feverous": ({"claim": "c", "label": "refutes", "evidence": "e"}, "e", "Refuted", "refutes"),
    "scitab": ({"claim": "c", "label": "supports", "table_caption": "T ", "table_column_names": ["a", "b"], "table_content_values": [["1", "long"], ["2", "3"]]}, "T| a   | b    |\n| --- | ---- |\n| 1   | long |\n| 2   | 3    |", "Supported", "supports"),
}


@pytest.fixture(scope="module")
def corpus_root(spark, tmp_path_factory):
    """Files of all corpora where their splits lie; each holds its row and one of an unknown label."""
    import csv
    import json

    root = tmp_path_factory.mktemp("raw")
    for name, (row, *_) in CORPUS_ROWS.items():
        c = corpora.CORPORA[name]
        label = {"label": "other", "final_decision": "other", "evidence_label": "other", "claim_veracity": "other", "rate": "other"}
        rows = [row] + ([row | {k: v for k, v in label.items() if k in row and isinstance(row[k], str)}] if c.labels and name != "ambifc" and not isinstance(row.get("label"), int) else [])
        for split in dict.fromkeys((*corpora.TRAIN_SPLITS.get(name, ()), *corpora.TEST_SPLITS.get(name, ()), "one")):
            path = root / c.path("", split).lstrip("/")
            path.parent.mkdir(parents=True, exist_ok=True)
            if c.format == "jsonl":
                path.write_text("\n".join(map(json.dumps, rows)))
            elif c.format == "json":
                path.write_text(json.dumps(rows))
            elif c.format == "parquet":
                spark.read.json(spark.createDataFrame([(json.dumps(r),) for r in rows], "v string").rdd.map(lambda r: r[0])).coalesce(1).write.parquet(str(path))
            else:
                with open(path, "w", newline="") as f:
                    out = csv.DictWriter(f, list(row), delimiter="\t" if c.format == "tsv" else ",")
                    out.writeheader()
                    out.writerows(rows)
    return str(root)


@pytest.mark.parametrize("name", list(CORPUS_ROWS))
def test_corpora(spark, corpus_root, name):
    import json

    kb = spark.createDataFrame([("new york", "ny"), ("Rome", "r")], "id string, text string") if name == "ex_fever" else None
    got = corpora.load(spark, name, corpora.CORPORA[name].path(corpus_root, "one"), kb).collect()
    row, evidence, label, orig = CORPUS_ROWS[name]
    assert [(r["src"], r["claim"], r["evidence"], r["label"], r["orig_label"]) for r in got] == [(name, "c", evidence, label, orig)]
    assert json.loads(got[0]["metadata"]).keys() >= {k for k, v in row.items() if v is not None}


def test_split_registry(spark, corpus_root):
    assert set(corpora.CORPORA) == set(CORPUS_ROWS) and len(corpora.CORPORA) == 22
    assert (len(corpora.TRAIN_SPLITS), len(corpora.TEST_SPLITS)) == (13, 18) and set(corpora.TRAIN_SPLITS) | set(corpora.TEST_SPLITS) == set(CORPUS_ROWS) - {"snopes", "uphill"}
    some = {k: v for k, v in corpora.TRAIN_SPLITS.items() if k in ("wice", "faviq_a_set", "ambifc")}
    got = corpora.load_splits(spark, corpus_root, some).collect()
    assert sorted((r["dataset"], r["split"]) for r in got) == sorted((k, s) for k, v in some.items() for s in v)
    assert len({r["id"] for r in got}) == len(got) == 5
    whole, n = corpora.collect([corpora.load(spark, "fever", corpora.CORPORA["fever"].path(corpus_root, "test"))] * 2)
    assert whole.count() == 2 and n.first()["n"] == 2


def test_raw_corpora(spark):
    claims = table(spark, [("c", "7"), ("d", ""), ("e", "9")], "claim string, evidence_doc_id string")
    docs = table(spark, [(7, "T", ["a", "b"])], "doc_id long, title string, abstract array<string>")
    assert [(r["claim"], r["evidence"]) for r in raw.abstracts(claims, docs).collect()] == [("c", "T\n\na b")]
    pages = table(spark, [("1", "first", 0), ("1", "second", 1)], "id string, text string, ord int")
    assert [r["text"] for r in raw.passages(table(spark, [("x", "1"), ("y", "2")], "claim string, id string"), pages).collect()] == ["first"]
    assert raw.tables(table(spark, [("<table><tr><th>a</th></tr></table>",)], "table string")).first()["table_md"] == "| a |\n| --- |"
    assert raw.labels(table(spark, [("a",), ("a",)], "label string")).count() == 1


def test_reward_registry(spark):
    whole = ["format", "necessity_saliency", "joint_quality", "diversity", "verification", "good_num_q", "coverage"]
    assert rewards.RewardConfig().names() == whole and rewards.RewardConfig.from_env({}) == rewards.RewardConfig()
    assert (rewards.RewardConfig().diversity, rewards.RewardConfig().aggregation, rewards.RewardConfig().backend) == ("mmr", "mean", "llm-judge")
    other = rewards.RewardConfig.from_env({"DIVERSITY_REWARD": "vendi", "NECESSITY_AGGREGATION": "min", "REWARD_BACKEND": "Tiny", "GOOD_NUM_Q_REWARD": "0"})
    assert (other.diversity, other.aggregation, other.backend, other.names()) == ("vendi", "min", "tiny-judge", [n for n in whole if n != "good_num_q"])
    with pytest.raises(ValueError):
        rewards.RewardConfig.from_env({"REWARD_BACKEND": "none"})
    own = rewards.RewardConfig.from_env({"SUPERVISION_RATE": "0", "DIVERSITY_REWARD_ENABLED": "0", "NECESSITY_SALIENCY_REWARD": "0", "JOINT_QUALITY_REWARD": "0", "GOOD_NUM_Q_REWARD": "1", "COVERAGE_REWARD": "0"})
    assert own.names() == ["format", "good_num_q"]
    with pytest.raises(ValueError):
        rewards.RewardConfig.from_env({"SUPERVISION_RATE": "2"})
    df = table(spark, [(1, 0), (1, 1)], "prompt_id long, gen_idx int")
    one = table(spark, [(1, 0, 0.5)], "prompt_id long, gen_idx int, score double")
    assert sorted(map(tuple, rewards.reward_table(df, own, {"format": one, "good_num_q": one}).collect())) == [(1, 0, 0.5, 0.5), (1, 1, 0.0, 0.0)]
    assert rewards.eval_steps(1000, 10, 3) == 10 and rewards.eval_steps(1, 10, 1) == 1


def test_diversity_rewards(spark):
    rows = [(1, 0, k, v) for k, v in enumerate(([1.0, 0.0], [-1.0, 0.0]))] + [(1, 1, k, v) for k, v in enumerate(([1.0, 0.0], [0.0, 1.0], [1.0, 0.0]))] + [(2, 0, 0, [1.0, 0.0])]
    df = table(spark, rows, "prompt_id long, gen_idx int, index int, v array<double>")
    score = lambda got: {(r["prompt_id"], r["gen_idx"]): round(r["score"], 9) for r in got.collect()}
    third = -(2 / 3 * np.log(2 / 3) + 1 / 3 * np.log(1 / 3))
    assert score(rewards.diversity_reward(df, rewards.RewardConfig(diversity="vendi"), "v")) == {(1, 0): 0.5, (1, 1): round(np.exp(third) / 3, 9), (2, 0): 0.0}  # opposite vectors are one
    assert score(rewards.diversity_reward(df, rewards.RewardConfig(), "v")) == {(1, 0): 0.5, (1, 1): round(-1 / 3, 9), (2, 0): -1.0}


def test_verification_is_gated_by_supervision(spark):
    rows = [(k, 0, f"claim {k}", "<verification>Supported</verification>", "supported" if k % 2 else "refuted") for k in range(60)] + [(60, 0, "c", "<verification>Refuted</verification>", None), (61, 0, "c", "none", "refuted")]
    df = table(spark, rows, "prompt_id long, gen_idx int, claim string, generation string, label string")
    asked = {r["prompt_id"] for r in df.where(filters.is_supervised(0.5)).collect()}
    got = {r["prompt_id"]: (r["score"], r["predicted"]) for r in rewards.verification_rewards(df, 0.5).collect()}
    assert 10 < len(asked & set(range(60))) < 50
    assert all(got[k] == ((float(k % 2), "Supported") if k in asked else (0.0, "unknown")) for k in range(60))
    got = {r["prompt_id"]: (r["score"], r["predicted"]) for r in rewards.verification_rewards(df, 1.0).collect()}
    assert got[60] == (0.0, "unknown") and got[61] == (0.0, "unknown") and got[1] == (1.0, "Supported")
    assert {r["score"] for r in rewards.verification_rewards(df, 0.0).collect()} == {0.0}


def test_task_datasets_and_pass_through(spark, tmp_path):
    split = table(spark, [(f"h{k}", k / 10) for k in range(10)], "text_hash string, label double")
    splits = dict.fromkeys(("train", "train_balanced", "validation", "test", "test_balanced"), split)
    got = judgelog.task_datasets(splits, "atomicity_checklist", "train_balanced", limit=3, eval_limit=5)
    assert sorted(r["label"] for r in got["train"].collect()) == [0, 0, 1] and got["validation"].count() == got["test_balanced"].count() == 5
    assert judgelog.task_datasets(splits, "coverage")["test"].count() == 10
    for name in ("train.jsonl", "test_a.jsonl", "test_b.jsonl", "other.txt"):
        (tmp_path / name).write_text(name)
    assert files.pass_through(spark, str(tmp_path), str(tmp_path / "out")) == ["test_a.jsonl", "test_b.jsonl"]
    assert (tmp_path / "out" / "test_a.jsonl").read_text() == "test_a.jsonl" and not (tmp_path / "out" / "train.jsonl").exists()


def test_comparison_of_selections(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(30, 4))
    pool = table(spark, [(k, f"s{k % 3}", ("Supported", "Refuted")[k % 2], v[k].tolist()) for k in range(30)], "ord long, src string, label string, embedding array<double>")
    chosen = pool.where("ord < 10").withColumn("method", F.lit("a")).unionByName(pool.where("ord >= 5 AND ord < 20").withColumn("method", F.lit("b")))
    got = {r["method"]: r for r in curation.comparison(chosen, pool).collect()}
    x = v / np.linalg.norm(v, axis=1, keepdims=True)
    for m, own in (("a", range(10)), ("b", range(5, 20))):
        own = list(own)
        far = [1 - x[i] @ x[j] for i in own for j in own if i < j]
        assert abs(got[m]["distance"] - np.mean(far)) < 1e-9 and got[m]["rows"] == len(own) and got[m]["common"] == 5
        assert abs(got[m]["pool_distance"] - np.mean(1 - (x @ x[own].T).max(axis=1))) < 1e-9
        assert abs(got[m]["vendi"] - selection.vendi_of((x[own] @ x[own].T + 1) / 2)) < 1e-9
    sample = similarity.sampled_distances(chosen, "ord", "embedding", ["method"], rows=8, pairs=20)
    assert {r["method"]: r["count"] for r in sample.groupBy("method").count().collect()} == {"a": 20, "b": 20}
    assert all(abs(r["distance"] - (1 - x[r["a"]] @ x[r["b"]])) < 1e-9 and r["a"] < r["b"] for r in sample.collect())


def test_leak_counts(spark):
    words = "one two three four five six seven eight nine ten".split()
    own = table(spark, [(0, " A b "), (1, " ".join(words)), (2, "near"), (3, "far")], "ord long, claim string")
    tests = table(spark, [(0, "a B"), (1, " ".join(words[:9])), (2, "close")], "ord long, claim string")
    at = {" A b ": [1.0, 0.0, 0.0], "a B": [0.0, 1.0, 0.0], " ".join(words): [0.0, 0.0, 1.0], " ".join(words[:9]): [0.0, 1.0, 0.0], "near": [1.0, 0.1, 0.0], "close": [1.0, 0.0, 0.0], "far": [0.0, 0.0, 1.0]}
    vec = table(spark, list(at.items()), "claim string, embedding array<double>")
    assert {r["prong"]: r["removed"] for r in curation.leak_counts(own, vec, tests).collect()} == {"exact": 1, "jaccard": 1, "semantic": 1}


def test_removal_counts_equal_the_summary(spark):
    df = table(spark, [(k, f"s{k % 3}", k % 4 if k % 5 else None) for k in range(40)], "ord long, src string, x int")
    a = aggregates.removal_summary(df, df.where("x < 2")).withColumn("pct_removed", F.col("pct_removed").cast("double"))
    b = aggregates.removal_counts(df, F.col("x") < 2).withColumn("pct_removed", F.col("pct_removed").cast("double"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))


def test_files(spark, tmp_path):
    df = spark.range(3)
    assert files.write_metrics(df, str(tmp_path / "m")) and not files.write_metrics(df, str(tmp_path / "m")) and files.write_metrics(df, str(tmp_path / "m"), force=True)
    assert files.read_cache(spark, str(tmp_path / "none"), "key string, value string").count() == 0
    assert files.write_stage(df, str(tmp_path / "p")).count() == 3
    (tmp_path / "logs" / "run1" / "cov").mkdir(parents=True)
    (tmp_path / "logs" / "run1" / "cov" / "a.json").write_text('{"judge_model_id": "j"}')
    got = judgelog.read_logs(files.read_log_files(spark, str(tmp_path / "logs"))).first()
    assert (got["source_run"], got["judge_model_id"], got["corrupt"]) == ("run1", "j", False)


def test_rule_filters(spark):
    rows = [(0, "s", "a b", "w " * 20), (1, "s", "a b c d", "w " * 20), (2, "scitab", "a b c d", "w " * 20), (3, "s", "a", ""), (4, "s", "", "One. Two! Three?")]
    df = table(spark, rows, "ord long, src string, claim string, evidence string")
    assert sorted(r["ord"] for r in df.where(filters.ratio_within()).collect()) == [0, 2, 4]
    assert sorted(r["ord"] for r in df.where(filters.enough_sentences()).collect()) == [2, 4]
    got = aggregates.removal_summary(df, df.where("ord < 2")).collect()
    assert {r["src"]: (r["before"], r["removed"], r["after"]) for r in got} == {"s": (4, 2, 2), "scitab": (1, 1, 0), "TOTAL": (5, 3, 2)}


def test_curation_steps(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(400)}"
    rows = [(k, str(k), f"s{k % 2}", " ".join(word() for _ in range(8)), "".join(" ".join(word() for _ in range(30)) + ". " for _ in range(9)), ("Supported", "Refuted")[k % 3 == 0]) for k in range(60)]
    df = table(spark, rows, "ord long, id string, src string, claim string, evidence string, label string")
    own = curation.rules(df)
    assert own.count() == 60 and "prompt_token_length" in own.columns
    vec = df.select("claim", F.array(*[F.rand(k) for k in range(8)]).alias("embedding")).persist()
    got = curation.selected(df, vec, "farthest", curation.Config(budget=20))
    assert {r["label"]: r["count"] for r in got.groupBy("label").count().collect()} == {"Supported": 10, "Refuted": 10}
    near = curation.semantic(df, vec, df.where("ord < 3"), curation.Config(semantic=1.1, leak=1.1))
    assert sorted(r["ord"] for r in near.collect()) == list(range(3, 60))
    lists = df.where("ord % 2 = 0").select("claim", F.array(F.lit("a"), F.lit("b")).alias("decomposed_questions"))
    n = df.select("claim", F.lit(2).alias("num_of_questions"))
    assert curation.decomposed(df, n, lists).count() == 30
    assert curation.augmented(df.where("ord < 10"), df, curation.Config(long_tokens=10)).count() == 60
    assert curation.report([("a", df), ("b", own)]).where("src = 'TOTAL'").first()["before"] == 60


def test_qacheck_stops_early(spark):
    claims = table(spark, [(1, "c1", "e"), (2, "c2", "e")], "id long, claim string, evidence string")

    def reply(prompt):
        asked = F.contains(prompt, F.lit("Q1:"))
        return F.when(F.contains(prompt, F.lit("<enough>")), F.when(F.contains(prompt, F.lit("c1")) & asked, "yes").otherwise("no")).when(F.contains(prompt, F.lit("<question>")), "Why?").when(F.contains(prompt, F.lit("<answer>")), "So.").otherwise("<verdict>Refuted</verdict>")

    got = {r["id"]: r for r in qacheck.run(claims, reply, 3).collect()}
    assert (got[1]["num_turns"], got[1]["exited_early"], got[2]["num_turns"], got[2]["exited_early"]) == (1, True, 3, False)
    assert got[1]["pred_label"] == "refuted" and [tuple(x) for x in got[1]["qa_history"]] == [("Why?", "So.")]


def test_curation_steps_read_their_rows_twice(spark):
    """Once to write what the steps compare, once for the rows that are left, however many steps there are."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    rows = [(k, "s", f"claim a{k} b{k} c{k} d{k}", "One two. " * 150, ("Supported", "Refuted")[k % 2]) for k in range(60)]
    df = table(spark, rows, "ord long, src string, claim string, evidence string, label string")
    vec = df.select("claim", F.array(*[(F.xxhash64("claim", F.lit(k)) % 1000).cast("double") for k in range(16)]).alias("embedding")).persist()
    counting = df.mapInPandas(counted, df.schema)
    assert {r["ord"] for r in curation.rules(counting).collect()} == set(range(60)) and seen.value <= 2 * 60
    seen.value = 0
    curation.semantic(counting, vec, df.where("ord < 3")).collect()
    assert seen.value <= 2 * 60
    seen.value = 0
    assert curation.selected(counting, vec, "farthest", curation.Config(budget=10)).count() == 10 and seen.value <= 3 * 60


def test_stages_by_command(spark, tmp_path, corpus_root):
    from factweave.__main__ import STAGES, main

    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(400)}"
    rows = [(k, str(k), f"s{k % 2}", " ".join(word() for _ in range(8)), "".join(" ".join(word() for _ in range(30)) + ". " for _ in range(9)), ("Supported", "Refuted")[k % 3 == 0]) for k in range(30)]
    path = lambda n: str(tmp_path / n)
    table(spark, rows, "ord long, id string, src string, claim string, evidence string, label string").write.parquet(path("in"))
    run = lambda stage, out, *more, given="in": (main([stage, "--input", path(given), "--output", path(out), *more], spark), spark.read.parquet(path(out)))[1]
    assert run("rules", "rules").count() == 30
    assert run("select", "chosen", "--budget", "10", given="rules").count() == 10
    assert run("augment", "more", "--pool", path("rules"), given="chosen").count() == 10
    assert run("report", "report", "--before", path("rules"), given="chosen").where("src = 'TOTAL'").first()["removed"] == 20
    assert "the claim" in run("baseline", "prompts", "--baseline", "hiss", given="chosen").first()["prompt"]
    spark.read.parquet(path("chosen")).select(F.col("label").alias("gt_label"), F.lit("Supported").alias("pred_label")).write.parquet(path("pred"))
    main(["metrics", "--input", path("pred"), "--output", path("metrics")], spark)
    main(["metrics", "--input", path("pred"), "--output", path("metrics")], spark)
    assert spark.read.json(path("metrics")).first()["total_samples"] == 10
    with pytest.raises(SystemExit):
        main(["entities", "--input", path("in"), "--output", path("none")], spark)
    assert {"rules", "select", "compare", "ingest"} <= set(STAGES) and len(STAGES) == 15


def test_jaccard_chain_keeps_what_the_pass_keeps(spark):
    """B is like A and like C, A and C are not alike: the pass keeps A and C."""
    words = [f"w{k}" for k in range(12)]
    df = table(spark, [(1, " ".join(words[:10])), (2, " ".join(words[1:11])), (3, " ".join(words[2:12]))], "ord long, claim string")
    assert sorted(r["ord"] for r in dedup.jaccard_dedup(df).collect()) == [1, 3]


def test_few_sets_meet(spark, monkeypatch):
    """Texts that share words but are not alike are ruled out before their sets travel, and slices lose no pair."""
    rng = random.Random(21)
    words = [f"w{k}" for k in range(300)]
    texts = [rng.sample(words, 60) for _ in range(120)]
    texts += [t[:55] + rng.sample(words, 5) for t in texts[:20]]
    sets = [frozenset(t) for t in texts]
    jac = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7
    seen = []
    real = dedup.verified
    monkeypatch.setattr(dedup, "verified", lambda cand, *a: (seen.append(cand.count()), real(cand, *a))[1])
    got = dedup.jaccard_dedup(table(spark, [(k, " ".join(t)) for k, t in enumerate(texts)], "ord long, claim string"))
    assert sorted(r["ord"] for r in got.collect()) == plain_greedy(range(len(texts)), jac)
    assert 0 < sum(seen) < 100
    rows = dedup.listed(dedup.word_sets(table(spark, [(k, " ".join(t)) for k, t in enumerate(texts)], "ord long, claim string"), "ord", "claim"), np.full(64, 9, np.int32), 0.7)
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if jac(a, b)}
    assert want and want <= {(r["a"], r["b"]) for r in dedup.near_in_slices(rows, 0.7, 3).collect()}


@pytest.mark.parametrize("counters", [1 << 20, 64, 1])
def test_jaccard_pairs_lose_none(spark, counters, monkeypatch):
    """Recall 1 whatever the sketch, at the very threshold too; words of all degrees of rarity."""
    monkeypatch.setattr(dedup, "COUNTERS", counters)
    monkeypatch.setattr(dedup.rarity, "__defaults__", (counters,))
    rng = random.Random(6)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 400}"
    base = [[word() for _ in range(rng.randint(1, 25))] for _ in range(40)]
    rows = []
    for k in range(260):
        own = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = word()
        rows.append((k, " ".join(own)))
    rows += [(260, "a b c d e f g h i j"), (261, "a b c d e f g"), (262, ""), (263, "x")]
    sets = {k: set(t.split()) for k, t in rows}
    for threshold in (0.5, 0.7, 0.9, 1.0):
        want = {(a, b) for a, x in sets.items() for b, y in sets.items() if x and y and len(x & y) / len(x | y) >= threshold}
        df = table(spark, rows, "ord long, claim string")
        got = dedup.jaccard_pairs(df, df, "ord", "claim", threshold)
        assert {(r["a"], r["b"]) for r in got.collect()} == want


@pytest.mark.parametrize("shape", ["clusters", "noise"])
def test_pruned_similarity_equals_all_pairs(spark, shape, monkeypatch):
    monkeypatch.setattr(similarity, "TILE", 32)
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(12, 16)) * 3
    x = middle[rng.integers(0, 12, 420)] + 0.4 * rng.normal(size=(420, 16)) if shape == "clusters" else rng.normal(size=(300, 6))
    x[5] = 0
    x[40:80] = x[39]  # one vector many times
    u = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) == 0, 1, np.linalg.norm(x, axis=1, keepdims=True))
    sim = u @ u.T
    df = table(spark, [(k, v.tolist()) for k, v in enumerate(x)], "ord long, embedding array<double>")
    rows = df.select(F.col("ord").alias("key"), F.col("embedding").alias("v"))
    for threshold in (0.5, 0.9):
        got = [(r["a"], r["b"]) for r in similarity.similar_pairs(df, "ord", "embedding", threshold).collect()]
        want = {(i, j) for i, j in zip(*np.nonzero(sim >= threshold), strict=True) if i < j}
        assert len(got) == len(set(got)) and set(got) == want
        kept = sorted(r["ord"] for r in similarity.semantic_dedup(df, "ord", "embedding", threshold).collect())
        assert kept == plain_greedy(range(len(x)), lambda a, b: sim[a, b] >= threshold)
        left, right = df.where("ord % 3 = 0"), df.where("ord % 3 > 0")
        clean = {r["ord"] for r in similarity.semantic_decontaminate(left, right, "ord", "embedding", "ord", "embedding", threshold).collect()}
        assert clean == {k for k in range(0, len(x), 3) if not any(sim[k, j] >= threshold for j in range(len(x)) if j % 3)}
        met, whole = similarity.Cells([rows]).meetings(threshold)
        assert met < 0.5 * whole if shape == "clusters" and threshold == 0.9 else met <= whole
    best = {r["ord"]: r["best"] for r in similarity.best_similarity(left, right, "ord", "embedding", "ord", "embedding").collect()}
    assert all(abs(best[k] - max(sim[k, j] for j in range(len(x)) if j % 3)) < 1e-9 for k in best) and len(best) == len(range(0, len(x), 3))


def test_run_folders_are_removed(spark):
    from factweave.plans import checkpoint

    folder = checkpoint.run_folder(spark)
    spark.range(3).write.parquet(f"{folder}/t")
    assert spark.read.parquet(f"{folder}/t").count() == 3
    checkpoint.remove(spark, folder)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{folder}/t")


def test_best_by_group_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(similarity, "TILE", 40)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = table(spark, [(k, v.tolist()) for k, v in enumerate(x)], "ord long, v array<double>")
    refs = df.where("ord < 6").withColumn("m", F.explode(F.when(F.col("ord") < 3, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b")))))
    got = {(r["ord"], r["m"]): r["best"] for r in similarity.best_by_group(df, refs, "ord", "v", "ord", "v", "m").collect()}
    assert len(got) == 600
    assert all(abs(best - (u[k] @ u[: 3 if m == "a" else 6].T).max()) < 1e-9 for (k, m), best in got.items())


@pytest.mark.parametrize("block", [1, 16])
def test_semantic_dedup_thins_by_the_first_kept(spark, block, monkeypatch):
    counted = []
    monkeypatch.setattr(similarity, "earlier_links", lambda d, *a, real=similarity.earlier_links: (counted.append(d), real(d, *a))[1])
    rng = np.random.default_rng(6)
    x = rng.normal(size=(260, 5))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = u @ u.T
    df = table(spark, [(k, v.tolist()) for k, v in enumerate(x)] + [(999, None)], "k long, v array<double>").repartition(3)
    kept = sorted(r["k"] for r in similarity.semantic_dedup(df, "k", "v", 0.3, block=block).collect())
    assert kept == [*plain_greedy(range(260), lambda a, b: sim[a, b] >= 0.3), 999]
    assert counted[0].count() < 130  # links are counted among few rows only


def test_distance_bins_hold_all_pairs(spark, monkeypatch, tmp_path):
    from factweave.operators import density
    from factweave.plans import queries

    monkeypatch.setattr(density, "TILE", 300)
    rng = np.random.default_rng(2)
    x, label = rng.normal(size=(700, 6)), np.arange(700) % 20 // 19  # 665 rows: 220,780 pairs
    table(spark, [(k, [float(c) for c in v], int(g)) for k, (v, g) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r["label"], r["bin"]): r["n"] for r in queries.distance_bins(spark, str(tmp_path)).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for g in (0, 1):
        own = u[label == g]
        d = np.round(1 - (own @ own.T)[np.triu_indices(len(own), 1)], 9)
        width = d.std(ddof=1) * len(d) ** -0.2 / 64
        for k, n in zip(*np.unique(np.floor((d - d.min()) / width).astype(int), return_counts=True), strict=True):
            want[g, int(k)] = int(n)
    assert sum(got.values()) == sum(want.values()) and got == want


def test_corpus_records_write_claims_once(spark, monkeypatch):
    from factweave.operators import records
    from factweave.plans import corpus_rows

    written = []
    monkeypatch.setattr(records, "cut", lambda d, real=records.cut: (written.append(d), real(d))[1])
    claims = table(spark, [(k, f"claim {k}", f"evidence {k}", "web", "en") for k in range(6)], "ord long, claim string, evidence string, src string, lang string")
    got = corpus_rows.records(claims)
    assert {r["src"] for r in got.select("src").distinct().collect()} == set(corpus_rows.FIELDS) and not written


def test_facility_location_tries_few_candidates(spark, monkeypatch):
    monkeypatch.setattr(selection, "CANDIDATES", 8)
    sizes = []
    monkeypatch.setattr(selection, "packed", lambda d, *a, real=selection.packed: (sizes.append(d.count()), real(d, *a))[1])
    m = np.random.default_rng(1).normal(size=(120, 4))
    df = table(spark, [(k, v.tolist(), 0) for k, v in enumerate(m)], "k long, v array<double>, g int")
    got = sorted(r["k"] for r in selection.select(df, "facility", ["g"], "k", "v", 4, 15).collect())
    assert got == sorted(selection.facility_location(m, 4))
    assert sizes[0] == 120 and len(sizes) > 1 and max(sizes[1:]) <= 8  # equal gains never make the candidates grow
