import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factweave.llm import repeats, suffix
from factweave.llm.common import table


@given(st.lists(st.integers(0, 3), max_size=60))
@settings(max_examples=300, deadline=None)
def test_suffix_array_by_sorting(t):
    assert suffix.suffix_array(np.array(t, np.int64)).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


@pytest.mark.parametrize("t", [[0] * 500, [1, 0] * 400, list(range(300)), list(range(300))[::-1], [0, 1, 2] * 200 + [1]])
def test_suffix_array_of_periods(t):
    assert suffix.suffix_array(np.array(t)).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=8), st.integers(1, 8))
@settings(max_examples=300, deadline=None)
def test_repeated_windows_of_segments(parts, size):
    data = np.frombuffer(b"".join(p + b"\xff" for p in parts), np.uint8)
    begins = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
    count = Counter(p[i : i + size] for p in parts for i in range(len(p) - size + 1))
    want = [i + size <= len(p) and count[p[i : i + size]] > 1 for p in parts for i in range(len(p) + 1)]
    assert suffix.repeated(data, begins, size).tolist() == want


def test_common_prefixes_are_exact_within_segments():
    rng = random.Random(1)
    parts = [bytes(rng.choice(b"ab") for _ in range(60)) + b"\xff" for _ in range(20)]
    data, begins = np.frombuffer(b"".join(parts), np.uint8), np.arange(20) * 61
    order = suffix.suffix_array(data)
    got = suffix.common_prefixes(data, order, begins, 61)
    text = data.tobytes()
    for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
        n = next((k for k in range(len(text)) if text[a + k : a + k + 1] != text[b + k : b + k + 1] or a + k >= len(text) or b + k >= len(text)), 0)
        left = 61 - b % 61
        assert got[b] == n or min(n, got[b]) >= left


def brute(texts, size):
    raw = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + size] for t in raw for i in range(len(t) - size + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - size + 1):
            if count[t[i : i + size]] > 1:
                gone[i : i + size] = 1
        step = np.diff(np.r_[0, gone])
        spans = list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))
        kept = bytes(np.frombuffer(t, np.uint8)[gone[:-1] == 0])
        out.append((len(t), tuple(spans), hashlib.sha256(kept).hexdigest(), kept))
    return out


def run(df, **options):
    got = repeats.remove(df, keep=True, **options)
    return Counter((r["id"], r["n_bytes"], tuple(map(tuple, r["spans"])), r["kept_sha256"], bytes(r["kept"])) for r in got.collect())


def wanted(df, size):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    return Counter((i, *b) for (i, _), b in zip(rows, brute([t for _, t in rows], size), strict=True))


@pytest.fixture(scope="module")
def shared(spark):
    """Texts of few words that share passages, near copies of one, exact copies, runs of one letter and periods."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passage = [" ".join(word() for _ in range(30)) for _ in range(4)]
    texts = [" ".join([word() for _ in range(rng.randint(0, 40))] + [rng.choice(passage)] + [word() for _ in range(rng.randint(0, 40))]) for _ in range(60)]
    base = " ".join(word() for _ in range(120)).split(" ")
    for _ in range(80):
        own = list(base)
        for _ in range(3):
            own[rng.randrange(len(own))] = word()
        texts.append(" ".join(own))
    texts += [texts[3]] * 5 + ["x" * 900, "y" + "x" * 150, "abc" * 200, "abcd" * 300 + "z" + "abcd" * 100, "", None, passage[0], passage[0][:-1], "q" * 39, "日本語テキスト" * 40]
    return spark.createDataFrame([(k if k % 50 else None, t, "s", "h", 1) for k, t in enumerate(texts)], "doc_id long, text string, key string, h string, spans int").repartition(3)


@pytest.mark.parametrize("options", [{}, {"group": 4000, "finer": (16, 1)}, {"group": 4000, "finer": (4, 1)}, {"group": 0, "finer": (1,)}])
def test_as_by_hand(shared, options):
    assert run(shared, size=40, anchor=12, **options) == wanted(shared, 40)


def test_messy_rows_and_empty_table(messy, empty):
    assert run(messy) == wanted(messy, repeats.SIZE)
    assert repeats.remove(empty).count() == 0


def test_long_texts_over_slices(spark, monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    docs = spark.createDataFrame([(1, text), (2, "u" + text[11_000:11_900] + "v"), (3, text[29_500:] + text[:700])], "doc_id long, text string")
    data = np.frombuffer((text * 2).encode(), np.uint8)
    whole = repeats.segments(data, np.array([len(text), 2 * len(text)]), 200, 96)
    monkeypatch.setattr(repeats, "SLICE", 5_000)
    cut = repeats.segments(data, np.array([len(text), 2 * len(text)]), 200, 96)
    assert set(whole["key"].tolist()) == set(cut["key"].tolist()) and len(cut["key"]) >= len(whole["key"])
    windows = lambda s: sorted(x for b, n in zip(s["begin"].tolist(), s["bytes"].tolist(), strict=True) for x in range(b, b + n - 199))
    assert windows(whole) == windows(cut) == [*range(30_000 - 199), *range(30_000, 60_000 - 199)]
    assert run(docs) == wanted(docs, 200)


def test_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = Counter((r["id"], r["n_bytes"], tuple(map(tuple, r["spans"])), r["kept_sha256"]) for r in repeats.remove(docs).collect())
    assert got == Counter(x[:4] for x in wanted(docs, 200).elements())
