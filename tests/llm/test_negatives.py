import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, id string, place string, code string"


def brute(rows, modulus, positives=5, count=10):
    """Contract by loops; ``rows`` holds (id, vector, label)."""
    good = [(i, [math.floor(256 * x) for x in v], k) for i, v, k in rows if i is not None and k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for me, (i, v, k) in enumerate(good):
        if i % modulus:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, m == k) for at, (j, w, m) in enumerate(good) if at != me)
        for s, j, _ in [x for x in scored if x[2]][:positives]:
            found = [(-t, n) for t, n, same in scored if not same and 30 * -s <= 100 * -t <= 90 * -s][:count]
            out += [(i, j, r + 1, n, -s, t) for r, (t, n) in enumerate(found)]
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)


def run(df, modulus, **options):
    got = negatives.mine(df, F.col("vec_id") % modulus == 0, **options)
    return Counter(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    out = []
    for k in range(400):
        v = [x + rng.gauss(0, 0.7) for x in rng.choice(base)]
        out.append((k, [round(x * 4) / 4 for x in v] if k % 2 else v, rng.randrange(4)))  # coarse vectors give ties
    out += [(1000 + k, out[7][1], k % 3) for k in range(120)]  # a group of copies
    out += [(2000, None, 1), (2001, [1.0] * 8, None), (2002, [None] + [1.0] * 7, 1), (2003, [math.nan] * 8, 1), (2004, [math.inf] * 8, 2), (None, [1.0] * 8, 1)]
    out += [(2010, [0.0] * 8, 1), (-10, [0.5] * 8, 2), (2020, [1.0] * 3, 1), (2030, [], 1), out[20], out[20], (40, out[41][1], 3)]
    return out


@pytest.mark.parametrize("elements", [4_000_000, 900])
def test_as_by_hand(spark, rows, elements):
    assert run(table(spark, rows), 10, elements=elements) == Counter(brute(rows, 10))


def test_few_rows_and_empty_table(spark):
    rows = [(0, [1.0, 1.0], 1), (1, [1.0, 0.9], 1), (2, [0.5, 0.5], 2), (3, [-1.0, 0.0], 2), (10, [3.0, -1.0], 7)]
    assert run(table(spark, rows), 10) == Counter(brute(rows, 10))
    assert not run(table(spark, rows).where("1 = 0"), 10)


def test_limits_and_large_numbers(spark):
    p = np.array([-11, -10, -1, 0, 1, 3, 10, 99, 10**18 + 7])
    low, high = negatives.limits(p)
    assert low.tolist() == [-(-3 * x // 10) for x in p.tolist()] and high.tolist() == [9 * x // 10 for x in p.tolist()]
    rows = [(0, [3e5, 1.0], 1), (1, [3e5, 2.0], 1), (2, [1e5, 0.5], 2), (3, [1.2e5, 7.0], 3)]
    assert run(table(spark, rows), 10) == Counter(brute(rows, 10))
    with pytest.raises(Exception, match="OverflowError|too large|too big"):
        run(table(spark, [(0, [1e300], 1), (1, [1e300], 1), (2, [1e300], 2)]), 10)


def test_sort_without_room_for_packed_keys():
    s = np.array([[1 << 61, 5, 5, -(1 << 61)], [0, 7, 7, 7]])
    order, falling = negatives.ranked(s)
    assert order.tolist() == [[0, 1, 2, 3], [1, 2, 3, 0]] and falling.tolist() == [[1 << 61, 5, 5, -(1 << 61)], [7, 7, 7, 0]]
