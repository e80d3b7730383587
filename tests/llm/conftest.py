import random

import pytest

from factweave.llm.queries import CONTROL

SCHEMA = "doc_id long, text string, id string, fp string, blob int, spans int, score string, rep int, shard string, label int"


@pytest.fixture(scope="session")
def messy(spark):
    """Rows with null and empty texts, a null id, repeated rows, a very long text and columns that clash with inner names."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(("th", "en", "or", "ü", "é", "lo", "sh")) for _ in range(rng.randint(1, 4)))
    texts = [None, "", " \n\t", "word", "two words", CONTROL, "a<|endoftext|>b", "x" * 5000, "日本語 テキスト, もう一つ。"]
    texts += [" ".join(word() for _ in range(rng.randint(3, 200))) for _ in range(60)]
    texts += [" ".join(word() for _ in range(30_000)), texts[20], texts[20], texts[21] + " more"]
    rows = [(k, t, "x", "y", 1, 2, "z", 3, "s", 0) for k, t in enumerate(texts)]
    rows += [rows[12], rows[12], (None, texts[30], *rows[0][2:]), (None, None, *rows[0][2:])]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(messy):
    return messy.where("1 = 0")
