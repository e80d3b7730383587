import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factweave.llm import align
from factweave.llm.bpe import byte_alphabet


@pytest.fixture(scope="module")
def libraries():
    one = Tokenizer.from_file(public_tokenizers.path(align.FIRST))
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(align.SECOND))


def tokens(libraries, text):
    """Ids and bytes of both sides, or nothing where they are not the space and the text."""
    one, two = libraries
    alphabet, want = byte_alphabet(), f" {text}".encode()
    a = one.encode(f" {text}", add_special_tokens=False)
    a = [(i, bytes(alphabet[c] for c in t)) for i, t in zip(a.ids, a.tokens, strict=True)]
    b = [(i, two.id_to_piece(i)) for i in two.encode(text)]
    b = [(i, bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()) for i, p in b]
    return (a, b) if text and all(b"".join(t for _, t in x) == want for x in (a, b)) else ([], [])


def brute(libraries, text):
    a, b = tokens(libraries, text)
    spans = []
    for side in (a, b):
        at, own = 0, []
        for i, t in side:
            own.append((i, at, at + len(t)))
            at += len(t)
        spans.append(own)
    links = [(i, j) for i, s, e in spans[0] for j, u, v in spans[1] if s < v and u < e]
    cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
    groups, low = [], 0
    for cut in cuts:
        groups.append("|".join(",".join(str(i) for i, _, e in side if low < e <= cut) for side in spans))
        low = cut
    return len(a), len(b), len(groups), links, ";".join(groups)


TEXTS = ["", "word", " two  spaces ", "a<|endoftext|>b <s> </s> <unk>", "▁", "a▁b", "naïve 日本語 テキスト 🙂 end", "\n\ttabs\r\n", "x" * 300, "don't 123456 l'été", "\u0000 zero", "   ", "é" * 40 + " " * 9 + "é", "​﻿ odd　space"]


def test_texts_as_by_hand(libraries):
    got = align.align(TEXTS)
    at = 0
    for k, text in enumerate(TEXTS):
        n_a, n_b, n_groups, links, groups = brute(libraries, text)
        n = int(got["n_links"][k])
        assert (got["n_a"][k], got["n_b"][k], got["n_groups"][k], n, got["groups"][k].decode()) == (n_a, n_b, n_groups, len(links), groups), text
        assert sorted(zip(got["a"][at : at + n].tolist(), got["b"][at : at + n].tolist(), strict=True)) == sorted(links), text
        at += n
    assert not got["n_a"][4] and not got["n_a"][5] and got["n_a"][3]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab '\n\t1é日▁🙂<|>s/."), max_size=30), max_size=6))
def test_random_texts(libraries, texts):
    got = align.align(texts)
    links = []
    for k, text in enumerate(texts):
        n_a, n_b, n_groups, own, groups = brute(libraries, text)
        assert (got["n_a"][k], got["n_b"][k], got["n_groups"][k], got["n_links"][k], got["groups"][k].decode()) == (n_a, n_b, n_groups, len(own), groups)
        links += own
    assert Counter(zip(got["a"].tolist(), got["b"].tolist(), strict=True)) == Counter(links)


def test_rank_and_places():
    bits = align.Bits.of([0, 63, 64, 200], 200)
    assert bits.places().tolist() == [0, 63, 64, 200]
    import numpy as np

    assert bits.rank(np.array([0, 1, 63, 64, 65, 200, 201])).tolist() == [0, 1, 1, 2, 3, 3, 4]


def test_counts_over_all_rows(spark, libraries, messy, empty, monkeypatch):
    rows, pairs = align.alignments(messy)
    texts = [(r["doc_id"], r["text"] or "") for r in messy.collect()]
    of = [(i, brute(libraries, t)) for i, t in texts if len(t) < 50_000] + [(i, None) for i, t in texts if len(t) >= 50_000]
    long = next(t for _, t in texts if len(t) >= 50_000)
    got = align.align([long])
    long = int(got["n_a"][0]), int(got["n_b"][0]), int(got["n_groups"][0]), list(zip(got["a"].tolist(), got["b"].tolist(), strict=True)), got["groups"][0].decode()
    of = [(i, b or long) for i, b in of]
    count, top = Counter(), defaultdict(int)
    for _, b in of:
        count.update(b[3])
    for (_, j), n in count.items():
        top[j] = max(top[j], n)
    want = [(i, *b[:3], len(b[3]), sum(count[x] == top[x[1]] for x in b[3]), sum(count[x] for x in b[3]), hashlib.sha256(b[4].encode()).hexdigest() if b[4] else "") for i, b in of]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in rows.collect())
    assert {(r["a"], r["b"]): (r["n"], r["best"]) for r in pairs.collect()} == {x: (n, n == top[x[1]]) for x, n in count.items()}
    assert all(df.count() == 0 for df in align.alignments(empty))
