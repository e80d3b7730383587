"""Token operators against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from factweave.llm import bpe, split, token_count

PATH = public_tokenizers.path(bpe.VOCABULARY)
ALPHABET = "abc'strevmldSTRE 019 \n\t\r\x0b\x1c\x85\xa0éß日\U0001f600.,!<|>²ⅷ　"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(5)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    return [*made, "", "aaaaaaa", "a" * 3000, " " * 300 + "x", "-" * 200, "don't''s'S 'RE 'll've", "<|endoftext|><|endoftext|>x", "x<|endoftext|>"]


def test_encode_and_decode_equal_the_library(library):
    own, all_texts = bpe.load(PATH), texts()
    flat, count = own.encode_batch(all_texts)
    end = np.cumsum(count)
    for t, n, e, want in zip(all_texts, count, end, library.encode_batch(all_texts, add_special_tokens=False), strict=True):
        ids = flat[e - n : e]
        assert ids.tolist() == want.ids, t
        assert bpe.decimal(ids).decode() == ",".join(map(str, want.ids))
        assert own.decode(ids) == library.decode(want.ids, skip_special_tokens=False) == t


def test_counts_equal_the_library(library):
    machine, all_texts = token_count.load(PATH), texts()
    assert machine.count_batch(all_texts).tolist() == [len(e.ids) for e in library.encode_batch(all_texts, add_special_tokens=False)]


def test_counts_stay_when_the_tables_are_compiled_anew(library, monkeypatch):
    monkeypatch.setattr(token_count, "MAX_STATES", 50)
    machine, some = token_count.CountingTransducer(bpe.load(PATH)), texts()[:400]
    want = [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]
    assert sum((machine.count_batch(some[k : k + 100]).tolist() for k in range(0, 400, 100)), []) == want


def test_chunk_maps_give_what_one_long_run_gives(monkeypatch):
    kinds = split.classes()[np.array([ord(c) for c in "".join(texts()[:200])], np.uint32)]
    want = split.word_starts(kinds)
    for size in (1, 3, 7, 4096):
        monkeypatch.setattr(split, "CHUNK", size)
        assert (split.word_starts(kinds) == want).all()


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(split, "_salts", lambda: np.zeros(256, np.uint64))
    words = split.Words(["ab cd ab efg cd"])
    first, kind = words.unique()
    of = [bytes(words.data[words.start[first[k]] : words.end[first[k]]]) for k in kind]
    assert of == [b"ab", b" cd", b" ab", b" efg", b" cd"]


def rows_of(messy):
    return [(r["doc_id"], r["text"] or "") for r in messy.collect()]


def test_encode_over_messy_rows(messy, empty, library):
    got = sorted((r["id"] is None, r["id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode(messy).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows_of(messy):
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i is None, i or 0, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)
    assert bpe.encode(empty).count() == 0


def test_counts_over_messy_rows(messy, empty, library):
    got = sorted((r["id"] is None, r["id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_count.count_tokens(messy).collect())
    want = [(i is None, i or 0, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 512) for i, t in rows_of(messy)]
    assert got == sorted(want)
    assert token_count.count_tokens(empty).count() == 0
