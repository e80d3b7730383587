"""Byte-level BPE in batched numpy merge rounds.

The words of a batch are made unique, their symbols are laid out in one flat
array, and each round merges, in every word at once, all occurrences of the
word's pair of lowest rank. The rank of a pair is found by binary search over
the sorted pair keys of the merge table. This gives what merging one pair at a
time gives: a pair that holds a merged symbol ranks behind the merge that makes
that symbol, so no occurrence of the lowest pair is overtaken; overlapping
occurrences (``a a a``) are taken from the left.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import spread, text_chunks
from factweave.llm.split import Words, units_of

VOCABULARY = "byte_bpe_50k.json"
NONE = np.int32(1 << 30)
#: Characters of text that are worked on at once.
CHARS = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte: itself if visible in Latin-1, else the next one from U+0100."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """Vocabulary, merge table and special tokens of a byte-level BPE file for the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = dict.fromkeys(range(max([*vocab.values(), *self.special.values()]) + 1), b"")
        self.bytes_of |= {i: t for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.byte_id = np.array([vocab[bytes([b])] for b in range(256)], np.int32)
        self.merges = [(vocab[raw(a)], vocab[raw(b)], vocab[raw(a) + raw(b)]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])]
        key = np.array([(a << 32) | b for a, b, _ in self.merges], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.rank = key[order], order.astype(np.int32)
        self.merged = np.array([c for _, _, c in self.merges], np.int32)
        self.split_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        pieces = [self.bytes_of[i] for i in range(len(self.bytes_of))]
        self.size_of = np.array([len(p) for p in pieces], np.int64)
        self.at_of = np.cumsum(self.size_of) - self.size_of
        self.all_bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, by binary search; NONE if it never merges."""
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat token ids of ``words`` and the number of tokens of each."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat, owner = self.byte_id[np.frombuffer(b"".join(words), np.uint8)], np.repeat(np.arange(len(words)), size)
        done_id, done_owner = [], []
        rank = self._pair_ranks(flat, owner)
        while len(flat):
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            low = np.minimum.reduceat(rank, begin)
            count = np.diff(np.r_[begin, len(flat)])
            over = np.repeat(low == NONE, count)
            if over.any():
                done_id.append(flat[over])
                done_owner.append(owner[over])
                live = ~over
                flat, owner, rank, low, count = flat[live], owner[live], rank[live], low[low != NONE], count[low != NONE]
                if not len(flat):
                    break
            take = rank == np.repeat(low, count)
            # Of occurrences that overlap, every second one from the left is taken.
            at = np.flatnonzero(take)
            if len(at) > 1 and (np.diff(at) == 1).any():
                run = np.r_[True, np.diff(at) != 1]
                place = np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]
                at = at[place % 2 == 0]
            flat[at] = self.merged[rank[at]]
            keep = np.ones(len(flat), bool)
            keep[at + 1] = False
            stale = np.zeros(len(flat), bool)
            stale[at] = True
            stale[at[at > 0] - 1] = True
            flat, owner, rank, stale = flat[keep], owner[keep], rank[keep], np.flatnonzero(stale[keep])
            after = np.minimum(stale + 1, len(flat) - 1)
            ok = (stale + 1 < len(flat)) & (owner[after] == owner[stale])
            rank[stale] = np.where(ok, self.ranks(flat[stale], flat[after]), NONE)
        tokens = np.concatenate(done_id) if done_id else np.empty(0, np.int32)
        owner = np.concatenate(done_owner) if done_owner else np.empty(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return tokens[order], np.bincount(owner, minlength=len(words))

    def _pair_ranks(self, flat: np.ndarray, owner: np.ndarray) -> np.ndarray:
        out = np.full(len(flat), NONE, np.int32)
        if len(flat) > 1:
            same = np.flatnonzero(owner[1:] == owner[:-1])
            out[same] = self.ranks(flat[same], flat[same + 1])
        return out

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat token ids of ``texts`` and the number of tokens of each."""
        units, owner, after = units_of(texts, self.special, self.split_special)
        words = Words(units)
        first, kind = words.unique()
        data = words.data.tobytes()
        order = np.argsort((words.end - words.start)[first], kind="stable")
        # Words of like length go together, so a long one doesn't keep short ones in the rounds.
        ids, counts = [], [np.empty(0, np.int64)]
        for at in range(0, len(order), 1 << 15):
            own = first[order[at : at + (1 << 15)]]
            got, count = self.encode_words([data[i:j] for i, j in zip(words.start[own].tolist(), words.end[own].tolist(), strict=True)])
            ids.append(got)
            counts.append(count)
        count = np.concatenate(counts)
        begin = np.cumsum(count) - count
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        place = back[kind]
        size, begin, unit = count[place], begin[place], words.unit
        table = np.concatenate(ids) if ids else np.empty(0, np.int32)
        table = np.r_[table, after[after >= 0].astype(np.int32)]
        if (after >= 0).any():  # a special string is one token behind its unit
            has = np.flatnonzero(after >= 0)
            where = np.searchsorted(unit, has, "right")
            unit, size = np.insert(unit, where, has), np.insert(size, where, 1)
            begin = np.insert(begin, where, len(table) - len(has) + np.arange(len(has)))
        off = np.cumsum(size) - size
        flat = table[np.repeat(begin - off, size) + np.arange(int(size.sum()))]
        per_text = np.bincount(owner[unit], weights=size, minlength=len(texts)).astype(np.int64)
        return flat, per_text

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``: their bytes joined and read as UTF-8, bad sequences replaced; of none, the empty text. An id outside the vocabulary is an error."""
        size = self.size_of[ids]
        off = np.cumsum(size) - size
        return self.all_bytes[np.repeat(self.at_of[ids] - off, size) + np.arange(int(size.sum()))].tobytes().decode("utf-8", "replace")


def decimal(ids: np.ndarray) -> bytes:
    """``ids`` in decimal, joined by commas."""
    if not len(ids):
        return b""
    digits = 1 + np.searchsorted(10 ** np.arange(1, 10), ids, "right")
    end = np.cumsum(digits + 1)
    out = np.full(int(end[-1]), ord(","), np.uint8)
    rest = ids.astype(np.int64)
    for k in range(int(digits.max())):
        has = digits > k
        out[(end - 2 - k)[has]] = ord("0") + rest[has] % 10
        rest //= 10
    return out[:-1].tobytes()


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """Every row of ``docs`` encoded and decoded: ``(id, n_tokens, ids_sha256, decoded_sha256)``, with ``ids`` and ``decoded`` if asked for.

    ``vocabulary`` names a byte-level BPE file of the installed public tokenizers.
    Null texts are read as empty: no tokens, the digests of empty strings. Special
    strings inside texts become their own tokens. Rows that repeat are encoded
    each; extra columns are not read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(public_tokenizers.path(vocabulary))
        for pdf in batches:
            out = []
            for part in text_chunks([t or "" for t in pdf["text"]], CHARS):
                flat, count = bpe.encode_batch(part)
                end = np.cumsum(count)
                for i, j in zip((end - count).tolist(), end.tolist(), strict=True):
                    ids, decoded = decimal(flat[i:j]), bpe.decode(flat[i:j])
                    row = [j - i, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                    out.append(row + [ids.decode()] * keep_ids + [decoded] * keep_text)
            got = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids + ["decoded"] * keep_text)
            got.insert(0, "id", pdf["id"].to_numpy())
            yield got

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string" * keep_ids + ", decoded string" * keep_text
    return spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInPandas(run, schema)
