"""Cross-tokenizer alignment with packed bitsets of token ends.

Both token sequences of a text cover the same bytes. Two bitsets mark the byte
offsets where tokens end; their AND holds the shared cuts, and the popcount rank
of a cut in each bitset gives the ranges of tokens between two cuts (a group).
The OR cuts the bytes into the finest pieces: each piece lies in exactly one token
of either side, two tokens overlap in exactly one piece, so the pieces are the links,
and the rank of a piece's end names its two tokens.

How often an id pair is linked corpus-wide is joined back by chunk: a chunk of texts
sends each of its distinct pairs once, and gets one count for each.
"""

from __future__ import annotations

import copy
import functools
import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm import bpe
from factweave.llm.common import spread, stored, text_chunks

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of text that are worked on at once and share a list of pairs.
CHARS = 1_000_000
MARK = "▁"
Tokens = tuple[np.ndarray, np.ndarray]


class Bits:
    """A packed bitset over ``0..size`` with rank by popcounts."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> Bits:
        flags = np.zeros(((size + 1) // 64 + 1) * 64, np.uint8)
        flags[places] = 1
        return cls(np.packbits(flags, bitorder="little").view("<u8"))

    def places(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The number of marks below each of ``at``."""
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & low)


class Pieces:
    """A sentencepiece model that encodes each distinct word of a batch once.

    Pieces hold the mark of a space only at their start, so no merge crosses the
    place where a space follows something else, and what stands between two such places can
    be encoded by itself. A model with other pieces gets whole texts.
    """

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        raw = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.by_word = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.space = self.model.piece_to_id(MARK)
        self.size_of = np.array([len(r) for r in raw], np.int64)
        self.at_of = np.cumsum(self.size_of) - self.size_of
        self.all_bytes = np.frombuffer(b"".join(raw), np.uint8)

    def encode_batch(self, texts: list[str]) -> Tokens:
        """Flat token ids of ``texts`` and the number of tokens of each."""
        units = [re.findall(r" +[^ ]*", f" {t}") if self.by_word else [f" {t}"] for t in texts]
        words: dict[str, int] = {}
        kind = np.fromiter((words.setdefault(u, len(words)) for part in units for u in part), np.int64, sum(map(len, units)))
        got = self.model.encode([w[1:] for w in words], num_threads=1) if len(words) else []  # the model puts a space in front, but not to the empty text
        got = [[self.space] if w == " " else ids for w, ids in zip(words, got, strict=True)]
        count = np.fromiter(map(len, got), np.int64, len(got))
        table, begin = np.fromiter(chain.from_iterable(got), np.int64, int(count.sum())), np.cumsum(count) - count
        size = count[kind]
        off = np.cumsum(size) - size
        flat = table[np.repeat(begin[kind] - off, size) + np.arange(int(size.sum()))]
        owner = np.repeat(np.arange(len(texts)), [len(u) for u in units])
        return flat, np.bincount(owner, weights=size, minlength=len(texts)).astype(np.int64)


@functools.lru_cache(maxsize=2)
def _sides(first: str, second: str) -> tuple[bpe.ByteBpe, Pieces]:
    plain = copy.copy(bpe.load(public_tokenizers.path(first)))
    plain.special, plain.split_special = {}, None  # special strings inside texts are plain text
    return plain, Pieces(public_tokenizers.path(second))


def _equal(side: bpe.ByteBpe | Pieces, tokens: Tokens, want: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each text: whether the bytes of its tokens are its bytes, ``want`` being those of all texts."""
    flat, count = tokens
    width = side.size_of[flat]
    owner = np.repeat(np.arange(len(count)), count)
    total = np.bincount(owner, weights=width, minlength=len(count)).astype(np.int64)
    same = total == size
    ok = same[owner]
    width, at = width[ok], side.at_of[flat[ok]]
    off = np.cumsum(width) - width
    got = side.all_bytes[np.repeat(at - off, width) + np.arange(int(width.sum()))]
    differs = got != want[np.repeat(same, size)]
    same[np.unique(np.repeat(np.flatnonzero(same), size[same])[differs])] = False
    return same


def _written(ids: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` in decimal, each followed by its separator, as bytes; and the place behind each separator."""
    digits = 1 + np.searchsorted(10 ** np.arange(1, 10), ids, "right")
    end = np.cumsum(digits + 1)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    out[end - 1] = separators
    rest = ids.astype(np.int64)
    for k in range(int(digits.max(initial=0))):
        has = digits > k
        out[(end - 2 - k)[has]] = ord("0") + rest[has] % 10
        rest //= 10
    return out, end


def align(texts: list[str], first: str = FIRST, second: str = SECOND) -> dict[str, np.ndarray]:
    """The alignment of ``texts``, all of them laid out behind each other.

    By text: ``n_a n_b n_groups n_links groups`` (``a1,a2|b1;...``, the empty string without tokens).
    By link, in order: ``a`` and ``b``, the ids of its tokens.
    """
    one, two = _sides(first, second)
    raw = [f" {t}".encode() if t and MARK not in t else b"" for t in texts]  # the mark itself comes back as a space
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    want = np.frombuffer(b"".join(raw), np.uint8)
    shown = [t if n else "" for t, n in zip(texts, size.tolist(), strict=True)]
    sides = []
    ok = size > 0
    for side, tokens in ((one, one.encode_batch([f" {t}" if n else "" for t, n in zip(shown, size.tolist(), strict=True)])), (two, two.encode_batch(shown))):
        flat, count = tokens
        here = np.repeat(size > 0, count)
        tokens = flat[here], np.where(size > 0, count, 0)
        ok &= _equal(side, tokens, want, size)
        sides.append((side, *tokens))
    size = np.where(ok, size, 0)
    ids, counts, ends = [], [], []
    for side, flat, count in sides:
        ids.append(flat[np.repeat(ok, count)].astype(np.int64))
        counts.append(np.where(ok, count, 0))
        ends.append(np.cumsum(side.size_of[ids[-1]]))
    total = int(size.sum())
    a, b = (Bits.of(e, total) for e in ends)
    cuts = Bits(a.words & b.words).places()
    pieces = Bits(a.words | b.words).places()
    upto = [np.r_[0, x.rank(cuts + 1)] for x in (a, b)]  # tokens before each group, on both sides
    group = [np.repeat(np.arange(len(cuts)), np.diff(u)) for u in upto]
    place = np.arange(len(ids[0])) + upto[1][group[0]], np.arange(len(ids[1])) + upto[0][group[1] + 1]
    row, marks = np.empty(len(ids[0]) + len(ids[1]), np.int64), np.full(len(ids[0]) + len(ids[1]), ord(","), np.uint8)
    for k, mark in ((0, "|"), (1, ";")):
        row[place[k]] = ids[k]
        marks[place[k][upto[k][1:] - 1]] = ord(mark)
    text, stop = _written(row, marks)
    bound = np.r_[0, stop][np.r_[0, np.cumsum(counts[0] + counts[1])]]
    whole = text.tobytes()
    close = np.cumsum(size)
    within = lambda places: np.diff(np.searchsorted(places, np.r_[0, close], "right"))
    return {
        "n_a": counts[0], "n_b": counts[1], "n_groups": within(cuts), "n_links": within(pieces),
        "groups": np.array([whole[i : max(i, j - 1)] for i, j in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)], object),
        "a": ids[0][a.rank(pieces)], "b": ids[1][b.rank(pieces)],
    }


def _chunks(first: str, second: str):
    """A row for each chunk of texts: figures by text, the distinct pairs with their links, and for each link the number of its pair."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own, at = pdf["id"].astype(object).where(pdf["id"].notna(), None).tolist(), 0
            for part in text_chunks([t or "" for t in pdf["text"]], CHARS):
                got = align(part, first, second)
                pair, link, n = np.unique(got["a"] << 32 | got["b"], return_inverse=True, return_counts=True)
                digest = [hashlib.sha256(g).hexdigest() if g else "" for g in got["groups"]]
                yield pd.DataFrame([{
                    "chunk": uuid.uuid4().hex, "id": own[at : at + len(part)], **{k: got[k] for k in ("n_a", "n_b", "n_groups", "n_links")},
                    "groups_sha256": digest, "pair": pair, "n": n, "link": link.astype("<u2" if len(pair) <= 1 << 16 else "<u4").tobytes(),
                }])
                at += len(part)

    return run


def _resolved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            n = np.asarray(row.n_links, np.int64)
            end = np.cumsum(n)
            table = (np.empty(0, np.int64), np.empty(0, bool)) if row.total is None else (np.asarray(row.total, np.int64), np.asarray(row.best, bool))
            link = np.frombuffer(row.link, "<u2" if len(table[0]) <= 1 << 16 else "<u4")
            sums = [np.r_[0, np.cumsum(x[link], dtype=np.int64)] for x in table]
            out = {"id": row.id, "n_a": row.n_a, "n_b": row.n_b, "n_groups": row.n_groups, "n_links": n}
            out |= {"n_best": sums[1][end] - sums[1][end - n], "count_sum": sums[0][end] - sums[0][end - n], "groups_sha256": row.groups_sha256}
            yield pd.DataFrame(out)


def alignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: str = FIRST, second: str = SECOND) -> tuple[DataFrame, DataFrame]:
    """``(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for every row of ``docs``, and ``(a, b, n, best)`` for every linked id pair.

    ``first`` names a byte-level BPE of the tokenizers library, which gets a space and the text; ``second``
    a sentencepiece model, which puts the space itself. Texts that are null or empty, or whose token
    bytes on either side are not the space and the text, have no tokens: zeros and the empty string.
    Rows that repeat an id are aligned each and all their links count; a null id stays null; other columns
    are not read; an empty table gives empty results. The chunks are written once to the checkpoint
    folder, so both results rest on the same run.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    schema = f"chunk string, id array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, pair array<long>, n array<long>, link binary"
    chunks = stored(spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInPandas(_chunks(first, second), schema))
    counts = chunks.select(F.explode(F.arrays_zip("pair", "n")).alias("p")).groupBy(F.col("p.pair").alias("pair")).agg(F.sum("p.n").alias("total"))
    counts = stored(counts.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)))
    top = counts.groupBy("b").agg(F.max("total").alias("top"))
    pairs = counts.join(top, "b").select("pair", "b", "total", (F.col("total") == F.col("top")).alias("best"))
    asked = chunks.select("chunk", F.posexplode("pair").alias("k", "pair"))
    few = max(spark.sparkContext.defaultParallelism, chunks.count() // 4)  # rows are some MB each, so a task gets few
    told = asked.join(pairs, "pair").repartition(few, "chunk").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("k", "total", "best"))).alias("t"))
    full = chunks.drop("pair", "n").repartition(few, "chunk").join(told.select("chunk", F.col("t.total").alias("total"), F.col("t.best").alias("best")), "chunk", "left")
    rows = full.drop("chunk").mapInPandas(_resolved, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return rows, pairs.select(F.shiftright("pair", 32).alias("a"), "b", F.col("total").alias("n"), "best")
