"""Benchmark decontamination: a BM25 index of test items that every training passage queries.

The index is small (its block size is checked), the corpus streams past it. The
words of a batch of documents become overlapping windows, and all items that
reach the threshold for a window are found by block-max WAND over many windows at
once. A window's terms that together stay under the threshold, by their
greatest impacts, propose nothing. The other terms name the blocks of items they
occur in; a (window, block) pair whose greatest impacts, of all terms in that block,
reach the threshold is scored, and only the postings of such pairs are read. Impacts are
divided by the item's own score, so a window that holds the whole item scores
1. Retrieved items are verified by five-word shingles of question and answer.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import spread, stored, text_chunks

K1, B = 1.2, 0.75
SEGMENT, SHINGLE = 64, 5
#: Bytes of item text in one index; a larger benchmark is cut into several, and the corpus passes each.
INDEX_BYTES = 4_000_000
#: Indexes that one pass over the corpus carries; the driver and a plan hold no more at once.
AT_ONCE = 4
BLOCK = 32
#: A table of the cells by term and block is held if it has so many entries at most; else cells are found by binary search.
TABLE = 4_000_000
#: Entries that one step of a search expands at a time, and characters of text in it.
STEP, CHARS = 200_000, 500_000
LEAK = "array<struct<item_id:long,score:double,overlap:double,question_overlap:double,answer_overlap:double>>"
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+")
_PUNCTUATION = bytes(c if chr(c).isalnum() or c >= 0x80 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII punctuation divides."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_PUNCTUATION).split()


def shingles(words: list[bytes], n: int = SHINGLE) -> set[bytes]:
    """All runs of ``n`` words; the whole sequence if it is shorter."""
    if not words:
        return set()
    return {b" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))}


def question_and_answer(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The words before the last sentence, and those of the last sentence; of one sentence, all words are the question."""
    parts = [p for p in _SENTENCE.split(text or "") if words_of(p)]
    if len(parts) < 2:
        return words_of(text), []
    return [w for p in parts[:-1] for w in words_of(p)], words_of(parts[-1])


def _spread_out(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The positions ``begin[i] .. begin[i] + count[i]`` of all i, one after the other."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _steps(cost: np.ndarray) -> Iterator[slice]:
    """Runs of entries whose costs add up to ``STEP`` or less (an entry above that by itself)."""
    total, at = np.cumsum(cost), 0
    while at < len(cost):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP, "right")))
        yield slice(at, end)
        at = end


@dataclass
class Index:
    """Postings by term with impacts (``begin``: where a term's postings begin), and the greatest impact of each term and of each term in each block.

    Terms are numbered from the one of least impact on. ``cell`` is term * blocks + block of the blocks that hold a term, in order, with the
    greatest impact and the place of the first posting there; ``cells`` is where a term's begin.
    """

    item: np.ndarray
    texts: list[str]
    of: np.ndarray
    vocabulary: dict[bytes, int]
    begin: np.ndarray
    segment: np.ndarray
    impact: np.ndarray
    best: np.ndarray
    blocks: int
    cell: np.ndarray
    cell_best: np.ndarray
    cell_begin: np.ndarray
    cells: np.ndarray
    stride: int
    memo: dict = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    @classmethod
    def build(cls, items: list[tuple[int, str | None]]) -> Index:
        items = [(i, t) for i, t in items if words_of(t)]
        # A short rest joins the segment before it, so that no segment is a few common words.
        merged: list[tuple[int, Counter]] = []
        for k, (_, t) in enumerate(items):
            w = words_of(t)
            cuts = [w[a : a + SEGMENT] for a in range(0, len(w), SEGMENT)]
            if len(cuts) > 1 and len(cuts[-1]) < SEGMENT // 4:
                cuts[-2:] = [cuts[-2] + cuts[-1]]
            merged += [(k, Counter(c)) for c in cuts]
        vocabulary: dict[bytes, int] = {}
        for _, c in merged:
            for t in c:
                vocabulary.setdefault(t, len(vocabulary))
        n, v = len(merged), len(vocabulary)
        sizes = np.array([c.total() for _, c in merged], np.int64)
        seg = np.repeat(np.arange(n), np.array([len(c) for _, c in merged], np.int64))
        term = np.fromiter((vocabulary[t] for _, c in merged for t in c), np.int64, len(seg))
        tf = np.fromiter((f for _, c in merged for f in c.values()), np.int64, len(seg))
        df = np.bincount(term, minlength=v)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        imp = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[seg] / (sizes.mean() if n else 1)))
        imp = imp / np.bincount(seg, weights=imp, minlength=n)[seg]
        best, blocks = np.zeros(v), -(-max(1, n) // BLOCK)
        np.maximum.at(best, term, imp)
        order = np.argsort(best, kind="stable")
        place = np.empty(v, np.int64)
        place[order] = np.arange(v)
        vocabulary, best, term = {t: int(place[k]) for t, k in vocabulary.items()}, best[order], place[term]
        order = np.lexsort((seg, term))
        term, seg, imp = term[order], seg[order], imp[order]
        key = term * blocks + seg // BLOCK
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        cell_best = np.maximum.reduceat(imp, first) if len(first) else np.empty(0)
        cell = key[first]
        return cls(
            np.array([i for i, _ in items], np.int64), [t for _, t in items], np.array([k for k, _ in merged], np.int64), vocabulary, np.searchsorted(term, np.arange(v + 1)), seg, imp, best,
            blocks, cell, cell_best, np.r_[first, len(key)], np.searchsorted(cell, np.arange(v + 1) * blocks), int(sizes.max()) if n else 1,
        )

    def retrieve(self, docs: list[list[bytes]], least: float) -> dict[tuple[int, int], float]:
        """For (document, item): the best score of its windows, where it reaches ``least``."""
        if not self.vocabulary:
            return {}
        size = np.fromiter(map(len, docs), np.int64, len(docs))
        term = np.fromiter(map(self.vocabulary.get, chain.from_iterable(docs), repeat(-1)), np.int64, int(size.sum()))
        hit = np.flatnonzero(term >= 0)
        if not len(hit):
            return {}
        own = np.repeat(np.arange(len(docs)), size)[hit]
        place = hit - (np.cumsum(size) - size)[own]
        # Windows of two strides begin at each stride, so some window holds any run of one stride.
        per = size // self.stride + 1
        window = (np.cumsum(per) - per)[own] + place // self.stride
        v = len(self.vocabulary)
        before = place >= self.stride
        key = np.unique(np.concatenate([window, window[before] - 1]) * v + np.concatenate([term[hit], term[hit][before]]))
        window, t = key // v, key % v
        live = np.bincount(window, weights=self.best[t])[window] >= least - 1e-6
        window, t = window[live], t[live]
        of_doc = np.repeat(np.arange(len(docs)), per)
        found: dict[tuple[int, int], float] = {}
        for w, seg, score in self._search(window, t, least):
            for d, k, s in zip(of_doc[w].tolist(), self.of[seg].tolist(), score.tolist(), strict=True):
                found[d, k] = max(s, found.get((d, k), 0.0))
        return found

    def _search(self, window: np.ndarray, t: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Windows, segments and scores of all that reach ``least``; ``(window, t)`` are distinct and sorted by window."""
        # Terms come from the weakest on: while their sum stays under the threshold, a segment needs another term too.
        first = np.flatnonzero(np.r_[True, window[1:] != window[:-1]]) if len(window) else np.empty(0, np.int64)
        count = np.diff(np.r_[first, len(window)])
        row = np.repeat(np.arange(len(first)), count)
        upto = np.cumsum(self.best[t])
        upto -= np.repeat(upto[first] - self.best[t[first]], count)
        weak = upto < least - 1e-6
        rest = np.bincount(row, weights=np.where(weak, self.best[t], 0), minlength=len(first))
        spans = np.where(weak, 0, self.cells[t + 1] - self.cells[t])
        for rows in _steps(np.bincount(row, weights=spans, minlength=len(first)).astype(np.int64)):
            mine = slice(first[rows.start], first[rows.stop] if rows.stop < len(first) else len(row))
            strong = np.flatnonzero(spans[mine]) + mine.start
            cells = _spread_out(self.cells[t[strong]], spans[strong])
            key = np.repeat((row[strong] - rows.start) * self.blocks, spans[strong]) + self.cell[cells] % self.blocks
            bound = np.bincount(key, weights=self.cell_best[cells], minlength=(rows.stop - rows.start) * self.blocks)
            bound += np.repeat(np.where(bound.reshape(-1, self.blocks).any(1), rest[rows], -1), self.blocks)
            pair = np.flatnonzero(bound >= least - 1e-6) + rows.start * self.blocks
            r = pair // self.blocks
            for part in _steps(count[r]):
                of, cells = self._reaching(pair[part], first[r[part]], count[r[part]], t, least)
                w, seg, score = self._scores(pair[part], of, cells)
                ok = score >= least - 1e-9
                yield window[first][w[ok]], seg[ok], score[ok]

    def _reaching(self, pair: np.ndarray, begin: np.ndarray, count: np.ndarray, t: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Of (window, block) pairs, with terms ``t[begin:begin + count]``, those whose full bound reaches ``least``: the pair and the cell of each of its terms in the block."""
        of = np.repeat(np.arange(len(pair)), count)
        key = t[_spread_out(begin, count)] * self.blocks + (pair % self.blocks)[of]
        at = self.find(key)
        of, at = of[at >= 0], at[at >= 0]
        ok = (np.bincount(of, weights=self.cell_best[at], minlength=len(pair)) >= least - 1e-6)[of]
        return of[ok], at[ok]

    def _scores(self, pair: np.ndarray, of: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows, segments and scores from the postings of ``cells`` of the pairs ``of``."""
        n = self.cell_begin[cells + 1] - self.cell_begin[cells]
        post = _spread_out(self.cell_begin[cells], n)
        new = np.r_[True, of[1:] != of[:-1]] if len(of) else np.empty(0, bool)
        live, place = pair[of[new]], np.cumsum(new) - 1
        score = np.bincount(np.repeat(place * BLOCK, n) + self.segment[post] % BLOCK, weights=self.impact[post], minlength=len(live) * BLOCK)
        hit = np.flatnonzero(score)
        own = live[hit // BLOCK]
        return own // self.blocks, own % self.blocks * BLOCK + hit % BLOCK, score[hit]

    def find(self, key: np.ndarray) -> np.ndarray:
        """The number of the cell of each key; -1 if there is none."""
        size = len(self.vocabulary) * self.blocks
        if size > TABLE:
            at = np.minimum(np.searchsorted(self.cell, key), len(self.cell) - 1)
            return np.where(self.cell[at] == key, at, -1)
        if "table" not in self.memo:
            self.memo["table"] = np.full(size, -1, np.int32)
            self.memo["table"][self.cell] = np.arange(len(self.cell))
        return self.memo["table"][key]

    def _facts(self, k: int) -> tuple[int, set[bytes], set[bytes], set[bytes]]:
        """Number of words, shingles, and words of question and answer of item ``k``."""
        facts = self.memo.setdefault("facts", {})
        if k not in facts:
            if len(facts) >= 1000:
                facts.clear()
            words = words_of(self.texts[k])
            q, a = question_and_answer(self.texts[k])
            facts[k] = len(words), shingles(words), {*q}, {*a}
        return facts[k]

    def verify(self, doc: set[bytes], in_doc: set[bytes], k: int) -> tuple[float, float, float]:
        """Shares of item ``k`` in a document: of its shingles, and of the words of question and answer."""
        n, own, q, a = self._facts(k)
        if n < SHINGLE:
            doc = {b" ".join(w[j : j + n]) for w in (s.split() for s in doc) for j in range(len(w) - n + 1)}
        share = lambda p: len(p & in_doc) / len(p) if p else 1.0
        return len(own & doc) / len(own), share(q), share(a)


def leaks(text: Column, index: Index, least_score: float = 0.4, least_overlap: float = 0.8) -> Column:
    """The items that each text holds: those retrieved whose shingles, and whose question's and answer's words, overlap by ``least_overlap``."""

    @F.pandas_udf(LEAK)
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for part in text_chunks([t or "" for t in texts], CHARS):
            docs = [words_of(t) for t in part]
            got: list[list[dict]] = [[] for _ in docs]
            by_doc: dict[int, list[tuple[int, float]]] = {}
            for (d, k), s in index.retrieve(docs, least_score).items():
                by_doc.setdefault(d, []).append((k, s))
            for d, cand in by_doc.items():
                own, words = shingles(docs[d]), {*docs[d]}
                for k, s in sorted(cand):
                    overlap, q, a = index.verify(own, words, k)
                    if min(overlap, q, a) >= least_overlap:
                        got[d].append({"item_id": int(index.item[k]), "score": round(s, 9), "overlap": overlap, "question_overlap": q, "answer_overlap": a})
            out += got
        return pd.Series(out)

    return run(text)


class Indexes:
    """The indexes over the parts of a benchmark, each read and built when it is its turn."""

    def __init__(self, rows: DataFrame, parts: int):
        self.rows, self.parts = rows, parts

    def __len__(self) -> int:
        return self.parts

    def __iter__(self) -> Iterator[Index]:
        for k in range(self.parts):
            part = self.rows.where(F.pmod(F.xxhash64("i"), F.lit(self.parts)) == k) if self.parts > 1 else self.rows
            yield Index.build(sorted((r["i"], r["t"]) for r in part.toLocalIterator()))

    def groups(self, size: int | None = None) -> Iterator[list[Index]]:
        """Lists of ``size`` indexes (``AT_ONCE``), the last one shorter."""
        held: list[Index] = []
        for k, index in enumerate(self, 1):
            held.append(index)
            if len(held) == (size or AT_ONCE) or k == self.parts:
                yield held
                held = []


def indexes(items: DataFrame, id_col: str = "item_id", text_col: str = "text", index_bytes: int = INDEX_BYTES) -> Indexes:
    """Indexes over parts of ``items``, each of about ``index_bytes`` of text (a longer item by itself).

    The number of parts comes from the summed size. Parts are read and built one after
    the other, so the driver holds those of one pass (``AT_ONCE``) and no more. Items with a
    null id or without words are left out; repeated rows count once. Ids are whole numbers; one that
    doesn't read as such is an error.
    """
    rows = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).distinct()
    total = rows.agg(F.sum(F.octet_length("t")).alias("s")).first()["s"] or 0
    return Indexes(rows, max(1, -(-total // index_bytes)))


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, item_id, score, overlap, question_overlap, answer_overlap)`` for each document and item that it holds.

    Null, empty and very short texts hold nothing; rows that repeat give their rows
    each; an empty table on either side gives an empty result; columns that are not
    named are not read. A document of any length is read whole, in windows.
    """
    own = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    parts, out = indexes(items), None
    for group in parts.groups():
        each = F.concat(*[leaks(F.col("text"), index) for index in group])
        found = own.select("id", F.explode(each).alias("x")).select("id", "x.*")
        if len(parts) > AT_ONCE:  # written, so that no plan carries all indexes
            found = stored(found)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; no row is moved.

    Null and empty texts hold nothing and stay, as do repeated rows and rows with a null
    id. Without items, or of an empty table, all rows stay. A benchmark of more than
    ``AT_ONCE`` indexes takes several passes, each result written to the checkpoint folder.
    """
    parts = indexes(items)
    for k, group in enumerate(parts.groups()):
        docs = stored(docs) if k else docs
        for index in group:
            docs = docs.where(F.size(leaks(F.col(text_col), index)) == 0)
    return docs
