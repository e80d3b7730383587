"""Token counts by a compiled finite-state tokenizer.

Two deterministic transducers are run. The first splits texts into words (see
``split``: chunk state maps, composed by a parallel prefix scan). The second reads
a word byte by byte and annotates each transition with the change of the token
count, so a word's count is the sum along its path and no token is ever built.

The second machine rests on two facts of byte-pair encoding: an encoding without
its last token is the encoding of the bytes before that token, and two tokens stand
side by side exactly when encoding their joined bytes gives them back. So the last token of a prefix
that ends at ``i`` is the only vocabulary item ``w[j:i]`` that fits behind the
last token of the prefix that ends at ``j``. A state keeps, for each start ``j``
from which some vocabulary item could still go on, its trie node, the last token
before ``j`` and the count there relative to now. This is finite; states and
transitions are compiled when first met and shared by all words of a worker.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.bpe import CHARS, VOCABULARY, ByteBpe
from factweave.llm.common import spread, text_chunks
from factweave.llm.split import Words, units_of

#: Above so many states the tables are compiled anew for the next batch; this bounds a worker's memory, not the texts.
MAX_STATES = 250_000
MIX, M64 = 0x9E3779B97F4A7C15, 1 << 64


class CountingTransducer:
    """Deterministic transducer from the bytes of a word to the change of its token count."""

    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe
        # Tokens are numbered by rank here: single bytes first, then merges in their order.
        number = {int(t): k for k, t in enumerate(bpe.byte_id.tolist())}
        self.pair, self.parts = {}, [(k, k) for k in range(256)]
        for a, b, c in bpe.merges:
            if c not in number:
                number[c] = len(number)
                self.parts.append((number[a], number[b]))
            self.pair.setdefault((number[a], number[b]), number[c])
        self.child: dict[int, int] = {}
        self.token = [-1]
        for t, k in number.items():
            node = 0
            for byte in bpe.bytes_of[t]:
                to = self.child.get(node << 8 | byte)
                if to is None:
                    to = self.child[node << 8 | byte] = len(self.token)
                    self.token.append(-1)
                node = to
            if self.token[node] < 0:
                self.token[node] = k
        self.fits_memo: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        begin = array("i", (0, -1, 0)).tobytes()
        self.ids: dict[bytes, int] = {begin: 0}
        self.keys = [begin]
        self._table(1 << 16)

    def _table(self, slots: int) -> None:
        """An open-addressing table of transitions: state and byte to next state and count change."""
        self.slots, self.used = slots, 0
        self.at = np.full(slots, -1, np.int64)
        self.next, self.emit = np.zeros(slots, np.int32), np.zeros(slots, np.int16)

    def _add(self, key: int, to: int, change: int) -> None:
        if self.used * 2 >= self.slots:
            old = self.at, self.next, self.emit
            self._table(self.slots * 2)
            has = old[0] >= 0
            for x in zip(*(c[has].tolist() for c in old), strict=True):
                self._add(*x)
        slot = key * MIX % M64 >> 20 & self.slots - 1
        while self.at[slot] >= 0:
            slot = slot + 1 & self.slots - 1
        self.at[slot], self.next[slot], self.emit[slot] = key, to, change
        self.used += 1

    def _find(self, key: np.ndarray) -> np.ndarray:
        """The slot of each transition, -1 if it isn't compiled yet."""
        slot = (key.astype(np.uint64) * np.uint64(MIX) >> np.uint64(20)).astype(np.int64) & self.slots - 1
        got = self.at[slot]
        todo = np.flatnonzero((got != key) & (got >= 0))
        while len(todo):
            slot[todo] = slot[todo] + 1 & self.slots - 1
            got[todo] = self.at[slot[todo]]
            todo = todo[(got[todo] != key[todo]) & (got[todo] >= 0)]
        slot[got < 0] = -1
        return slot

    def fits(self, left: int, right: int) -> bool:
        """Whether encoding the joined bytes of two tokens gives the two tokens.

        The merges that made them are undone from the latest to the earliest; if at
        some point the two tokens at the border would merge before what was undone
        last, they don't stand side by side.
        """
        memo = left << 32 | right
        got = self.fits_memo.get(memo)
        if got is None:
            a, b, before = left, right, 1 << 60
            while True:
                made = self.pair.get((a, b))
                if made is not None and made < before:
                    got = False
                    break
                if a < 256 and b < 256:
                    got = True
                    break
                if a > b or b < 256:  # the left token was made last
                    before, a = a, self.parts[a][1]
                else:  # of equal tokens the left one is made first
                    before, b = b + 1, self.parts[b][0]
            if len(self.fits_memo) > 400_000:
                self.fits_memo.clear()
            self.fits_memo[memo] = got
        return got

    def _compile(self, state: int, byte: int) -> None:
        kept, found = [], None
        own = array("i", self.keys[state])
        child, tokens = self.child, self.token
        for k in range(0, len(own), 3):
            to = child.get(own[k] << 8 | byte)
            if to is None:
                continue
            kept += [to, own[k + 1], own[k + 2]]
            t = tokens[to]
            if t >= 0 and found is None and (own[k + 1] < 0 or self.fits(own[k + 1], t)):
                found = t, own[k + 2] + 1
        token, change = found
        kept[2::3] = [c - change for c in kept[2::3]]
        key = array("i", [*kept, 0, token, 0]).tobytes()
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.keys)
            self.keys.append(key)
        self._add(state << 8 | byte, to, change)

    def counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of tokens of each word ``data[start:end]``."""
        if len(self.keys) > MAX_STATES:
            self.clear()
        size = end - start
        order = np.argsort(-size, kind="stable")
        begin, size = start[order], size[order]
        live = np.searchsorted(-size, -np.arange(1, (int(size[0]) if len(size) else 0) + 1), "right")
        state, total = np.zeros(len(size), np.int32), np.zeros(len(size), np.int64)
        for k, n in enumerate(live.tolist()):
            key = state[:n].astype(np.int64) << 8 | data[begin[:n] + k]
            slot = self._find(key)
            new = np.flatnonzero(slot < 0)
            if len(new):
                for x in np.unique(key[new]).tolist():
                    self._compile(x >> 8, x & 255)
                slot = self._find(key)
            total[:n] += self.emit[slot]
            state[:n] = self.next[slot]
        out = np.empty(len(size), np.int64)
        out[order] = total
        return out

    def count_batch(self, texts: list[str]) -> np.ndarray:
        units, owner, after = units_of(texts, self.bpe.special, self.bpe.split_special)
        words = Words(units)
        first, kind = words.unique()
        count = self.counts(words.data, words.start[first], words.end[first])
        out = np.bincount(owner[words.unit], weights=count[kind], minlength=len(texts)).astype(np.int64)
        return out + np.bincount(owner[after >= 0], minlength=len(texts))


@functools.lru_cache(maxsize=2)
def load(path: str) -> CountingTransducer:
    return CountingTransducer(ByteBpe(path))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, limit: int = 512) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` for every row of ``docs``.

    ``n_tokens`` is what the tokenizers library gives for ``vocabulary`` without
    added special tokens; a special string inside a text counts one. A null text
    is read as empty (0 bytes, 0 tokens). Repeated rows are counted each; extra
    columns are not read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = load(public_tokenizers.path(vocabulary))
        for pdf in batches:
            got = [machine.count_batch(part) for part in text_chunks([t or "" for t in pdf["text"]], CHARS)]
            yield pd.DataFrame({"id": pdf["id"], "n_bytes": pdf["n_bytes"], "n_tokens": np.concatenate(got) if got else np.empty(0, np.int64)})

    kind = docs.schema[id_col].dataType.simpleString()
    return (
        spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")))
        .mapInPandas(run, f"id {kind}, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
