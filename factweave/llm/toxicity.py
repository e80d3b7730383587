"""Toxicity scores from a weighted lexicon matched by Aho-Corasick.

Texts are folded (case, homoglyphs, digits and signs that stand for letters,
invisible characters), matched against words and word beginnings with learned
weights, hits inside exception phrases are dropped, and the sum of the weights
and its share of the length give a score between 0 and 1.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from factweave.llm.common import spread

#: Letters of other scripts by the Latin letter that they look like.
HOMOGLYPHS = {
    "a": "аαɑ", "b": "ьβЬ", "c": "сϲ", "d": "ԁ", "e": "еєεё", "g": "ɡ", "h": "һн", "i": "іιıї", "j": "ј", "k": "кκ", "m": "м", "n": "ոп", "o": "оοσօ",
    "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υս", "v": "νѵ", "w": "ԝω", "x": "хχ", "y": "уγ", "z": "ᴢ",
}
#: Digits and signs that stand for letters next to letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "i"}
#: Words that count from the start, unless the training rows speak against them, and phrases in which such words are harmless.
SEEDS = ("loser", "idiot", "pathetic", "scum", "worthless", "moron", "trash", "clown", "disgusting", "stupid")
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bins", "trash bag", "trash bags", "trash collection", "clown fish", "clown car", "class clown", "sore loser")
SEED_WEIGHT = 4.0
#: At most so many labelled training rows of each label are read for the fit; the lexicon is bounded by what they hold.
FIT_TOXIC, FIT_CLEAN = 3_000, 9_000
PREFIXES = range(4, 9)
#: A pattern enters if chance explains its rows with probability under exp(-16), which allows for some 100,000 patterns tried,
EVIDENCE = 16.0
#: and if it is so many times likelier in toxic rows. Threefold cross-validation within the training rows of sf0.1 is flat
#: for odds from 5 to 20 and evidence of 8 and 16 (0.989) and falls at odds of 40 (0.983).
ODDS = 10.0
#: Score weights until enough labelled rows are there: constant, log of the sum, log of the share.
COEF = (-5.0, 2.0, 1.0)


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: the folded letter (space if it isn't one), whether it is a letter, the letter that it stands for next to letters (0: none), and whether it is invisible."""
    fold = np.full(0x110000, 32, np.uint32)
    unseen = np.zeros(0x110000, bool)
    like = {ord(x): a for a, xs in HOMOGLYPHS.items() for x in xs}
    shaped = [*range(0xFF00, 0xFFF0), *range(0x1D400, 0x1D800), *range(0x2100, 0x2150), *range(0x2460, 0x2500)]
    plain = {c: x for c in shaped if len(x := unicodedata.normalize("NFKC", chr(c))) == 1}
    for c in (*range(0x30000), *range(0xE0000, 0xE0200)):
        if 0xD800 <= c < 0xE000:
            continue
        if unicodedata.category(chr(c)) in ("Mn", "Me", "Cf"):  # combining marks, joiners, directions, variation selectors
            unseen[c] = True
            continue
        x = plain.get(c, chr(c)).lower()
        x = like.get(ord(x[0]), x[0])
        if x.isalpha():
            fold[c] = ord("i" if x == "l" else x)  # l, i and 1 are written for one another
    letter = fold != 32
    stands = np.zeros(0x110000, np.uint32)
    for a, b in SIGNS.items():
        stands[ord(a)] = ord(b)
    for c in range(0xFF00, 0xFFF0):
        stands[c] = stands[ord(plain.get(c, "x"))]
    return fold, letter, stands, unseen


def fold(text: str | None) -> str:
    """``text`` in folded letters, everything else a space, with a space at both ends.

    Letters lose case, and look-alikes become one letter; invisible characters and marks
    that no letter takes up go; a run of digits and signs that touches a letter is read as letters.
    Accents stay, since they tell words of the languages apart (see ``bare``).
    """
    if not text:
        return "  "
    table, letter, stands, unseen = _tables()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    hidden = unseen[codes]
    if hidden.any():
        codes = np.frombuffer(unicodedata.normalize("NFC", text).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = codes[~unseen[codes]]
    out = table[codes]
    sign = np.flatnonzero(stands[codes])
    if len(sign):
        is_letter = np.r_[False, letter[codes], False]
        run = np.cumsum(np.r_[True, np.diff(sign) != 1]) - 1
        touches = np.bincount(run, weights=is_letter[sign] | is_letter[sign + 2]) > 0
        sign = sign[touches[run]]
        out[sign] = stands[codes[sign]]
    return " " + out.tobytes().decode("utf-32-le", "replace") + " "


@functools.cache
def _bare_table() -> np.ndarray:
    return np.array([ord(unicodedata.normalize("NFD", chr(c))[0]) if not 0xD800 <= c < 0xE000 else c for c in range(0x30000)], np.uint32)


def bare(folded: str) -> str:
    """Folded text without accents, as long as it was."""
    codes = np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _bare_table()[codes].tobytes().decode("utf-32-le", "surrogatepass")


@dataclass(frozen=True)
class Lexicon:
    """``weights``: by folded pattern, with a space before and, for whole words, behind. ``coef``: constant, log of the sum, log of the share."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    coef: tuple[float, float, float] = COEF
    memo: dict = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def automaton(self):
        if "a" not in self.memo:
            a = ahocorasick.Automaton()
            for p, w in self.weights.items():
                a.add_word(p, (len(p), w))
            for p in self.exceptions:
                x = f" {' '.join(fold(p).split())} "
                a.add_word(x, (len(x), None))
            a.make_automaton()
            self.memo["a"] = a
        return self.memo["a"]

    def undisguised(self, words: list[str], folded: str) -> list[str]:
        """``words`` of ``folded``; one that is no whole word of the lexicon, but is without its accents, loses them."""
        if folded.isascii():
            return words
        if "whole" not in self.memo:
            self.memo["whole"] = frozenset(p[1:-1] for p in self.weights if p.endswith(" "))
        whole, plain = self.memo["whole"], bare(folded).split()
        if whole.isdisjoint(plain):
            return words
        return [q if q in whole and w not in whole else w for w, q in zip(words, plain, strict=True)]

    def sums(self, folded: str) -> tuple[float, int]:
        """The sum of the weights of the hits, leftmost and longest first, and the number of words."""
        words = self.undisguised(folded.split(), folded)
        n, folded = len(words), f" {' '.join(words)} "
        hits = [(end + 1 - size, end + 1, w) for end, (size, w) in self.automaton().iter(folded)]
        if not hits:
            return 0.0, n
        free = sorted((i, j) for i, j, w in hits if w is None)
        total, upto, reach, k = 0.0, 0, 0, 0  # reach: how far the exception phrases go that begin at or before the hit
        for i, j, w in sorted((h for h in hits if h[2] is not None), key=lambda h: (h[0], -h[1])):
            while k < len(free) and free[k][0] <= i:
                reach = max(reach, free[k][1])
                k += 1
            if i + 1 > upto and j > reach:
                total += w
                upto = j - 1
        return total, n

    def score(self, text: str | None) -> float:
        total, n = self.sums(fold(text))
        b, s, r = self.coef
        z = b + s * np.log1p(total) + r * np.log1p(100 * total / (n + 50))
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def seed_lexicon() -> Lexicon:
    return Lexicon({f" {w} ".replace("l", "i"): SEED_WEIGHT for w in SEEDS})


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _fit_score(total: np.ndarray, words: np.ndarray, toxic: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by damped Newton steps, both labels of equal weight."""
    x = np.c_[np.ones(len(total)), np.log1p(total), np.log1p(100 * total / (words + 50))]
    w = np.where(toxic == 1, 0.5 / max(1, (toxic == 1).sum()), 0.5 / max(1, (toxic == 0).sum()))
    beta, ridge = np.zeros(3), np.diag([1e-6, 1e-3, 1e-3])
    loss = lambda b: (w * np.logaddexp(0, (1 - 2 * toxic) * (x @ b))).sum() + b @ ridge @ b / 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ beta)))
        step = np.linalg.solve(x.T @ (x * (w * p * (1 - p))[:, None]) + ridge, x.T @ (w * (toxic - p)) - ridge @ beta)
        size = 1.0
        while size > 1e-6 and loss(beta + size * step) > loss(beta):
            size /= 2
        beta = beta + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return tuple(beta.tolist())


def _evidence(t: int, n: int, base: float) -> float:
    """The Chernoff exponent of seeing ``t`` toxic among ``n`` rows at the base rate."""
    p = min(t / n, 1 - 1e-12)
    return n * (p * np.log(p / base) + (1 - p) * np.log((1 - p) / (1 - base)))


def _choose(found: list[tuple[str, int, float]], docs: list[list[str]], n_toxic: int) -> dict[str, float]:
    """Of candidate patterns with support and odds, those that the toxic documents need.

    In falling support, a pattern stays if enough documents have fewer than two words
    covered by patterns before it and get one from it. Words that toxic documents
    share for other reasons (copies, common passages) lie in documents that
    are covered without them.
    """
    whole = {f for f, _, _ in found}
    at: dict[str, list[tuple[int, str]]] = {}
    for d, words in enumerate(docs):
        for w in words:
            for f in (f" {w} ", *(f" {w[:k]}" for k in PREFIXES if len(w) >= k)):
                if f in whole:
                    at.setdefault(f, []).append((d, w))
    covered: list[set[str]] = [set() for _ in docs]
    least, chosen = max(3, round(0.002 * n_toxic)), {}
    for f, _, odds in sorted(found, key=lambda x: (-x[1], len(x[0]), x[0])):
        own = at.get(f, [])
        gain = {d for d, w in own if len(covered[d]) < 2 and w not in covered[d]}
        if len(gain) >= least:
            chosen[f] = float(np.log(odds))
            for d, w in own:
                covered[d].add(w)
    return chosen


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_toxic: int = FIT_TOXIC, fit_clean: int = FIT_CLEAN) -> Lexicon:
    """The lexicon and score weights, learned from at most ``fit_toxic`` and ``fit_clean`` labelled rows outside the held-out third.

    The rows are those of smallest id hash. Near copies among them count once (two
    equal min-hashes, of three, of their longer words). Words, and beginnings that three words or more
    share, enter with their log odds as far as toxic rows need them (see ``_choose``). Rows without label, id or text are left out; an
    id may be of any type that has an order, one whose labels contradict counts as toxic. With fewer than 10 rows of either
    label the seed words and fixed score weights are used.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("toxic"))
    )
    order = F.xxhash64("__id")
    own_id = F.col(id_col) if isinstance(docs.schema[id_col].dataType, IntegralType) else F.xxhash64(F.col(id_col).cast("string"))  # only orders copies
    some = known.where("toxic = 1").orderBy(order).limit(fit_toxic).unionByName(known.where("toxic = 0").orderBy(order).limit(fit_clean))
    rows = docs.select(F.col(id_col).alias("id"), own_id.cast("long").alias("own_id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(some), F.col("id") == F.col("__id")).select(F.col("own_id").alias("id"), "text", "toxic")

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from zlib import crc32

        for pdf in batches:
            out = []
            for i, text, toxic in zip(pdf["id"], pdf["text"], pdf["toxic"], strict=True):
                own = sorted(set(fold(text).split()))
                rare = [w for w in own if len(w) >= 7] or own  # short words are common to unrelated texts
                h = np.array([crc32(w.encode()) for w in rare] or [int(i)], np.uint64)
                low = [int(((h * np.uint64(m)) & np.uint64(0xFFFFFFFF)).min()) for m in (2654435761, 2246822519, 3266489917)]
                out.append((int(i), int(toxic), *low, own))
            yield pd.DataFrame(out, columns=["id", "toxic", "m1", "m2", "m3", "words"])

    sample = rows.mapInPandas(words, "id long, toxic int, m1 long, m2 long, m3 long, words array<string>")
    for m in (("m1", "m2"), ("m1", "m3"), ("m2", "m3")):
        sample = sample.groupBy(*m).agg(F.min(F.struct("id", "toxic", "m1", "m2", "m3", "words")).alias("x")).select("x.*")
    sample = sample.persist()
    count = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = count.get(1, 0), count.get(0, 0)
    if min(n_toxic, n_clean) < 10:
        sample.unpersist()
        return seed_lexicon()
    least = max(3, round(0.004 * n_toxic))
    per_word = sample.select("toxic", F.explode("words").alias("w")).groupBy("w").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    whole = F.concat(F.lit(" "), F.col("w"), F.lit(" "))
    begins = [F.when(F.length("w") >= k, F.concat(F.lit(" "), F.substring("w", 1, k))) for k in PREFIXES]
    odds = ((F.col("t") + 0.5) / (n_toxic + 1)) / ((F.col("n") - F.col("t") + 0.5) / (n_clean + 1))
    found = (
        per_word.select("t", "n", F.explode(F.array(whole, *begins)).alias("f")).where("f is not null")
        .groupBy("f").agg(F.sum("t").alias("t"), F.sum("n").alias("n"), F.sum(F.when(F.col("t") > 0, 1).otherwise(0)).alias("kinds"))
        .withColumn("odds", odds)
        .where((F.col("t") >= least) & (F.col("odds") >= ODDS) & (F.col("f").endswith(" ") | (F.col("kinds") >= 3)) | F.col("f").isin(list(seed_lexicon().weights)))
        .select("f", "t", "n", "odds").collect()
    )
    seeds = seed_lexicon().weights
    weights = {p: w for p, w in seeds.items() if not any(r["f"] == p and r["odds"] < 10 and r["n"] - r["t"] > 3 for r in found)}
    base = n_toxic / (n_toxic + n_clean)
    candidates = [(r["f"], int(r["t"]), float(r["odds"])) for r in found if r["odds"] >= ODDS and _evidence(r["t"], r["n"], base) >= EVIDENCE]
    of_words = {f: t for f, t, _ in candidates if f.endswith(" ")}
    main = {}
    for f, t in of_words.items():
        for k in PREFIXES:
            main[f[: k + 1]] = max(t, main.get(f[: k + 1], 0))
    candidates = [c for c in candidates if c[0] in of_words or main.get(c[0], 0) < 0.8 * c[1]]  # a beginning that is one word in the main is that word
    known_patterns = {f for f, _, _ in candidates}

    def matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hit = lambda w: f" {w} " in known_patterns or any(f" {w[:k]}" in known_patterns for k in PREFIXES if len(w) >= k)
        for pdf in batches:
            yield pd.DataFrame({"w": [[w for w in words if hit(w)] for words in pdf["words"]]})

    toxic_docs = [list(r["w"]) for r in sample.where("toxic = 1").select("words").mapInPandas(matched, "w array<string>").collect()]
    weights |= _choose(candidates, toxic_docs, n_toxic)
    lexicon = Lexicon(weights)

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [lexicon.sums(fold(t)) for t in pdf["text"]]
            yield pd.DataFrame({"toxic": pdf["toxic"], "total": [g[0] for g in got], "words": [g[1] for g in got]})

    got = rows.select("text", "toxic").mapInPandas(totals, "toxic int, total double, words long").toPandas()
    sample.unpersist()
    return Lexicon(weights, EXCEPTIONS, _fit_score(got["total"].to_numpy(), got["words"].to_numpy(float), got["toxic"].to_numpy(float)))


def score(text: Column, lexicon: Lexicon) -> Column:
    """The score of each text, between 0 and 1; null and empty texts have that of a text without hits."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([lexicon.score(t) for t in texts], dtype="float64")

    return run(text)


def scored(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``(id, held_out, score, predicted)`` for every row of ``docs``; repeated rows each, extra columns unread, an empty table gives an empty result."""
    own = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    return own.select("id", held_out("id").alias("held_out"), score(F.col("text"), lexicon).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
