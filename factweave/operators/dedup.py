"""Exact, lexical and greedy near-duplicate removal, and lexical decontamination."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.text import col, strip, words
from factweave.operators.components import components
from factweave.operators.records import first_by
from factweave.plans.checkpoint import cut, drop, free, stored

#: Fixed value: the Jaccard threshold.
THRESHOLD = 0.7
#: Counters of the sketch that orders words by how rare they are; their number bounds what the driver holds and sends.
COUNTERS = 1 << 20
#: Parts at most in which candidate pairs are formed; a part has about as many pairs as the lists have rows.
SLICES = 64
#: Slots of a row by which pairs are ruled out before their sets meet; a power of two.
BITS = 1024
#: Groups of links up to so many are walked in one task; larger ones take rounds over all links.
WALK = 200_000
#: Dense groups are thinned while their candidate pairs are so many times the rows, and rounds take a hundredth of the rows at least.
DENSE, FEW = 8, 0.01


def distinct_claims(df: DataFrame, claim: str = "claim") -> DataFrame:
    return df.select(claim).distinct()


def first_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key; null keys are a key."""
    return first_by(df, [key], *(order or ("ord",)))


def word_sets(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, h)``: the sorted 64-bit hashes of the lower-case words of each row."""
    return df.select(F.col(key).alias("key"), F.sort_array(F.array_distinct(F.transform(words(F.lower(col(text))), lambda w: F.xxhash64(w)))).alias("h"))


def rarity(sets: list[DataFrame], counters: int = COUNTERS) -> np.ndarray:
    """How many rows of the tables ``sets(key, h)`` hold a word of each slot (its hash modulo ``counters``); never less than a word of the slot has."""
    slot = lambda df: df.select(F.explode("h").alias("h")).select(F.pmod("h", F.lit(counters)).alias("slot"))
    held = slot(sets[0])
    for df in sets[1:]:
        held = held.unionByName(slot(df))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"slot": [pdf["slot"].to_numpy(np.int32).tobytes()], "n": [np.minimum(pdf["n"].to_numpy(np.int64), (1 << 31) - 1).astype(np.int32).tobytes()]})

    out = np.zeros(counters, np.int32)
    for r in held.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).mapInPandas(packed, "slot binary, n binary").collect():  # eight bytes for each counter
        out[np.frombuffer(r["slot"], np.int32)] = np.frombuffer(r["n"], np.int32)
    return out


def shortest(n: int, threshold: float) -> int:
    """How many of a set's rarest words a set of similarity ``threshold`` or more must share one of."""
    return n - int(np.ceil(round(threshold * n, 9))) + 1 if n else 0


def listed(sets: DataFrame, counts: np.ndarray, threshold: float) -> DataFrame:
    """``(key, n, heads, odd)`` of ``sets(key, h)``: the number of words, of the rarest ones ``(word, at)``, the words by which the row is listed, and which of ``BITS`` slots hold an odd number of words.

    Words are in one order for all rows, so of two sets of similarity ``threshold`` or more the first word that they share
    is among the first ``shortest`` of both. Which order it is only decides how long the lists are, so
    counts of slots do. Words that no other row holds are not listed. Empty sets have no words.
    """
    sent = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = sent.value
        for pdf in batches:
            size = pdf["h"].map(len).to_numpy(np.int64)
            flat = np.concatenate([*pdf["h"], np.empty(0, np.int64)]).astype(np.int64)
            n = held[flat % len(held)]  # of a negative hash the same as pmod
            owner = np.repeat(np.arange(len(pdf)), size)
            order = np.lexsort((flat, n, owner))
            flat, n = flat[order], n[order]
            ends = np.cumsum(size)
            heads = []
            for i, j in zip((ends - size).tolist(), ends.tolist(), strict=True):
                own = np.flatnonzero(n[i : i + shortest(j - i, threshold)] > 1)
                heads.append([{"word": w, "at": k} for w, k in zip(flat[i + own].tolist(), own.tolist(), strict=True)])
            odd = np.zeros((len(pdf), BITS), np.uint8)
            np.bitwise_xor.at(odd, (owner[order], flat >> 32 & (BITS - 1)), 1)
            yield pd.DataFrame({"key": pdf["key"], "n": size.astype(np.int32), "heads": heads, "odd": list(np.packbits(odd, axis=1).view(np.int64))})

    kind = sets.schema["key"].dataType.simpleString()
    return sets.where(F.size("h") > 0).mapInPandas(run, f"key {kind}, n int, heads array<struct<word: long, at: int>>, odd array<long>")


def heads(rows: DataFrame) -> DataFrame:
    """``(key, n, word, at)``: a row for each word by which a row is listed."""
    return rows.select("key", "n", F.explode("heads").alias("x")).select("key", "n", "x.word", "x.at")


def jaccard(a: str, b: str) -> Column:
    """Of two word sets."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def may_reach(threshold: float, na: str = "na", pa: str = "pa", nb: str = "nb", pb: str = "pb") -> Column:
    """Whether sizes and the places (from 0) of the first common word allow the threshold: the sets share that word and what is behind it at most."""
    na, pa, nb, pb = (F.col(c) for c in (na, pa, nb, pb))
    sizes = (na >= threshold * nb - 1e-9) & (nb >= threshold * na - 1e-9)
    return sizes & (F.least(na - pa, nb - pb) >= (na + nb) * (threshold / (1 + threshold)) - 1e-9)


def near(cand: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``cand(a, b)`` of listed rows whose slots allow the threshold: each slot that is odd in one row only has a word that the other lacks.

    Few pairs that don't reach it are left, so that few sets travel.
    """
    got = cand.join(left.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("odd").alias("oa")), "a")
    got = got.join(right.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("odd").alias("ob")), "b")
    differ = F.aggregate(F.zip_with("oa", "ob", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    both = F.col("na") + F.col("nb")
    return got.where((both - differ) / 2 >= both * (threshold / (1 + threshold)) - 1e-9).select("a", "b")


def near_in_slices(rows: DataFrame, threshold: float, slices: int) -> DataFrame:
    """``near`` of all candidates of one table, one slice of the words after the other: the candidates of a slice go before the next one's come."""
    found = None
    for at in range(slices):
        got = cut(near(candidates(rows, rows, threshold, True, slices, at), rows, rows, threshold))
        found = got if found is None else found.unionByName(got)
        free(rows.sparkSession)
    return found.distinct()


def verified(cand: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``(a, b, jaccard)`` of the candidate pairs ``cand(a, b)`` whose sets ``(key, h)`` reach the threshold."""
    got = cand.join(left.select(F.col("key").alias("a"), F.col("h").alias("wa")), "a").join(right.select(F.col("key").alias("b"), F.col("h").alias("wb")), "b")
    return got.select("a", "b", jaccard("wa", "wb").alias("jaccard")).where(F.col("jaccard") >= threshold)


def candidates(left: DataFrame, right: DataFrame, threshold: float, same: bool, slices: int = 1, at: int = 0) -> DataFrame:
    """``(a, b)``: pairs of listed rows that share a listed word and whose sizes and places allow the threshold; ``same``: ``a < b``.

    A pair passes at least at its first common word, where the bound holds for all that it shares. Long lists are split by the join.
    Of ``slices`` parts of the words only part ``at`` is joined.
    """
    first, second = (heads(df).where(F.pmod("word", F.lit(slices)) == at) for df in (left, right))
    cand = first.withColumnsRenamed({"key": "a", "n": "na", "at": "pa"}).join(second.withColumnsRenamed({"key": "b", "n": "nb", "at": "pb"}), "word")
    cand = cand.where(may_reach(threshold))
    return (cand.where("a < b") if same else cand).select("a", "b").distinct()


def jaccard_pairs(left: DataFrame, right: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """``(a, b, jaccard)`` of all word sets of two tables at the threshold or over it (words by 64-bit hashes).

    Sets are written once, since both sides of the joins read them.
    """
    own, other = stored(word_sets(left, key, text)), stored(word_sets(right, key, text))
    counts = rarity([own, other])
    first, second = (stored(listed(df, counts, threshold)) for df in (own, other))
    return verified(near(candidates(first, second, threshold, False), first, second, threshold), own, other, threshold)


def greedy_keep(nodes: DataFrame, pairs: DataFrame, key: str = "ord", walk: int = WALK) -> DataFrame:
    """Keys that a pass in key order keeps: those without a kept earlier partner in ``pairs(a, b)``, ``a < b``.

    Groups of connected keys are independent. A group of up to ``walk`` pairs is
    walked in order in one task. Larger groups take rounds: each keeps
    the undecided keys without an undecided earlier partner and removes the later
    partners of kept keys, which gives what the walk gives. A round decides at
    least the smallest open key, so the rounds end.
    """
    every = cut(pairs.select("a", "b").distinct())
    whole = every.count() <= walk  # then all pairs are one group to walk
    grouped = every.withColumn("component", F.lit(0)) if whole else cut(every.join(components(every).withColumnRenamed("node", "a"), "a"))
    sizes = grouped.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    large = sizes.where((F.col("size") > walk) & ~F.lit(whole)).select("component")
    kind = every.schema["b"].dataType.simpleString()

    def lost_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, gone = pdf.sort_values("a"), set()
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):  # all pairs (x, a) with x < a came before
            if a not in gone:
                gone.add(b)
        return pd.DataFrame({"lost": pd.Series(sorted(gone), dtype=pdf["b"].dtype)})

    lost = cut(grouped.join(large, "component", "left_anti").groupBy("component").applyInPandas(lost_of, f"lost {kind}"))
    open_pairs = cut(grouped.join(large, "component", "left_semi").select("a", "b"))
    most = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while not open_pairs.isEmpty():
        kept = open_pairs.select(F.col("a").alias("k")).distinct().join(open_pairs.select(F.col("b").alias("k")).distinct(), "k", "left_anti")
        gone = cut(open_pairs.join(kept, F.col("a") == F.col("k"), "left_semi").select(F.col("b").alias("lost")).distinct())
        lost = cut(lost.unionByName(gone).coalesce(most))  # else each round adds its own tasks to the next
        open_pairs = cut(
            open_pairs.join(gone.withColumnRenamed("lost", "g"), F.col("a") == F.col("g"), "left_anti")
            .join(gone.withColumnRenamed("lost", "g"), F.col("b") == F.col("g"), "left_anti")
        )
    return nodes.select(key).join(lost, F.col(key) == F.col("lost"), "left_anti")


def thinned(rows: DataFrame, sets: DataFrame, threshold: float, dense: int = DENSE, few: float = FEW) -> tuple[DataFrame, DataFrame, float]:
    """Keys that the pass drops because of the first of a dense group, and the listed rows ``rows`` that are still to be decided; ``sets(key, h)`` has their words.

    Last, how many pairs the lists hold for each of their rows, at most.

    A key that is the smallest of all lists it is in has no earlier partner, so it is kept,
    and it is compared with the members of its lists, one comparison a member instead
    of one a pair. This goes on while lists hold many times more pairs than rows. A round's tables go with the next round.
    """
    lost = cut(rows.select(F.col("key").alias("lost")).where("1 = 0"))
    left = rows
    while True:
        words = heads(left)
        low = words.groupBy("word").agg(F.min(F.struct("key", "n", "at")).alias("low"), F.count(F.lit(1)).alias("m")).where("m > 1")
        load = low.agg(F.sum(F.col("m").cast("double") * (F.col("m") - 1) / 2).alias("pairs"), F.sum("m").alias("rows")).first()
        share = load["pairs"] / load["rows"] if load["rows"] else 0.0
        if share <= dense:
            return lost, left, share
        shared = words.join(low.select("word", F.col("low.key").alias("a"), F.col("low.n").alias("na"), F.col("low.at").alias("pa")), "word")
        later = cut(shared.where("key > a").groupBy(F.col("key").alias("b"), "a").agg(F.max(may_reach(threshold, nb="n", pb="at")).alias("may")))
        free(rows.sparkSession)
        first = cut(low.select("low.key").distinct().join(later.select(F.col("b").alias("key")).distinct(), "key", "left_anti"))
        cand = later.where("may").join(first.select(F.col("key").alias("a")), "a", "left_semi").select("a", "b")
        gone = cut(verified(near(cand, left, left, threshold), sets, sets, threshold).select(F.col("b").alias("lost")).distinct())
        decided = gone.unionByName(first.select(F.col("key").alias("lost"))).distinct()
        old, left = left, stored(left.join(decided, F.col("key") == F.col("lost"), "left_anti"))
        lost = cut(lost.unionByName(gone))
        last = gone.count() < few * later.select("b").distinct().count()
        del words, low, shared, later, first, cand, gone, decided
        drop(old)
        if last:
            return lost, left, share


def jaccard_dedup(df: DataFrame, text: str = "claim", key: str = "ord", threshold: float = THRESHOLD) -> DataFrame:
    """Rows kept by a pass in key order that drops a row similar to a kept one. Rows with equal word sets keep the first; rows without words stay."""
    sets = stored(word_sets(df, key, text)).where(F.size("h") > 0)  # behind the write, else the filter works out each set once more
    marks = stored(sets.select("key", F.struct(F.size("h"), F.xxhash64("h"), F.hash("h")).alias("set")))
    firsts = stored(marks.groupBy("set").agg(F.min("key").alias("key")).select("key"))
    own = sets.join(firsts, "key", "left_semi")
    lost, left, share = thinned(stored(listed(own, rarity([own]), threshold)), sets, threshold)
    pairs = verified(near_in_slices(left, threshold, min(SLICES, int(share) + 1)), sets, sets, threshold)
    keep = stored(greedy_keep(firsts.join(lost, F.col("key") == F.col("lost"), "left_anti"), pairs, "key"))
    gone = stored(marks.select("key").join(keep, "key", "left_anti").withColumnRenamed("key", "__gone"))
    drop(sets)
    return df.join(gone, F.col(key) == F.col("__gone"), "left_anti")


def exact_decontaminate(df: DataFrame, refs: DataFrame, text: str, ref_text: str) -> DataFrame:
    """Rows whose stripped lower-case text is not among the references."""
    own, ref = F.lower(strip(text)), F.lower(strip(ref_text))
    return df.join(refs.select(ref.alias("__ref")).distinct(), own == F.col("__ref"), "left_anti")


def jaccard_decontaminate(df: DataFrame, refs: DataFrame, key: str, text: str, ref_key: str, ref_text: str, threshold: float = THRESHOLD) -> DataFrame:
    """Rows without a reference whose word set is similar."""
    hit = jaccard_pairs(df.select(key, text), refs.select(F.col(ref_key).alias(key), F.col(ref_text).alias(text)), key, text, threshold)
    return df.join(hit.select(F.col("a").alias(key)).distinct(), key, "left_anti")
