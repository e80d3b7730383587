"""Rule filters over claim records; each keeps rows, none needs a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.text import sentence_count, sha256_mod, word_count, word_set

#: Thresholds and the sources with thresholds of their own.
MIN_SENTENCES, MIN_TOKENS, MAX_TOKENS, MAX_PROMPT_TOKENS, MIN_ENTITIES = 3, 200, 10_000, 11_500, 2
MAX_RATIO, MIN_CORRECTNESS, MAX_CORRECTNESS = 0.15, 0.3, 0.8
TABLE_SOURCES = ("pubhealthtab", "scitab")
WIDE_RATIO = {"pubhealthtab": 0.8, "scitab": 0.8, "pubmedclaim": 0.8, "claimdecomp": 0.4, "healthver": 0.4, "uphill": 0.4, "matter_of_fact": 0.4, "feverous": 0.4}
LONG_TOKENS, MAX_WORDS = 3_000, 16_000


def enough_sentences(least: int = MIN_SENTENCES, exempt: tuple[str, ...] = TABLE_SOURCES) -> Column:
    return (sentence_count("evidence") >= least) | F.col("src").isin(*exempt)


def ratio_within(most: float = MAX_RATIO, by_source: dict[str, float] = WIDE_RATIO) -> Column:
    """Words of the claim per word of the evidence; evidence without words fails."""
    limit = F.coalesce(*[F.when(F.col("src") == s, v) for s, v in by_source.items()], F.lit(most)) if by_source else F.lit(most)
    n = word_count("evidence")
    return (n > 0) & (F.try_divide(word_count("claim"), n) <= limit)


def lexical_overlap() -> Column:
    """Share of the claim's words that the evidence holds (0 for a claim without words)."""
    claim, evidence = word_set("claim"), word_set("evidence")
    return F.coalesce(F.try_divide(F.size(F.array_intersect(claim, evidence)), F.size(claim)), F.lit(0.0))


def overlap_within(most: float = 1.0) -> Column:
    return F.lit(True) if most >= 1.0 else lexical_overlap() <= most


def tokens_within(tokens: Column | None = None, least: int = MIN_TOKENS, most: int = MAX_TOKENS) -> Column:
    """``tokens`` stands for a tokenizer's column; white-space words by default."""
    return (word_count("evidence") if tokens is None else tokens).between(least, most)


def with_prompt_tokens(df: DataFrame, prompt: Column, most: int = MAX_PROMPT_TOKENS, count: Callable[[Column], Column] = word_count) -> DataFrame:
    return df.withColumn("prompt_token_length", count(prompt)).where(F.col("prompt_token_length") < most)


def enough_entities(entities: Column | str = "all_entities", least: int = MIN_ENTITIES) -> Column:
    return F.size(entities) >= least


def correctness(prob: Column | str = "prob") -> Column:
    """The scorer's probability of the record's own label."""
    p = F.col(prob) if isinstance(prob, str) else prob
    return F.when(F.col("label") == "Supported", p).otherwise(1 - p)


def hard_enough(prob: Column | str = "prob", least: float = MIN_CORRECTNESS, most: float = MAX_CORRECTNESS) -> Column:
    return correctness(prob).between(least, most)


def complex_enough(least: int = 2) -> Column:
    return F.size("decomposed_questions") >= least


def is_supervised(rate: float, claim: str = "claim") -> Column:
    """Whether a claim's hash falls under the supervision rate."""
    if not 0 <= rate <= 1:
        raise ValueError("the supervision rate lies between 0 and 1")
    if rate in (0, 1):
        return F.lit(bool(rate))
    return sha256_mod(claim, 10_000) / F.lit(10_000.0) < rate


def token_histogram(df: DataFrame, tokens: Column, edges: list[float]) -> DataFrame:
    """Rows of each source by token bin; ``edges`` ascending, the last bin closed, values outside left out."""
    n = len(edges) - 1
    place = sum(((tokens >= e).cast("int") for e in edges[1:-1]), F.lit(0))
    return df.withColumn("bin", place).where(tokens.between(edges[0], edges[-1])).groupBy("src", "bin").agg(F.count(F.lit(1)).alias("n")).where(F.col("bin") < n)
