"""Rewards of tagged generations.

A judge, embedder or classifier is a table of verdicts by prompt key (see
``providers``); rewards explode the questions, join the verdicts and aggregate
back. Keys are ``(prompt_id, gen_idx)``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.tags import qa_pairs, verification_reward
from factweave.functions.text import is_idk
from factweave.operators.aggregates import majority_vote
from factweave.operators.filters import is_supervised
from factweave.operators.selection import unit

KEY = ["prompt_id", "gen_idx"]


def question_count_reward(asked: Column, expected: Column) -> Column:
    """Rises to 1 at the expected number, falls to 0 at twice as many."""
    r = asked / F.greatest(expected, F.lit(1))
    return F.when(r <= 0, 0.0).when(r <= 1, r).when(r <= 2, 2 - r).otherwise(0.0)


def questions(df: DataFrame, generation: str = "generation") -> DataFrame:
    """A row for each question and answer of each generation."""
    return df.select(*KEY, F.explode(qa_pairs(generation)).alias("qa")).select(*KEY, "qa.*")


def per_generation(df: DataFrame, scored: DataFrame, score: str = "score") -> DataFrame:
    """Mean of the question scores (0 without questions) and the scores in order, for each generation of ``df``."""
    got = scored.groupBy(*KEY).agg(F.avg(score).alias("score"), F.array_sort(F.collect_list(F.struct("index", F.col(score).alias("s")))).alias("x"))
    return df.select(*KEY).join(got, KEY, "left").select(*KEY, F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce(F.transform("x", lambda x: x["s"]), F.array().cast("array<double>")).alias("per_q"))


def answerable_score(answer: Column, verdict: Column) -> Column:
    """1 where judge and answer agree on whether the document answers; an answer of not knowing is right if it doesn't. Missing verdicts score 0."""
    return F.when(verdict.isNull(), 0.0).when(is_idk(answer), (verdict == 0).cast("double")).otherwise((verdict == 1).cast("double"))


def correct_score(verdict: Column) -> Column:
    return F.coalesce((verdict == 1).cast("double"), F.lit(0.0))


def atomic_score(criteria: Column) -> Column:
    """Share of the five criteria that hold; missing ones don't."""
    return F.coalesce(F.aggregate(criteria, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))), F.lit(0)) / F.lit(5.0)


def joint_score(answer: Column, answerable: Column, criteria: Column, correct: Column) -> Column:
    """The product of the three; an answer of not knowing has no correctness."""
    return answerable_score(answer, answerable) * atomic_score(criteria) * F.when(is_idk(answer), 1.0).otherwise(correct_score(correct))


def leave_one_out(qa: DataFrame) -> DataFrame:
    """For each generation the whole answer list (``left_out`` 0) and each without one."""
    listed = qa.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "answer"))), lambda x: x["answer"]).alias("all"))
    without = F.transform(F.sequence(F.lit(0), F.size("all")), lambda k: F.struct(k.alias("left_out"), F.filter("all", lambda x, i: (k == 0) | (i + 1 != k)).alias("answers")))
    return listed.select(*KEY, F.size("all").alias("n"), F.explode(without).alias("x")).select(*KEY, "n", "x.*")


def necessity(verdicts: DataFrame, supervised: bool, aggregation: str = "mean") -> DataFrame:
    """How needed each answer is, from coverage verdicts on all answers (``left_out`` 0) and on each leave-one-out list.

    With truth: right to wrong 1, right to right 0.5, wrong to right -1, wrong to
    wrong 0; a single question scores its correctness. Without: 1 if the verdict
    changes; a single question scores 1.
    """
    full = verdicts.where("left_out = 0").select(*KEY, F.lower("verdict").alias("full"))
    rest = verdicts.where("left_out > 0").join(full, KEY)
    v = F.lower("verdict")
    if supervised:
        t = F.lower("truth")
        was, now = F.coalesce(F.col("full") == t, F.lit(False)), F.coalesce(v == t, F.lit(False))
        s = F.when(F.col("n") == 1, was.cast("double")).when(was & ~now, 1.0).when(was & now, 0.5).when(~was & now, -1.0).otherwise(0.0)
    else:
        s = F.when(F.col("n") == 1, 1.0).otherwise((~v.eqNullSafe(F.col("full"))).cast("double"))
    scored = rest.select(*KEY, "left_out", s.alias("s"))
    total = {"mean": F.avg, "min": F.min}[aggregation]("s")
    return scored.groupBy(*KEY).agg(total.alias("score"), F.transform(F.array_sort(F.collect_list(F.struct("left_out", "s"))), lambda x: x["s"]).alias("per_q"))


def coverage(df: DataFrame, verdict: str, truth: str, supervised: str) -> DataFrame:
    """1 where the verdict equals the truth or, for unsupervised prompts, the majority of the prompt's generations; missing verdicts score 0."""
    votes = majority_vote(df, ["prompt_id"], verdict)
    got = df.join(votes, "prompt_id", "left")
    target = F.when(F.col(supervised), F.lower(truth)).otherwise(F.lower("majority"))
    return got.select(*KEY, F.coalesce((F.lower(verdict) == target).cast("double"), F.lit(0.0)).alias("score"))


def check_groups(df: DataFrame, size: int) -> DataFrame:
    """Rows of prompts whose number of generations is wrong; a whole batch has none."""
    return df.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") % size != 0)


def _per_generation_numpy(df: DataFrame, vec: str, how, other: str | None = None) -> DataFrame:
    """``how`` on the question vectors of each generation; generations hold few questions."""
    cols = F.struct("index", F.col(vec).alias("v"), *([F.col(other).alias("o")] if other else []))
    listed = df.groupBy(*KEY).agg(F.array_sort(F.collect_list(cols)).alias("x"))
    vectors = F.transform("x", lambda x: x["v"])
    others = F.transform("x", lambda x: x["o"]) if other else vectors

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([how(np.stack([np.asarray(v, float) for v in x]), np.stack([np.asarray(v, float) for v in y])) for x, y in zip(a, b, strict=True)], dtype="float64")

    return listed.select(*KEY, run(vectors, others).alias("score"))


def margin_reward(df: DataFrame, query_vec: str, doc_vec: str) -> DataFrame:
    """Minus the mean, over questions, of the greatest product with an earlier question (0 for the first); -1 for one question or none."""

    def how(q: np.ndarray, d: np.ndarray) -> float:
        n = len(q)
        if n <= 1:
            return -1.0
        sim = q @ d.T
        return -sum(sim[i, :i].max() for i in range(1, n)) / n

    return _per_generation_numpy(df, query_vec, how, doc_vec)


def vendi_reward(df: DataFrame, vec: str) -> DataFrame:
    """Vendi score of the clamped cosine kernel over the number of questions; 0 for one question or none."""

    def how(v: np.ndarray, _: np.ndarray) -> float:
        n = len(v)
        if n <= 1:
            return 0.0
        x = unit(v)
        value = np.linalg.eigvalsh(np.clip(x @ x.T, -1, 1) / n)
        value = value[value > 1e-12]
        return float(np.exp(-(value * np.log(value)).sum()) / n)

    return _per_generation_numpy(df, vec, how)


def verification_rewards(df: DataFrame, rate: float, generation: str = "generation", truth: str = "label", claim: str = "claim") -> DataFrame:
    """``(score, predicted)`` of each generation: 1 if its verdict is the truth; 0 and ``unknown`` where the claim is not supervised or has no truth."""
    got = verification_reward(generation, truth)
    asked = F.coalesce(is_supervised(rate, claim), F.lit(False)) & F.col(truth).isNotNull()
    return df.select(*KEY, F.when(asked, got["score"]).otherwise(0.0).alias("score"), F.when(asked, got["label"]).otherwise("unknown").alias("predicted"))


#: The models that may judge, by the names they go by.
BACKENDS = {"llm": "llm-judge", "llm-judge": "llm-judge", "tiny": "tiny-judge", "tiny-judge": "tiny-judge"}


@dataclass(frozen=True)
class RewardConfig:
    """Which rewards a training step asks for; the form of a generation is always scored. Defaults are the fixed values of an empty environment."""

    necessity: bool = True
    joint_quality: bool = True
    diversity: str | None = "mmr"
    supervision_rate: float = 1.0
    question_count: bool = True
    coverage: bool = True
    aggregation: str = "mean"
    backend: str = "llm-judge"

    @classmethod
    def from_env(cls, env: dict[str, str]) -> RewardConfig:
        on = lambda name: env.get(name, "1") == "1"
        rate, backend = float(env.get("SUPERVISION_RATE", "1.0")), env.get("REWARD_BACKEND", "llm-judge").lower()
        if not 0 <= rate <= 1:
            raise ValueError("the supervision rate lies between 0 and 1")
        if backend not in BACKENDS:
            raise ValueError(f"unknown reward backend {backend}")
        kind = env.get("DIVERSITY_REWARD", "mmr") if on("DIVERSITY_REWARD_ENABLED") else None
        return cls(on("NECESSITY_SALIENCY_REWARD"), on("JOINT_QUALITY_REWARD"), kind, rate, on("GOOD_NUM_Q_REWARD"), on("COVERAGE_REWARD"), env.get("NECESSITY_AGGREGATION", "mean"), BACKENDS[backend])

    def names(self) -> list[str]:
        asked = (("format", True), ("necessity_saliency", self.necessity), ("joint_quality", self.joint_quality), ("diversity", self.diversity is not None), ("verification", self.supervision_rate > 0), ("good_num_q", self.question_count), ("coverage", self.coverage))
        return [n for n, on in asked if on]


def diversity_reward(df: DataFrame, config: RewardConfig, query_vec: str, doc_vec: str | None = None) -> DataFrame:
    """The diversity reward that ``config`` names: ``mmr`` the margin to earlier questions, else the Vendi score."""
    return margin_reward(df, query_vec, doc_vec or query_vec) if config.diversity == "mmr" else vendi_reward(df, query_vec)


def reward_table(df: DataFrame, config: RewardConfig, parts: dict[str, DataFrame]) -> DataFrame:
    """One column for each asked reward: those of ``parts`` by generation, 0 where a part has no row."""
    out = df.select(*KEY)
    for name in config.names():
        out = out.join(parts[name].select(*KEY, F.col("score").alias(name)), KEY, "left")
    return out.na.fill(0.0)


def eval_steps(rows: int, batch: int, epochs: int, evals: int = 30) -> int:
    """Steps between evaluations so that a run has about ``evals`` of them."""
    return max(1, max(1, rows // max(1, batch) * max(1, epochs)) // max(1, evals))
