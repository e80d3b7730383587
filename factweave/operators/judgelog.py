"""Judge logs to a labelled dataset: validity gate, labels, texts, first-wins dedup, hash split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.functions.tags import CRITERIA, coverage_code, criteria
from factweave.functions.text import hash16, strip
from factweave.operators.dedup import first_wins
from factweave.operators.sampling import hash_split

SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("judge_model_id", "prompt", "claim", "document", "question", "answer", "answers", "extracted_response")]
    + [T.StructField("response", T.StructType([T.StructField("choices", T.ArrayType(T.StructType([T.StructField("message", T.StructType([T.StructField("content", T.StringType())]))])))]))]
)


@dataclass(frozen=True)
class Subset:
    """Needed inputs, label type and the field whose hash decides the split."""

    name: str
    inputs: tuple[str, ...]
    kind: str
    split_field: str


SUBSETS = {
    s.name: s
    for s in (
        Subset("atomicity_checklist", ("claim", "question"), "float", "claim"),
        *(Subset(f"atomicity_{c}", ("claim", "question"), "int", "claim") for c in CRITERIA),
        Subset("question_answerable", ("document", "question"), "int", "document"),
        Subset("answer_correctness", ("document", "question", "answer"), "int", "document"),
        Subset("coverage", ("claim", "answers"), "int", "claim"),
    )
}


def canonical_text(subset: str) -> Column:
    """The classifier's input of a log row."""
    part = lambda name, c: F.concat(F.lit(f"{name}: "), F.col(c))
    if subset == "coverage":
        return F.concat(part("Claim", "claim"), F.lit("\nAnswers:\n"), F.col("answers"))
    fields = SUBSETS[subset].inputs
    return F.concat_ws("\n", *[part(f.capitalize(), f) for f in fields])


def bulleted(answers: Column) -> Column:
    return F.array_join(F.transform(answers, lambda a: F.concat(F.lit("- "), a)), "\n")


def label(subset: str, c: str = "extracted_response") -> Column:
    """The label that a reply states; null if it doesn't."""
    text = F.when(F.col(c) != "", strip(c))
    if subset == "atomicity_checklist":
        return F.aggregate(criteria(text), F.lit(0), lambda a, x: a + x) / F.lit(5.0)
    if subset.startswith("atomicity_"):
        return F.get(criteria(text), F.lit(CRITERIA.index(subset.removeprefix("atomicity_"))))
    if subset == "coverage":
        return coverage_code(text)
    n = F.expr(f"try_cast(regexp_replace({c}, '^\\\\s+|\\\\s+$', '') AS INT)")
    return F.when(n.isin(0, 1), n)


def bin_atomicity(c: Column) -> Column:
    """The nearest of 0, 0.2, ... 1; of two equally near ones the lower. As its place from 0."""
    return F.array_position(F.transform(F.array(*[F.lit(k / 5) for k in range(6)]), lambda x: F.round(F.abs(x - c), 9)), F.array_min(F.transform(F.array(*[F.lit(k / 5) for k in range(6)]), lambda x: F.round(F.abs(x - c), 9)))).cast("int") - 1


def gate(logs: DataFrame, subset: str, judge: str, prompt: Column, full: bool = False) -> DataFrame:
    """``logs`` with ``status``: the first reason to reject a row, or ``ok``. Expects ``corrupt`` where JSON could not be read."""
    s = SUBSETS[subset]
    missing = F.lit(False)
    for f in s.inputs:
        missing = missing | F.coalesce(strip(f) == "", F.lit(True))
    status = (
        F.when(F.col("corrupt"), "json_err")
        .when(~F.col("judge_model_id").eqNullSafe(F.lit(judge)), "wrong_judge_model")
        .when(missing, "missing_input")
        .when(~F.col("prompt").eqNullSafe(prompt), "prompt_mismatch")
        .when(label(subset).isNull(), "unparseable_response")
    )
    if full:
        status = status.when(F.get(F.col("response.choices"), F.lit(0)).isNull(), "missing_response")
    return logs.withColumn("status", status.otherwise("ok"))


def read_logs(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Log rows from JSON strings; unreadable ones keep their other columns and are marked ``corrupt``."""
    parsed = F.from_json(raw, SCHEMA, {"mode": "PERMISSIVE"})
    got = df.withColumn("corrupt", F.expr(f"try_parse_json({raw}) IS NULL"))
    # A generator is a barrier: each string is parsed once, however many columns later expressions use.
    return got.select(*[c for c in df.columns if c != raw], "corrupt", F.inline(F.array(parsed)))


def dataset_rows(gated: DataFrame, subset: str, order: tuple[str, ...] = ("source_run", "path"), full: bool = False) -> DataFrame:
    """Valid rows as dataset rows with their split."""
    s = SUBSETS[subset]
    text = canonical_text(subset)
    more = [F.col("prompt"), F.coalesce(F.get(F.col("response.choices"), F.lit(0))["message"]["content"], F.lit("")).alias("raw_response")] if full else []
    return gated.where("status = 'ok'").select(
        text.alias("text"), label(subset).cast(s.kind).alias("label"), hash16(text).alias("text_hash"), hash16(s.split_field).alias("claim_hash"), "extracted_response", *order, *more, hash_split(s.split_field).alias("split")
    )


def dataset(gated: DataFrame, subset: str, order: tuple[str, ...] = ("source_run", "path"), full: bool = False) -> DataFrame:
    """Valid rows as dataset rows with their split; of equal texts the first."""
    return first_wins(dataset_rows(gated, subset, order, full), "text_hash", *order)


def reject_counts(gated: DataFrame) -> DataFrame:
    return gated.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def task_datasets(splits: dict[str, DataFrame], subset: str, train: str = "train", limit: int | None = None, eval_limit: int | None = None) -> dict[str, DataFrame]:
    """``train``, ``validation``, ``test`` and ``test_balanced`` of a task's splits; ``train`` names the split to train on.

    ``limit`` and ``eval_limit`` cap rows (in the order of the text hash) if they are set. The
    share of criteria becomes one of six classes.
    """
    named = {"train": train, "validation": "validation", "test": "test", "test_balanced": "test_balanced"}
    out = {}
    for name, split in named.items():
        most = limit if name == "train" else eval_limit
        df = splits[split].orderBy("text_hash").limit(most) if most else splits[split]
        out[name] = df.withColumn("label", bin_atomicity(F.col("label").cast("double"))) if subset == "atomicity_checklist" else df
    return out
