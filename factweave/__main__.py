"""One command per stage: ``python -m factweave STAGE --input IN --output OUT ...``; tables are Parquet."""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions.prompts import BASELINES, TASKS, render
from factweave.operators import aggregates, judgelog
from factweave.plans import curation
from factweave.sources import corpora, files
from factweave.streaming import judge_ingest

Stage = Callable[[SparkSession, argparse.Namespace, Callable[[str], DataFrame]], DataFrame | None]


def _load(spark: SparkSession, a: argparse.Namespace, table: Callable[[str], DataFrame]) -> DataFrame:
    return corpora.load_splits(spark, a.input, corpora.TRAIN_SPLITS if a.splits == "train" else corpora.TEST_SPLITS, table("kb") if a.kb else None)


def _select(spark: SparkSession, a: argparse.Namespace, table: Callable[[str], DataFrame]) -> DataFrame:
    return curation.selected(table("input"), table("vectors") if a.vectors else None, a.method, curation.Config(budget=a.budget))


def _dataset(spark: SparkSession, a: argparse.Namespace, table: Callable[[str], DataFrame]) -> DataFrame:
    """Valid rows of the judge's log files below ``--input``, of one subset."""
    task = next(t for t in TASKS if a.subset.startswith(t))
    fields = {f: F.col(f) for f in ("claim", "document", "question", "answer", "answers") if "{" + f + "}" in TASKS[task]}
    return judgelog.dataset(judgelog.gate(judgelog.read_logs(files.read_log_files(spark, a.input)), a.subset, a.judge, render(TASKS[task], **fields)), a.subset)


def _ingest(spark: SparkSession, a: argparse.Namespace, table: Callable[[str], DataFrame]) -> None:
    """Log files that are new below ``--input`` into the table ``--output``, from where ``--state`` says the last run ended."""
    if a.state is None:
        raise SystemExit("ingest needs --state")
    task = next(t for t in TASKS if a.subset.startswith(t))
    fields = {f: F.col(f) for f in ("claim", "document", "question", "answer", "answers") if "{" + f + "}" in TASKS[task]}
    query = judge_ingest.ingest(judge_ingest.log_stream(spark, a.input), a.output, a.state, a.subset, a.judge, render(TASKS[task], **fields))
    query.awaitTermination()
    print(f"{a.output}: {judge_ingest.rejects(query)}")


STAGES: dict[str, Stage] = {
    "load": _load,
    "rules": lambda s, a, t: curation.rules(t("input")),
    "entities": lambda s, a, t: curation.entities(t("input"), t("cache")),
    "scored": lambda s, a, t: curation.scored(t("input"), t("cache")),
    "semantic": lambda s, a, t: curation.semantic(t("input"), t("vectors"), t("tests")),
    "leaks": lambda s, a, t: curation.leak_counts(t("input"), t("vectors"), t("tests")),
    "decomposed": lambda s, a, t: curation.decomposed(t("input"), t("counts"), t("lists")),
    "select": _select,
    "augment": lambda s, a, t: curation.augmented(t("input"), t("pool")),
    "compare": lambda s, a, t: curation.comparison(t("input"), t("pool")),
    "report": lambda s, a, t: aggregates.removal_summary(t("before"), t("input")),
    "baseline": lambda s, a, t: t("input").withColumn("prompt", render(BASELINES[a.baseline], claim=F.col("claim"), evidence=F.col("evidence"))),
    "metrics": lambda s, a, t: aggregates.binary_metrics(t("input")),
    "dataset": _dataset,
    "ingest": _ingest,
}


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="factweave", description=__doc__)
    p.add_argument("stage", choices=STAGES)
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    for name in ("cache", "vectors", "tests", "counts", "lists", "pool", "before", "kb"):
        p.add_argument(f"--{name}", help="a Parquet table that the stage needs")
    p.add_argument("--splits", choices=("train", "test"), default="train")
    p.add_argument("--method", choices=("random", "kmeans", "facility", "farthest", "kdpp"), default="random")
    p.add_argument("--budget", type=int, default=curation.Config().budget)
    p.add_argument("--baseline", choices=BASELINES, default="simple")
    p.add_argument("--subset", choices=judgelog.SUBSETS, default="coverage")
    p.add_argument("--judge", default="judge", help="the judge model whose replies count")
    p.add_argument("--state", help="the folder that keeps the state of an ingest")
    p.add_argument("--force", action="store_true", help="write metrics again that are there")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"factweave {a.stage}").getOrCreate()

    def table(name: str) -> DataFrame:
        if getattr(a, name) is None:
            p.error(f"{a.stage} needs --{name}")
        return spark.read.parquet(getattr(a, name))

    out = STAGES[a.stage](spark, a, table)
    if out is None:  # the stage has written its table itself
        return
    if a.stage == "metrics":
        print(f"{a.output}: {'written' if files.write_metrics(out, a.output, a.force) else 'kept'}")
    else:
        files.write_stage(out, a.output)


if __name__ == "__main__":
    main()
