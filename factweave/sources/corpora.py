"""Readers of the fact-checking corpora, each into claim records.

Corpora that live on a hub are read from a local Parquet copy. A corpus is a
declaration: file format, label map, and the columns or expressions of claim and evidence.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions.tables import python_list
from factweave.functions.text import col, word_count
from factweave.operators.filters import MAX_WORDS
from factweave.operators.records import REFUTED, SUPPORTED, claim_records, entity_evidence, map_evidence, markdown_table, parallel_evidence, section_evidence, with_order
from factweave.sources.files import read

S, R = SUPPORTED, REFUTED


def _labels(supported: tuple, refuted: tuple) -> dict:
    return dict.fromkeys(supported, S) | dict.fromkeys(refuted, R)


@dataclass(frozen=True)
class Corpus:
    """``labels`` None: the label's truth value decides. ``file``: where a split lies below the data folder."""

    name: str
    format: str
    labels: dict | None
    claim: str = "claim"
    label: str = "label"
    evidence: Callable[[], Column] = lambda: F.col("evidence")
    keep: Callable[[], Column] | None = None
    prepare: Callable[[DataFrame, DataFrame | None], DataFrame] | None = None
    file: str = "{name}/{split}.{format}"

    def path(self, root: str, split: str) -> str:
        return f"{root}/{self.file.format(name=self.name, split=split, format=self.format)}"


def _scitab() -> Column:
    return F.concat(F.trim("table_caption"), markdown_table("table_column_names", "table_content_values"), F.lit("\n\n"))


def _lines(c: str) -> Callable[[], Column]:
    return lambda: F.array_join(c, "\n")


def _with_pages(df: DataFrame, kb: DataFrame | None) -> DataFrame:
    """Entities of three list-literal columns, looked up in the knowledge base ``id, text``."""
    names = ("golden entity", "mention", "result entity")
    staged = df.withColumn("__row", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])).withColumn("__entities", F.concat(*[python_list(F.col(f"`{c}`")) for c in names]))
    once = entity_evidence(staged.select("__row", "__entities").dropDuplicates(["__row"]), kb, "__row", "__entities", "id", "text")  # rows that repeat share their evidence
    return staged.join(once.select("__row", "evidence"), "__row", "left").drop("__row", "__entities")


#: Files, labels and fields of each corpus; rows with other labels are dropped.
CORPORA = {
    c.name: c
    for c in (
        Corpus("pubmedclaim", "parquet", _labels(("yes",), ("no",)), label="final_decision", evidence=lambda: parallel_evidence("context.labels", "context.contexts")),
        Corpus("claimdecomp", "jsonl", _labels(("true",), ("barely-true", "false", "pants-fire")), evidence=lambda: F.col("justification")),
        Corpus("wice", "jsonl", _labels(("supported",), ("not_supported",)), evidence=_lines("evidence"), file="wice/entailment_retrieval/claim/{split}.jsonl"),
        Corpus("scifact", "jsonl", _labels(("SUPPORT",), ("CONTRADICT",)), label="evidence_label"),
        Corpus("matter_of_fact", "json", None, claim="claim_text", label="gold_label", evidence=_lines("metadata.supporting_facts_from_paper")),
        Corpus("ex_fever", "csv", _labels(("SUPPORT",), ("REFUTE",)), prepare=_with_pages),
        Corpus("healthver", "csv", _labels(("Supports",), ("Refutes",))),
        Corpus("pubhealthfact", "jsonl", _labels(("0",), ("1",)), evidence=lambda: F.col("main_text"), file="pubhealth/{split}.jsonl"),
        Corpus("fever", "tsv", _labels(("entailment",), ("not_entailment",)), claim="sent2", evidence=lambda: F.col("sent1")),
        Corpus("covidfact", "tsv", _labels(("entailment",), ("not_entailment",)), claim="sent2", evidence=lambda: F.col("sent1")),
        Corpus("fool_me_twice", "jsonl", _labels(("SUPPORTS",), ("REFUTES",)), claim="text", evidence=lambda: section_evidence("retrieved_evidence", "section_header", "text")),
        Corpus("coverbench", "parquet", None, evidence=lambda: F.col("context"), keep=lambda: word_count("context") <= MAX_WORDS),
        Corpus("llmaggrefact", "parquet", _labels(("1",), ("0",)), evidence=lambda: F.col("doc")),
        Corpus("pubhealthtab", "jsonl", _labels(("SUPPORTS",), ("REFUTES",))),
        Corpus("faviq_a_set", "jsonl", _labels(("SUPPORTS",), ("REFUTES",)), file="faviq/{split}_with_evidence.jsonl"),
        Corpus("faviq_r_set", "jsonl", _labels(("SUPPORTS",), ("REFUTES",)), file="faviq/{split}_with_evidence.jsonl"),
        Corpus("snopes", "csv", _labels(("True",), ("False",)), label="rate", evidence=lambda: F.col("origin")),
        Corpus("uphill", "jsonl", _labels(("true",), ("false",)), label="claim_veracity", evidence=lambda: F.col("main_text")),
        Corpus("ambifc", "jsonl", _labels(("supporting",), ("refuting",)), label="labels.passage", evidence=lambda: map_evidence("sentences")),
        Corpus("hover", "json", _labels(("supports",), ("refutes",))),
        Corpus("feverous", "json", _labels(("supports",), ("refutes",))),
        Corpus("scitab", "json", _labels(("supports",), ("refutes",)), evidence=_scitab),
    )
}

#: The splits of each corpus that are read for training and for tests.
TRAIN_SPLITS = {
    "fool_me_twice": ("train", "dev"), "pubmedclaim": ("val",), "claimdecomp": ("train", "dev"), "wice": ("train", "dev"), "scifact": ("train", "validation"), "ex_fever": ("train", "dev"),
    "pubhealthfact": ("train", "validation"), "pubhealthtab": ("train_md", "dev_md"), "faviq_a_set": ("a_set/train",), "ambifc": ("train.certain", "dev.certain"), "hover": ("train",), "feverous": ("train",), "scitab": ("train",),
}
TEST_SPLITS = {
    "fool_me_twice": ("test",), "pubmedclaim": ("test",), "claimdecomp": ("test",), "wice": ("test",), "matter_of_fact": ("test",), "fever": ("test",), "ex_fever": ("test",), "pubhealthfact": ("test",), "healthver": ("test",),
    "covidfact": ("test",), "coverbench": ("eval",), "llmaggrefact": ("test",), "pubhealthtab": ("test_md",), "faviq_a_set": ("a_set/dev",), "faviq_r_set": ("r_set/test",), "ambifc": ("test.certain", "test.uncertain"), "hover": ("dev",), "feverous": ("dev",),
}
#: Fields that inference reads otherwise: maps look like structs.
SCHEMAS = {"ambifc": "claim string, labels struct<passage: string>, sentences map<string, string>"}


def load(spark: SparkSession, name: str, path: str, kb: DataFrame | None = None, schema: str | None = None) -> DataFrame:
    """A file of a corpus as claim records with ``ord``; rows are numbered by the hash of all their columns, so a rerun numbers alike."""
    return normalize(read(spark, CORPORA[name].format, path, schema or SCHEMAS.get(name)), name, kb)


def load_splits(spark: SparkSession, root: str, splits: dict[str, tuple[str, ...]], kb: DataFrame | None = None) -> DataFrame:
    """All splits of ``splits`` below the folder ``root`` as claim records, with the corpus and split that each came from; ids differ between splits.

    ``kb(id, text)`` holds the pages that ``ex_fever`` names.
    """
    parts = []
    for name, names in splits.items():
        for split in names:
            got = load(spark, name, CORPORA[name].path(root, split), kb)
            parts.append(got.withColumn("id", F.sha2(F.concat_ws("|", "id", F.lit(split)), 256)).withColumns({"dataset": F.lit(name), "split": F.lit(split)}))
    return reduce(DataFrame.unionByName, parts)


def normalize(df: DataFrame, name: str, kb: DataFrame | None = None, numbered: bool = True) -> DataFrame:
    """Rows of a corpus as claim records. Numbering writes all rows; without it the hash of a row stands for its number."""
    c = CORPORA[name]
    if c.prepare is not None:
        df = c.prepare(df, kb)
    if c.keep is not None:
        df = df.where(c.keep())
    whole = F.to_json(F.struct(*[F.col(f"`{x}`") for x in df.columns]))
    staged = with_order(df.withColumn("__h", F.xxhash64(whole)), "__h") if numbered else df
    return claim_records(staged, c.name, F.col(c.claim), c.evidence(), col(c.label), c.labels, whole, F.col("ord") if numbered else F.xxhash64(whole))


def collect(parts: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All records, and their counts by source and label."""
    whole = reduce(DataFrame.unionByName, parts)
    return whole, whole.groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))
