"""Raw corpora that need a join before they are claim files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions.tables import table_markdown
from factweave.functions.text import strip
from factweave.operators.records import kb_join


def abstracts(claims: DataFrame, corpus: DataFrame) -> DataFrame:
    """Claims with the title and abstract of their document as evidence; claims without a document are dropped."""
    docs = corpus.select(F.col("doc_id").cast("string").alias("__doc"), strip(F.concat("title", F.lit("\n\n"), F.array_join("abstract", " "))).alias("evidence"))
    own = claims.drop("evidence").where(F.col("evidence_doc_id").cast("string") != "")
    return own.join(docs, F.col("evidence_doc_id").cast("string") == F.col("__doc")).drop("__doc")


def passages(claims: DataFrame, pages: DataFrame, order: str = "ord") -> DataFrame:
    """Claims with the text of their page, the first page of each id; claims without are dropped."""
    return kb_join(claims, pages, "id", order)


def tables(rows: DataFrame, html: str = "table") -> DataFrame:
    """Rows with their HTML table as markdown in ``table_md``, once each."""
    return rows.withColumn("table_md", table_markdown(F.col(html)))


def labels(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.select(label).distinct()
