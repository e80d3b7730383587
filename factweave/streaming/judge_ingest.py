"""Judge logs as a stream: files as they arrive, the first row of each text, an exactly-once Parquet table.

A text's state is the order key of its first row so far, so state grows with distinct
texts and not with rows. Files may arrive in any order: a row that comes in front
of the one already written is written too, and ``current`` reads of each text the first one. What it
reads therefore doesn't depend on how files were spread over batches, restarts included.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from factweave.operators import judgelog
from factweave.operators.dedup import first_wins

ORDER = ("source_run", "path")


def log_stream(spark: SparkSession, root: str, files_per_batch: int = 10_000) -> DataFrame:
    """New JSON files below ``root`` as ``raw``, with their path and the run that their folder names."""
    got = (
        spark.readStream.schema("value string").option("wholetext", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", files_per_batch).text(root)
    )
    path = F.col("_metadata.file_path")
    return got.select(F.col("value").alias("raw"), path.alias("path"), F.regexp_extract(path, r"/([^/]+)/[^/]+/[^/]+$", 1).alias("source_run"))


def _ranked(order: tuple[str, ...]):
    return lambda row: tuple((x is not None, x or "") for x in (getattr(row, c) for c in order))


def _first_so_far(columns: list[str], order: tuple[str, ...]):
    """Of a text's new rows the first, if it also comes in front of all earlier ones."""
    rank = _ranked(order)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, row = (tuple((x is not None, x or "") for x in state.get) if state.exists else None), None
        for pdf in batches:
            pdf = pdf.astype(object).where(pdf.notna(), None)
            for one in pdf.itertuples(index=False):
                own = rank(one)
                if best is None or own < best:
                    best, row = own, one
        if row is not None:
            state.update(tuple(x if has else None for has, x in best))
            yield pd.DataFrame([list(row)], columns=columns)

    return run


def first_rows(rows: DataFrame, key: str = "text_hash", order: tuple[str, ...] = ORDER) -> DataFrame:
    """The rows of a stream that come, by ``order`` (strings), in front of all earlier rows of their key; null keys are a key."""
    schema = rows.schema
    state = StructType([schema[c] for c in order])
    return rows.groupBy(key).applyInPandasWithState(_first_so_far(rows.columns, order), schema, state, "append", GroupStateTimeout.NoTimeout)


def ingest(logs: DataFrame, target: str, checkpoint: str, subset: str, judge: str, prompt: Column, full: bool = False, available_now: bool = True) -> StreamingQuery:
    """Start writing the valid rows of the stream ``logs(raw, path, source_run)`` to the Parquet table ``target``.

    ``checkpoint`` keeps what was read, the state and the commit log: a query started again with it
    goes on where the last one stopped, and no row is written twice. With
    ``available_now`` the query ends when it has read what is there. Counts of the reasons to
    reject rows are observed as ``rejects`` (see ``rejects``).
    """
    gated = judgelog.gate(judgelog.read_logs(logs), subset, judge, prompt, full)
    reasons = ("ok", "json_err", "wrong_judge_model", "missing_input", "prompt_mismatch", "unparseable_response", "missing_response")
    gated = gated.observe("rejects", *[F.count_if(F.col("status") == r).alias(r) for r in reasons])
    writer = first_rows(judgelog.dataset_rows(gated, subset, ORDER, full)).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start(target)


def rejects(query: StreamingQuery) -> dict[str, int]:
    """Rows by status over the batches that ``query`` still reports."""
    out: dict[str, int] = {}
    for p in query.recentProgress:
        seen = p.observedMetrics.get("rejects")
        for name, n in (seen.asDict() if seen is not None else {}).items():
            out[name] = out.get(name, 0) + n
    return {name: n for name, n in out.items() if n}


def current(spark: SparkSession, target: str, order: tuple[str, ...] = ORDER) -> DataFrame:
    """The table that ``ingest`` has written, of each text the first row."""
    return first_wins(spark.read.parquet(target), "text_hash", *order)
