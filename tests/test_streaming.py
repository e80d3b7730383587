import json
import random

from pyspark.sql import functions as F

from factweave.__main__ import main
from factweave.functions.prompts import TASKS, render
from factweave.operators import judgelog
from factweave.sources import files
from factweave.streaming import judge_ingest

SUBSET = "question_answerable"


def prompt():
    return render(TASKS[SUBSET], document=F.col("document"), question=F.col("question"))


def write_logs(spark, root, count, rng, first=0):
    """Files of one log each; texts repeat within and over runs, with other labels, and some logs are not valid."""
    fields = [(k, f"doc {rng.randrange(12)}", f"question {rng.randrange(3)}", rng.choice(("0", "1", " 1\n", "maybe"))) for k in range(first, first + count)]
    df = spark.createDataFrame(fields, "k int, document string, question string, reply string").withColumn("prompt", prompt())
    for r in df.collect():
        folder = root / f"run{rng.randrange(4)}" / "cache"
        folder.mkdir(parents=True, exist_ok=True)
        body = {"judge_model_id": "judge" if r["k"] % 9 else "other", "prompt": r["prompt"], "document": r["document"], "question": r["question"], "extracted_response": r["reply"]}
        (folder / f"{rng.randrange(10**6):06d}-{r['k']}.json").write_text("{broken" if r["k"] % 14 == 3 else json.dumps(body))


def whole(spark, root):
    gated = judgelog.gate(judgelog.read_logs(files.read_log_files(spark, str(root))), SUBSET, "judge", prompt())
    return judgelog.dataset(gated, SUBSET), {r["status"]: r["n"] for r in judgelog.reject_counts(gated).collect()}


def test_three_arrivals_and_restarts_equal_one_batch(spark, tmp_path):
    rng = random.Random(4)
    root, table, state = tmp_path / "logs", str(tmp_path / "table"), str(tmp_path / "state")
    seen, written = {}, 0
    for k in range(3):
        write_logs(spark, root, 60, rng, 60 * k)
        query = judge_ingest.ingest(judge_ingest.log_stream(spark, str(root), files_per_batch=25), table, state, SUBSET, "judge", prompt())
        query.awaitTermination()
        assert query.exception() is None and len(query.recentProgress) >= 3
        for name, n in judge_ingest.rejects(query).items():
            seen[name] = seen.get(name, 0) + n
        want, counts = whole(spark, root)
        got = judge_ingest.current(spark, table)
        assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
        assert seen == counts
        rows, keys = spark.read.parquet(table).count(), want.count()
        assert query.recentProgress[-1].stateOperators[0].numRowsTotal == keys  # state by text, not by row
        assert written < rows < 2 * keys or rows == keys
        written = rows
    query = judge_ingest.ingest(judge_ingest.log_stream(spark, str(root)), table, state, SUBSET, "judge", prompt())
    query.awaitTermination()  # nothing new: nothing is written again
    assert spark.read.parquet(table).count() == written


def test_nothing_to_read(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    query = judge_ingest.ingest(judge_ingest.log_stream(spark, str(tmp_path / "logs")), str(tmp_path / "t"), str(tmp_path / "s"), SUBSET, "judge", prompt())
    query.awaitTermination()
    assert query.exception() is None and judge_ingest.rejects(query) == {}


def test_command(spark, tmp_path, capsys):
    root = tmp_path / "logs"
    for k in range(2):
        write_logs(spark, root, 30, random.Random(k), 30 * k)
        main(["ingest", "--input", str(root), "--output", str(tmp_path / "t"), "--state", str(tmp_path / "s"), "--subset", SUBSET], spark)
        assert "'ok'" in capsys.readouterr().out
    want, _ = whole(spark, root)
    assert sorted(map(tuple, judge_ingest.current(spark, str(tmp_path / "t")).select(want.columns).collect())) == sorted(map(tuple, want.collect()))
