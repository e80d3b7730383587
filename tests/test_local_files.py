import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.sources import local_files


@pytest.fixture(scope="module")
def kb(spark, tmp_path_factory):
    local_files.register(spark)
    folder = tmp_path_factory.mktemp("kb")
    for part in range(2):
        with sqlite3.connect(folder / f"kb{part}.db") as db:
            db.execute('CREATE TABLE "documents" (id TEXT, text TEXT, size INTEGER, score REAL)')
            db.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [(f"doc {part} {k}" if k % 10 else None, f"text, {k}", k, k / 4) for k in range(250)])
            db.execute("CREATE TABLE plain (k TEXT PRIMARY KEY, v INTEGER) WITHOUT ROWID")
            db.executemany("INSERT INTO plain VALUES (?, ?)", [(f"{part}{k}", k) for k in range(5)])
    return folder


def test_sqlite_in_parts(spark, kb):
    df = spark.read.format("sqlite").option("path", str(kb)).option("table", "documents").option("rows", 60).load()
    assert df.dtypes == [("id", "string"), ("text", "string"), ("size", "bigint"), ("score", "double")]
    assert df.rdd.getNumPartitions() == 10 and df.count() == 500
    assert {tuple(r) for r in df.collect()} == {(f"doc {p} {k}" if k % 10 else None, f"text, {k}", k, k / 4) for p in range(2) for k in range(250)}
    one = spark.read.format("sqlite").option("path", str(kb / "kb1.db")).option("table", "plain").load()
    assert sorted(map(tuple, one.collect())) == [(f"1{k}", k) for k in range(5)]


def test_sqlite_answers_filters(spark, kb):
    reader = local_files.FilteredSqlite({"path": str(kb), "table": "documents", "rows": 100}, local_files.SqliteSource({"path": str(kb), "table": "documents"}).schema())
    left = list(reader.pushFilters([local_files.EqualTo(("id",), "doc 1 7"), local_files.GreaterThan(("size",), 3), local_files.StringStartsWith(("text",), "t"), local_files.EqualTo(("size",), "x")]))
    assert len(left) == 2 and reader.where == ['"id" = ?', '"size" > ?']
    got = [b.to_pylist() for p in reader.partitions() for b in reader.read(p)]
    assert [r["id"] for rows in got for r in rows] == ["doc 1 7"]  # nothing else leaves the file
    df = spark.read.format("sqlite").option("path", str(kb)).option("table", "documents").load()
    pushed = lambda condition: local_files.lookup(spark, "sqlite", condition, path=str(kb), table="documents")
    assert "Filter " not in pushed("id = 'doc 1 7'")._jdf.queryExecution().executedPlan().toString()
    for condition in ("id = 'doc 1 7'", "id IN ('doc 0 3', 'doc 1 9', 'none')", "id IS NULL AND size >= 100", "size BETWEEN 10 AND 20 AND score < 4.5", "text LIKE 'text, 1%'", "id <=> 'doc 0 1'", "NOT id = 'doc 0 1'", "upper(id) = 'DOC 0 3'"):
        rows = [(f"doc {p} {k}" if k % 10 else None, f"text, {k}", k, k / 4) for p in range(2) for k in range(250)]
        want = spark.createDataFrame(rows, df.schema).where(condition)
        for got in (df.where(condition), pushed(condition)):
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), condition
        assert df.count() == 500
    entities = spark.createDataFrame([("doc 0 3",), ("doc 1 4",)], "id string")
    assert sorted(r["text"] for r in entities.join(df, "id").collect()) == ["text, 3", "text, 4"]


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_npz_in_slabs(spark, tmp_path, save):
    local_files.register(spark)
    rng = np.random.default_rng(2)
    ids, vectors, n = np.array([f"claim {k} é" for k in range(330)]), rng.standard_normal((330, 6)).astype(np.float32), np.arange(330)
    save(tmp_path / "a.npz", ids=ids, embeddings=vectors, n=n)
    df = spark.read.format("npz").option("path", str(tmp_path)).option("rows", 100).load()
    assert df.dtypes == [("ids", "string"), ("embeddings", "array<float>"), ("n", "bigint")] and df.rdd.getNumPartitions() == 4
    got = {r["ids"]: (np.array(r["embeddings"], np.float32), r["n"]) for r in df.collect()}
    assert len(got) == 330 and all((got[i][0] == v).all() and got[i][1] == k for k, (i, v) in enumerate(zip(ids.tolist(), vectors, strict=True)))
    for condition in ("ids = 'claim 7 é'", "n > 320 OR n < 3", "n >= 325", "n IN (1, 205, 999)", "ids LIKE 'claim 32%'", "n % 100 = 7"):
        want = spark.createDataFrame([(i, k) for k, i in enumerate(ids.tolist())], "ids string, n long").where(condition).count()
        pushed = local_files.lookup(spark, "npz", condition, path=str(tmp_path), rows=100)
        assert df.where(condition).count() == pushed.count() == want, condition
    reader = local_files.FilteredNpz({"path": str(tmp_path), "rows": 100}, local_files.NpzSource({"path": str(tmp_path)}).schema())
    assert not list(reader.pushFilters([local_files.EqualTo(("ids",), "claim 207 é")]))
    assert [b.num_rows for p in reader.partitions() for b in reader.read(p)] == [1]


def test_files_that_are_no_tables(spark, tmp_path):
    np.savez(tmp_path / "a.npz", a=np.zeros(3), b=np.zeros(4))
    for options, error in (({"path": str(tmp_path)}, "different lengths"), ({"path": "hdfs://x/y"}, "every executor"), ({"path": str(tmp_path / "none")}, "none")):
        with pytest.raises((ValueError, FileNotFoundError), match=error):
            local_files.NpzSource(options).schema()


def test_parts_written_and_read(spark, tmp_path):
    local_files.register(spark)
    df = spark.range(100).select(F.when(F.col("id") % 9 > 0, F.concat(F.lit("k"), F.col("id").cast("string"))).alias("name"), "id", (F.col("id") / 8).alias("x")).repartition(3)
    assert local_files.write_sqlite_parts(df, str(tmp_path / "db"), "t") == 100
    got = spark.read.format("sqlite").option("path", str(tmp_path / "db")).option("table", "t").load()
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    arrays = df.select("id", F.array("x", F.col("x") * 2).alias("v"))
    assert local_files.write_npz_parts(arrays, str(tmp_path / "npz")) == 100
    got = spark.read.format("npz").option("path", str(tmp_path / "npz")).load()
    assert sorted(map(str, got.select("id", "v").collect())) == sorted(map(str, arrays.collect()))
