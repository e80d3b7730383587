"""sqlite databases and numpy archives as tables, through Spark's Python data source API.

``spark.dataSource.register(SqliteSource)`` and ``NpzSource`` make the formats ``sqlite`` and ``npz``
known (``register`` does both). A path is a file, a folder or a pattern that every executor can open: such
files need a file system that is mounted everywhere. A file is read in parts (ranges of
row ids; slabs of the arrays). With the option ``pushdown`` filters that the file can answer never reach Spark.
Spark keeps the filters that a DataFrame has pushed down for later queries over the same DataFrame, so
a table with that option serves one query; ``lookup`` makes a new one for each.
"""

from __future__ import annotations

import glob
import os
import sqlite3
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema

BATCH = 10_000
COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("sqlite")`` and ``("npz")`` known, with filters pushed down."""
    spark.dataSource.register(SqliteSource)
    spark.dataSource.register(NpzSource)
    spark.conf.set(PUSHDOWN, "true")


def lookup(spark: SparkSession, kind: str, condition: str | Column, **options: str | int) -> DataFrame:
    """The rows of a ``sqlite`` or ``npz`` table where ``condition`` holds, with what the files can answer of it pushed down."""
    return spark.read.format(kind).options(**options, pushdown="true").load().where(condition)


def local_files(path: str, ending: tuple[str, ...]) -> list[str]:
    """The files that ``path`` names, in order; a folder stands for those in it with one of the endings."""
    parts = urlsplit(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{path}: only files that every executor can open are read")
    path = parts.path if parts.scheme else path
    if os.path.isdir(path):
        found = [os.path.join(path, f) for f in os.listdir(path) if f.endswith(ending) and not f.startswith((".", "_"))]
    else:
        found = glob.glob(path)
    if not found:
        raise FileNotFoundError(path)
    return sorted(found)


def _batches(columns: list[list], schema: T.StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(schema), strict=True)], schema=to_arrow_schema(schema))


# ---- sqlite


@dataclass
class RowRange(InputPartition):
    """Rows of a file with ids from ``low`` to below ``high``; all rows if the table has no row ids."""

    file: str
    low: int | None
    high: int | None


def _connect(file: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(file)}?mode=ro", uri=True)


def _named(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _affinity(declared: str) -> T.DataType:
    """The Spark type of a declared type, by sqlite's rules of affinity."""
    kind = declared.upper()
    if "INT" in kind:
        return T.LongType()
    if any(x in kind for x in ("CHAR", "CLOB", "TEXT")):
        return T.StringType()
    if "BLOB" in kind or not kind:
        return T.BinaryType()
    return T.DoubleType()


class SqliteSource(DataSource):
    """A table of one or several databases. Options: ``path``, ``table``, ``rows`` (rows of a part, 100,000)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        with _connect(local_files(self.options["path"], (".db", ".sqlite"))[0]) as db:
            columns = db.execute(f"PRAGMA table_info({_named(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']}")
        return T.StructType([T.StructField(name, _affinity(kind)) for _, name, kind, *_ in columns])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return (FilteredSqlite if str(self.options.get("pushdown", "")).lower() == "true" else SqliteReader)(self.options, schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.path, self.table, self.rows, self.schema = options["path"], options["table"], int(options.get("rows", 100_000)), schema
        self.where: list[str] = []
        self.values: list = []

    def partitions(self) -> list[RowRange]:
        out = []
        for file in local_files(self.path, (".db", ".sqlite")):
            with _connect(file) as db:
                try:
                    low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_named(self.table)}").fetchone()
                except sqlite3.OperationalError as e:
                    if "rowid" not in str(e):
                        raise
                    out.append(RowRange(file, None, None))
                    continue
            if low is not None:
                out += [RowRange(file, at, at + self.rows) for at in range(low, high + 1, self.rows)]
        return out

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        where, values = list(self.where), list(self.values)
        if partition.low is not None:
            where.append("rowid >= ? AND rowid < ?")
            values += [partition.low, partition.high]
        text = f"SELECT {', '.join(map(_named, self.schema.names))} FROM {_named(self.table)}" + (f" WHERE {' AND '.join(where)}" if where else "")
        with _connect(partition.file) as db:
            found = db.execute(text, values)
            while rows := found.fetchmany(BATCH):
                yield _batches([list(c) for c in zip(*rows, strict=True)], self.schema)


class FilteredSqlite(SqliteReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons with values of the column's own type, membership, null tests; what is left goes to Spark."""
        for f in filters:
            column = self.schema[f.attribute[0]] if len(getattr(f, "attribute", ())) == 1 and f.attribute[0] in self.schema.names else None
            own = {T.LongType: int, T.DoubleType: (int, float), T.StringType: str}.get(type(column.dataType)) if column is not None else None
            fits = lambda v: own is not None and isinstance(v, own) and not isinstance(v, bool)  # noqa: B023, E731
            if isinstance(f, (IsNull, IsNotNull)) and column is not None:
                self.where.append(f"{_named(column.name)} IS {'NOT ' * isinstance(f, IsNotNull)}NULL")
            elif type(f) in COMPARED and fits(f.value) or isinstance(f, EqualNullSafe) and fits(f.value):
                self.where.append(f"{_named(column.name)} {COMPARED.get(type(f), '=')} ?")
                self.values.append(f.value)
            elif isinstance(f, In) and f.value and all(fits(v) for v in f.value) and len(f.value) < 500:
                self.where.append(f"{_named(column.name)} IN ({', '.join('?' * len(f.value))})")
                self.values += f.value
            else:
                yield f


# ---- numpy archives


@dataclass
class Slab(InputPartition):
    file: str
    low: int
    high: int


def _header(f) -> tuple[tuple[int, ...], bool, np.dtype]:
    version = np.lib.format.read_magic(f)
    return np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)


def _arrays(file: str) -> dict[str, tuple[tuple[int, ...], np.dtype]]:
    """Shape and type of each array, from the headers alone."""
    out = {}
    with zipfile.ZipFile(file) as z:
        for name in z.namelist():
            with z.open(name) as f:
                shape, by_column, kind = _header(f)
            if kind.hasobject or by_column and len(shape) > 1 or len(shape) not in (1, 2):
                raise ValueError(f"{file}: {name} is no array of one or two dimensions in row order")
            out[name.removesuffix(".npy")] = (shape, kind)
    if len({shape[0] for shape, _ in out.values()}) > 1:
        raise ValueError(f"{file}: the arrays are of different lengths")
    return out


def _slab(file: str, name: str, low: int, high: int) -> np.ndarray:
    """Rows of an array. What is stored as it is, is read from its place; a compressed array is unpacked up to there, a buffer at a time."""
    with zipfile.ZipFile(file) as z, z.open(f"{name}.npy") as f:
        shape, _, kind = _header(f)
        width = kind.itemsize * int(np.prod(shape[1:], dtype=np.int64))
        f.seek(f.tell() + low * width)
        return np.frombuffer(f.read((high - low) * width), kind).reshape(high - low, *shape[1:])


class NpzSource(DataSource):
    """Arrays of one length as columns; rows of a matrix are array values. Options: ``path``, ``rows`` (rows of a part, 10,000)."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> T.StructType:
        fields = []
        for name, (shape, kind) in _arrays(local_files(self.options["path"], (".npz",))[0]).items():
            own = {"U": T.StringType(), "S": T.BinaryType(), "b": T.BooleanType(), "i": T.LongType(), "u": T.LongType()}.get(kind.kind)
            own = own or (T.FloatType() if kind == np.float32 else T.DoubleType())
            fields.append(T.StructField(name, T.ArrayType(own) if len(shape) == 2 else own))
        return T.StructType(fields)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return (FilteredNpz if str(self.options.get("pushdown", "")).lower() == "true" else NpzReader)(self.options, schema)


class NpzReader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.path, self.rows, self.schema = options["path"], int(options.get("rows", 10_000)), schema
        self.tests: list[tuple[str, str, list]] = []

    def partitions(self) -> list[Slab]:
        out = []
        for file in local_files(self.path, (".npz",)):
            n = next(iter(_arrays(file).values()))[0][0]
            out += [Slab(file, at, min(n, at + self.rows)) for at in range(0, n, self.rows)]
        return out

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        keep = np.ones(partition.high - partition.low, bool)
        for name, how, values in self.tests:
            x = _slab(partition.file, name, partition.low, partition.high)
            if how == "in":
                keep &= np.isin(x, np.array(values))
            elif how == "starts":
                keep &= np.char.startswith(x, values[0])
            else:
                keep &= {"=": np.equal, ">": np.greater, ">=": np.greater_equal, "<": np.less, "<=": np.less_equal}[how](x, np.array(values[0]))
        if not keep.any():
            return
        columns = [_slab(partition.file, f.name, partition.low, partition.high)[keep].tolist() for f in self.schema]
        for at in range(0, len(columns[0]), BATCH):
            yield _batches([c[at : at + BATCH] for c in columns], self.schema)


class FilteredNpz(NpzReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons and membership of plain columns: of a slab only the rows that pass are read from the other arrays."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            plain = name in self.schema.names and isinstance(self.schema[name].dataType, (T.StringType, T.LongType))
            if plain and isinstance(f, IsNotNull):
                continue  # an array has no nulls
            if plain and type(f) in COMPARED and f.value is not None:
                self.tests.append((name, COMPARED[type(f)], [f.value]))
            elif plain and isinstance(f, In) and all(v is not None for v in f.value):
                self.tests.append((name, "in", list(f.value)))
            elif plain and isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", [f.value]))
            else:
                yield f


# ---- parts


def _part_file(folder: str, ending: str) -> tuple[str, str]:
    """A name of its own for the attempt, and the part's name, which it gets when it is whole."""
    context = TaskContext.get()
    return os.path.join(folder, f".{uuid.uuid4().hex}{ending}"), os.path.join(folder, f"part-{context.partitionId():05d}{ending}")


def write_sqlite_parts(df: DataFrame, folder: str, table: str) -> int:
    """Rows of ``df`` (text, whole and floating numbers) as a database for each partition; the number of rows."""
    folder, names = urlsplit(folder).path, df.columns
    kinds = [{"string": "TEXT", "double": "REAL", "float": "REAL"}.get(k, "INTEGER") for _, k in df.dtypes]
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, whole = _part_file(folder, ".db")
        n = 0
        with sqlite3.connect(own) as db:
            db.execute(f"CREATE TABLE {_named(table)} ({', '.join(f'{_named(c)} {k}' for c, k in zip(names, kinds, strict=True))})")
            for pdf in batches:
                rows = pdf.astype(object).where(pdf.notna(), None)
                db.executemany(f"INSERT INTO {_named(table)} VALUES ({', '.join('?' * len(names))})", rows.values.tolist())
                n += len(rows)
        db.close()
        os.replace(own, whole)
        yield pd.DataFrame({"n": [n]})

    return sum(r["n"] for r in df.mapInPandas(run, "n long").collect())  # a number for each task


def write_npz_parts(df: DataFrame, folder: str) -> int:
    """Rows of ``df`` (no nulls; arrays of one length) as an archive for each partition that has rows; the number of rows."""
    folder = urlsplit(folder).path
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [pdf for pdf in batches if len(pdf)]
        if held:
            own, whole = _part_file(folder, ".npz")
            pdf = pd.concat(held)
            stack = lambda c: np.stack(c.to_numpy()) if len(c) and isinstance(c.iloc[0], np.ndarray) else np.array(c.tolist())
            np.savez(own, **{c: stack(pdf[c]) for c in pdf.columns})
            os.replace(own, whole)
            yield pd.DataFrame({"n": [len(pdf)]})

    return sum(r["n"] for r in df.mapInPandas(run, "n long").collect())
