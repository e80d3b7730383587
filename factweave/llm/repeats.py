"""Exact removal of byte strings that repeat anywhere in a corpus, by suffix arrays of shards.

Equal texts are kept once, in a table bucketed by their digest. A window is a string of
``size`` bytes. Each window has an anchor: of the ``ANCHOR``-byte strings in it the one
of smallest hash, the leftmost of equals. Equal windows have equal anchors at equal
offsets, so windows in a row that share an anchor form a segment, segments are dealt by the
hash of their anchor, and equal windows meet in one group. A group that one segment makes up
drops out before any text moves. The texts of the others go to shards of whole groups; a shard's suffix
array is sorted by inducing, and a window repeats if the permuted common prefix with a neighbour
is long enough. Copies of a segment are counted and sorted once. A group too large for a task is dealt
again by more bytes: first by the bytes that 16 windows in a row share, then by whole windows,
where a group is one string.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import ensure_checkpoint_dir, spread, stored
from factweave.llm.split import _powers, _salts
from factweave.llm.suffix import repeated

SIZE, ANCHOR = 200, 96
#: Bytes that are worked on at once: windows of a slice, texts of a run, segments of a shard, and of a group that is one task's.
SLICE, RUN, SHARD, GROUP = 1 << 17, 2_000_000, 1_000_000, 1_000_000
#: Windows in a row that share a part of a segment, when its group is dealt again.
FINER = (16, 1)
#: Keys of repeated anchors up to which they are broadcast (8 bytes each).
KEYS = 1_000_000
END = 0xFF  # occurs in no UTF-8 text


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Hashes of any substrings of ``data``, from running sums."""

    def __init__(self, data: np.ndarray):
        odd, self.back = _powers(len(data))
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_salts()[data] * odd[: len(data)], out=self.total[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.total[end] - self.total[begin]) * self.back[begin] + (end - begin).astype(np.uint64))

    def each(self, size: int) -> np.ndarray:
        return _mixed((self.total[size:] - self.total[:-size]) * self.back[: len(self.total) - size])


def _anchors(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` hashes the place of the smallest, the leftmost of equals."""
    m = len(h)
    place = np.uint64((1 << 24) - 1)
    grid = np.full(-(-m // width) * width, ~np.uint64(0))
    grid[:m] = (h & ~place) | np.arange(m, dtype=np.uint64)
    grid = grid.reshape(-1, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.ascontiguousarray(np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]).ravel()
    return (np.minimum(right[: m - width + 1], left[width - 1 : m]) & place).astype(np.int64)


def segments(data: np.ndarray, ends: np.ndarray, size: int, anchor: int, finer: int | None = None) -> dict[str, np.ndarray]:
    """Segments of texts laid out behind each other and ending at ``ends``: ``begin bytes key hash``.

    With ``finer``, parts of segments: windows whose anchor is as many times ``finer`` bytes from their begin;
    the key is then the hash of the bytes that all windows of such a part hold.
    """
    got: dict[str, list[np.ndarray]] = {"begin": [], "bytes": [], "key": [], "hash": []}
    for low in range(0, len(data) - size + 1, SLICE):
        part = data[low : low + SLICE + size - 1]
        sums = Hashes(part)
        h = sums.each(anchor)
        at = _anchors(h, size - anchor + 1)
        window = np.arange(len(at))
        first = int(np.searchsorted(ends, low, "right"))
        inside = ends[first : int(np.searchsorted(ends, low + len(at), "left")) + 1] - low
        text = np.zeros(len(at) + 1, np.int64)
        np.add.at(text, inside[inside <= len(at)], 1)
        text = np.cumsum(text)[:-1]
        whole = window + size <= inside[np.minimum(text, len(inside) - 1)]
        window, at, text = window[whole], at[whole], text[whole]
        if not len(window):
            continue
        off = (at - window) // finer if finer else np.zeros(len(at), np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | (off[1:] != off[:-1])
        new = np.flatnonzero(new)
        begin, last = window[new], window[np.r_[new[1:] - 1, len(window) - 1]]
        key = h[at[new]]
        if finer:
            far = (off[new] + 1) * finer - 1  # the greatest distance of a part's windows from the anchor, in any text
            key = _mixed(sums.of(np.maximum(at[new] - off[new] * finer, 0), np.minimum(at[new] - far + size, len(part))) + off[new].astype(np.uint64) + key)
        for name, x in (("begin", begin + low), ("bytes", last + size - begin), ("key", key), ("hash", sums.of(begin, last + size))):
            got[name].append(x)
    return {k: np.concatenate(x) if x else np.empty(0, np.uint64 if k in ("key", "hash") else np.int64) for k, x in got.items()}


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])


def _runs(pdf: pd.DataFrame, column: str, most: int) -> Iterator[pd.DataFrame]:
    """Rows in a row whose ``column`` has about ``most`` bytes; a longer one by itself."""
    size = np.fromiter(map(len, pdf[column]), np.int64, len(pdf))
    part = np.cumsum(size) // most
    for _, own in pdf.groupby(part, sort=False):
        yield own


def _cut(size: int, anchor: int):
    """Segments of whole texts; equal ones that follow each other at one distance (periods) make one row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for own in _runs(pdf, "t", RUN):
                data, ends = _joined(own["t"].tolist())
                s = segments(data, ends, size, anchor)
                text = np.searchsorted(ends, s["begin"], "right")
                step = np.r_[0, np.diff(s["begin"])]
                goes = np.zeros(len(step), bool)
                goes[1:] = (s["hash"][1:] == s["hash"][:-1]) & (s["key"][1:] == s["key"][:-1]) & (text[1:] == text[:-1])
                goes[2:] &= ~goes[1:-1] | (step[2:] == step[1:-1])
                first = np.flatnonzero(~goes)
                times = np.diff(np.r_[first, len(goes)])
                gap = np.where(times > 1, step[np.minimum(first + 1, len(step) - 1)] if len(step) else 0, 0)
                h = own["h"].to_numpy()
                begin = s["begin"][first] - np.r_[0, ends][text[first]]
                yield pd.DataFrame({"key": s["key"][first].view(np.int64), "hash": s["hash"][first].view(np.int64), "h": h[text[first]], "begin": begin, "bytes": s["bytes"][first].astype(np.int32), "gap": gap.astype(np.int32), "times": times})

    return run


def _taken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of the wanted segments of each text."""
    for pdf in batches:
        rows = [(w["key"], w["hash"], w["n"], t[w["begin"] : w["begin"] + w["bytes"]]) for t, wanted in zip(pdf["t"], pdf["wanted"], strict=True) for w in wanted]
        yield pd.DataFrame(rows, columns=["key", "hash", "n", "part"])


def _spans(flags: np.ndarray, begins: np.ndarray, size: int) -> list[list[int]]:
    """For each segment the covered spans ``[a, b, a, b, ...]`` of its flagged windows, from its begin."""
    at = np.flatnonzero(flags)
    of = np.searchsorted(begins, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] - at[:-1] > size) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(at)] - 1
    out: list[list[int]] = [[] for _ in begins]
    for k, a, b in zip(of[first].tolist(), (at[first] - begins[of[first]]).tolist(), (at[last] - begins[of[first]] + size).tolist(), strict=True):
        out[k] += [a, b]
    return out


def _sort_shard(pdf: pd.DataFrame, size: int) -> pd.DataFrame:
    parts = pdf["part"].tolist()
    data = np.frombuffer(b"".join(p + b"\xff" for p in parts), np.uint8)
    width = np.fromiter(map(len, parts), np.int64, len(parts))
    begins = np.cumsum(width + 1) - width - 1
    flags = repeated(data, begins, size)
    many = pdf["n"].to_numpy() > 1  # copies repeat in full
    flags |= np.repeat(many, width + 1) & (np.arange(len(data)) - np.repeat(begins, width + 1) <= np.repeat(width, width + 1) - size)
    return pd.DataFrame({"key": pdf["key"].to_numpy(), "hash": pdf["hash"].to_numpy(), "spans": _spans(flags, begins, size)})


def _sort_shards(size: int):
    """Whole groups (rows in order of key) into shards; each shard's suffix array gives its spans."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total = [], 0
        for pdf in batches:
            for _, group in pdf.groupby("key", sort=False):
                if total >= SHARD and held and held[-1]["key"].iloc[0] != group["key"].iloc[0]:
                    yield _sort_shard(pd.concat(held), size)
                    held, total = [], 0
                held.append(group)
                total += int(group["part"].map(len).sum())
        if held:
            yield _sort_shard(pd.concat(held), size)

    return run


def _parts(size: int, anchor: int, finer: int):
    """Segments of large groups, cut into parts that are dealt by more bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for own in _runs(pdf, "part", RUN):
                data, ends = _joined(own["part"].tolist())
                s = segments(data, ends, size, anchor, finer)
                of = np.searchsorted(ends, s["begin"], "right")
                parts = [data[b : b + w].tobytes() for b, w in zip(s["begin"].tolist(), s["bytes"].tolist(), strict=True)]
                yield pd.DataFrame({
                    "of_key": own["key"].to_numpy()[of], "of_hash": own["hash"].to_numpy()[of], "at": s["begin"] - np.r_[0, ends][of],
                    "key": s["key"].view(np.int64), "hash": s["hash"].view(np.int64), "part": parts,
                })

    return run


def _whole(n: F.Column, size: int) -> F.Column:
    return F.when(n > 1, F.array(F.lit(0), F.col("bytes").cast("int"))).otherwise(F.array().cast("array<int>"))


def _grouped(texts: DataFrame, size: int, anchor: int, finer: tuple[int, ...], group: int) -> DataFrame:
    """``(key, hash, spans)`` for the distinct segments ``texts(key, hash, n, part)`` of groups of two or more.

    Groups of up to ``group`` bytes go to shards, larger ones are dealt again by their parts.
    """
    spark = texts.sparkSession
    texts = stored(texts)
    bytes_of = texts.groupBy("key").agg(F.sum(F.octet_length("part")).alias("size"))
    large = _kept(bytes_of.where(F.col("size") > group).select("key"))
    total = bytes_of.agg(F.sum("size")).first()[0] or 0
    shards = max(1, spark.sparkContext.defaultParallelism, -(-int(total) // (4 * SHARD)))
    hot = not large.isEmpty()
    small = texts.join(large, "key", "left_anti") if hot else texts
    found = small.repartition(shards, "key").sortWithinPartitions("key").mapInPandas(_sort_shards(size), "key long, hash long, spans array<int>")
    if not hot:
        return found
    cut = stored(texts.join(large, "key", "left_semi").mapInPandas(_parts(size, anchor, finer[0]), "of_key long, of_hash long, at int, key long, hash long, part binary"))
    kinds = cut.groupBy("key", "hash").agg(F.count(F.lit(1)).alias("n"), F.first("part").alias("part"), F.octet_length(F.first("part")).alias("bytes"))
    if len(finer) == 1:  # a key is a whole window
        below = kinds.select("key", "hash", _whole(F.col("n"), size).alias("spans"))
    else:
        several = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("key")
        kinds = stored(kinds)
        alone = kinds.join(several, "key", "left_anti").select("key", "hash", _whole(F.col("n"), size).alias("spans"))
        below = alone.unionByName(_grouped(kinds.join(several, "key", "left_semi").select("key", "hash", "n", "part"), size, anchor, finer[1:], group))
    back = cut.drop("part").join(stored(below.where(F.size("spans") > 0)), ["key", "hash"]).select("of_key", "of_hash", F.transform("spans", lambda x: x + F.col("at")).alias("spans"))
    # Copies of a whole segment repeat in full, whatever its parts do.
    copies = texts.where("n > 1").join(large, "key", "left_semi").select("key", "hash", F.array(F.lit(0), F.octet_length("part")).alias("spans"))
    again = back.groupBy(F.col("of_key").alias("key"), F.col("of_hash").alias("hash")).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return found.unionByName(again).unionByName(copies)


def _merged(own: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal runs that spans ``(a, b)`` cover in ``size`` bytes."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, own[0::2], 1)
    np.add.at(edge, own[1::2], -1)
    step = np.diff(np.r_[0, np.cumsum(edge) > 0].astype(np.int8))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _removed(keep: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for h, t, found in zip(pdf["h"], pdf["t"], pdf["found"], strict=True):
                spans = [np.asarray(f["spans"], np.int64) + f["begin"] + k * f["gap"] for f in found for k in range(f["times"])]
                a, b = _merged(np.concatenate(spans), len(t))
                edges = np.r_[0, np.stack([a, b], axis=1).ravel(), len(t)].tolist()
                kept = b"".join(t[i:j] for i, j in zip(edges[0::2], edges[1::2], strict=True))
                out.append([h, [{"begin": i, "end": j} for i, j in zip(a.tolist(), b.tolist(), strict=True)], hashlib.sha256(kept).hexdigest()] + [kept] * keep)
            yield pd.DataFrame(out, columns=["h", "spans", "kept_sha256"] + ["kept"] * keep)

    return run


SPANS = "array<struct<begin: long, end: long>>"


def _kept(df: DataFrame) -> DataFrame:
    """``df``, which comes out of a shuffle, stored in an eighth as many files, but not fewer than there are cores."""
    spark = df.sparkSession
    return stored(df.coalesce(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)))


def _bucketed(texts: DataFrame) -> DataFrame:
    """``texts`` written in buckets by ``h``, so that joins on it move only their other side."""
    spark = texts.sparkSession
    ensure_checkpoint_dir(spark)
    name = f"texts_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts.write.bucketBy(n, "h").sortBy("h").option("path", f"{spark.sparkContext.getCheckpointDir()}/{name}").saveAsTable(name)
    found = spark.table(name)
    found.schema  # the plan now knows its files and buckets; the name is no longer needed
    spark.sql(f"DROP TABLE {name}")  # files of a table with a path of its own stay
    return found


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, anchor: int = ANCHOR, finer: tuple[int, ...] = FINER, group: int = GROUP, keep: bool = False) -> DataFrame:
    """``(id, n_bytes, spans, kept_sha256)`` for every row of ``docs``, with ``kept`` (the bytes that stay) if asked for.

    ``spans`` are the maximal runs of bytes covered by a string of ``size`` bytes that also begins
    elsewhere: in another row, or at another place of the same, overlaps included. Strings lie within one row and
    are judged on the input. Texts are taken as UTF-8; null is read as empty. Shorter texts than ``size``
    have no such string; two equal rows of ``size`` bytes or more lose everything. Rows that repeat an
    id, or have none, give a row each; an empty table gives an empty result; other columns are not read.

    Strings are compared byte by byte in suffix arrays; equal segments, and windows of groups that are too large for
    a task, are recognised by 128-bit hashes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.encode(F.coalesce(text_col, F.lit("")), "UTF-8").alias("t"))
    rows = rows.withColumn("sha", F.sha2("t", 256)).select("id", "t", "sha", F.substring(F.unhex("sha"), 1, 16).alias("h"), F.octet_length("t").cast("long").alias("n_bytes"))
    texts = _bucketed(spread(rows.where(F.col("n_bytes") >= size)).groupBy("h").agg(F.first("t").alias("t"), F.count(F.lit(1)).alias("copies")))
    cut = spread(texts.select("h", "t")).mapInPandas(_cut(size, anchor), "key long, hash long, h binary, begin long, bytes int, gap int, times long")
    keys = _kept(cut.groupBy("key").agg(F.sum("times").alias("n")).where("n > 1").select("key"))
    here = F.broadcast(keys) if keys.count() <= KEYS else keys
    met = stored(cut.join(here, "key", "left_semi"))
    kinds = met.groupBy("key", "hash").agg(F.sum("times").alias("n"), F.min(F.struct("h", "begin")).alias("from"), F.first("bytes").alias("bytes"))
    kinds = _kept(kinds)
    several = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("key")
    alone = kinds.join(several, "key", "left_anti").select("key", "hash", _whole(F.col("n"), size).alias("spans"))
    wanted = kinds.join(several, "key", "left_semi").groupBy("from.h").agg(F.collect_list(F.struct("key", "hash", "n", "from.begin", "bytes")).alias("wanted"))
    taken = texts.select("h", "t").join(wanted, "h").select("t", "wanted").mapInPandas(_taken, "key long, hash long, n long, part binary")
    found = stored(alone.unionByName(_grouped(taken, size, anchor, finer, group)).where(F.size("spans") > 0))
    covered = met.join(found, ["key", "hash"]).groupBy("h").agg(F.collect_list(F.struct("begin", "gap", "times", "spans")).alias("found"))
    more = ", kept binary" * keep
    single = texts.where("copies = 1").select("h", "t").join(covered, "h").mapInPandas(_removed(keep), f"h binary, spans {SPANS}, kept_sha256 string{more}")
    full = texts.where("copies > 1").select("h", F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.octet_length("t").cast("long").alias("end"))).alias("spans"), F.sha2(F.lit(b""), 256).alias("kept_sha256"), *[F.lit(b"").alias("kept")] * keep)
    changed = _kept(single.unionByName(full))
    kept = [F.when(F.col("spans").isNull(), F.col("t")).otherwise(F.col("kept")).alias("kept")] * keep
    out = rows.select("id", "h", "n_bytes", "sha", *["t"] * keep).join(changed, "h", "left")
    return out.select("id", "n_bytes", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), *kept)
