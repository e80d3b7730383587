"""Chat formatting by columnar byte assembly.

A batch of turns becomes one buffer: the lengths of all segments (marks, roles,
texts) are known, their cumulative sums are the offsets, and each kind of
segment is scattered to its place by one indexed copy. Conversations are runs of
turns, so their strings are slices of the same buffer.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN, TURN, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
_GUARD, _UNGUARD = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURNS = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    """``text`` without ``<|``: a backslash goes between, and one more between where there are some already."""
    return _GUARD.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _UNGUARD.sub(r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A")) if "%" in role or "\n" in role else escape(role)


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, size: np.ndarray) -> None:
    """Copy the pieces of ``data`` (of ``size`` each, one behind the other) to the places ``at`` of ``out``."""
    off = np.cumsum(size) - size
    out[np.repeat(at - off, size) + np.arange(int(size.sum()))] = data


def _bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings, one behind the other as they lie in the Arrow buffer, and the size of each."""
    values = values.cast(pa.large_string())
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], np.diff(at)


def escape_column(texts: pa.Array) -> pa.Array:
    """``escape`` of a column; one without control strings is the same column."""
    if not pc.any(pc.match_substring_regex(texts, _GUARD.pattern)).as_py():
        return texts
    return pc.replace_substring_regex(texts, _GUARD.pattern, r"<\\\1|")


def escape_role_column(roles: pa.Array) -> pa.Array:
    return escape_column(pc.replace_substring(pc.replace_substring(roles, "%", "%25"), "\n", "%0A"))


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The buffer of all turns, each turn's start (and the end of the last), and where each turn's text begins and ends."""
    role, n_role = _bytes(escape_role_column(roles))
    text, n_text = _bytes(escape_column(texts))
    size = len(BEGIN) + n_role + len(TURN) + n_text + len(END)
    start = np.r_[0, np.cumsum(size)]
    out = np.empty(int(start[-1]), np.uint8)
    turn = start[:-1]
    text_at = turn + len(BEGIN) + n_role + len(TURN)
    for mark, at in ((BEGIN, turn), (TURN, text_at - len(TURN)), (END, text_at + n_text)):
        out[at[:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    _scatter(out, turn + len(BEGIN), role, n_role)
    _scatter(out, text_at, text, n_text)
    return out, start, text_at, text_at + n_text


def _formatted(table: pa.Table, conv_type: pa.DataType) -> pa.RecordBatch:
    conv = table.column("conv").combine_chunks()
    known = np.asarray(conv.is_valid())
    value = np.asarray(conv.fill_null(0))
    new = np.r_[True, (value[1:] != value[:-1]) | (known[1:] != known[:-1])]
    roles, texts = (table.column(c).combine_chunks() for c in ("role", "text"))
    data, start, text_at, text_end = assemble(roles, texts)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(new)]
    offsets = start[np.r_[first, len(new)]]
    strings = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
    mine = np.asarray(pc.equal(roles, "assistant"))
    group = np.cumsum(new) - 1
    per = np.r_[0, np.cumsum(np.bincount(group[mine], minlength=len(first)))].astype(np.int32)
    spans = [pa.ListArray.from_arrays(pa.array(per), pa.array((x - offsets[:-1][group])[mine])) for x in (text_at, text_end)]
    return pa.RecordBatch.from_arrays([conv.take(pa.array(first)).cast(conv_type), strings, pa.array((last - first).astype(np.int64)), *spans], ["conv_id", "formatted", "n_turns", "loss_start", "loss_end"])


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, formatted, n_turns, loss_start, loss_end)`` for each conversation.

    Turns are ordered by turn, then role and text, nulls first; rows that repeat stay.
    Null texts and roles are read as empty; rows with a null conversation id form one
    conversation. ``loss_start`` and ``loss_end`` are the byte places, within
    ``formatted``, of the assistant texts. Control strings inside texts are escaped
    (see ``escape``), so reading back gives the texts. An empty table gives an
    empty result; columns that are not named are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        kind = None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.schema.field("conv").type
            conv = batch.column("conv")
            final = conv[-1]
            if rest and rest[-1].column("conv")[-1].equals(final) and conv[0].equals(final):
                rest.append(batch)  # the whole batch goes on with the open conversation
                continue
            known, value = np.asarray(conv.is_valid()), np.asarray(conv.fill_null(0))
            other = np.flatnonzero((value != value[-1]) | (known != known[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            ready = [*rest, batch.slice(0, cut)]
            rest = [batch.slice(cut)]
            if sum(b.num_rows for b in ready):
                yield _formatted(pa.Table.from_batches(ready), kind)
        if rest:
            yield _formatted(pa.Table.from_batches(rest), kind)

    kind = turns.schema[conv_col].dataType.simpleString()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return (
        turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
        .repartition("conv")
        .sortWithinPartitions("conv", "turn", "role", "text")
        .select("conv", "role", "text")
        .mapInArrow(run, f"conv_id {kind}, formatted string, n_turns long, loss_start array<long>, loss_end array<long>")
    )


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURNS.match(formatted, at)
        if m is None:
            raise ValueError(f"not a formatted conversation at {at}")
        turns.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted strings of ``format_chats`` hold, read back from them: a row for each row of ``chats``.

    Empty texts and roles count as turns; a null ``conv_id`` is kept, repeated ids give a row each; an
    empty table gives an empty result; columns that are not named are not read. A string that
    ``format_chats`` can't have made is an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, start, end in zip(pdf["formatted"], pdf["loss_start"], pdf["loss_end"], strict=True):
                turns, raw = read_back(text), text.encode()
                loss = "".join(unescape(raw[i:j].decode()) for i, j in zip(start, end, strict=True))
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            got = pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            got.insert(0, "conv_id", pdf["conv_id"].to_numpy())
            yield got

    kind = chats.schema["conv_id"].dataType.simpleString()
    return chats.select("conv_id", "formatted", "loss_start", "loss_end").mapInPandas(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
