"""HTML tables to markdown, with repair of mis-decoded text; Arrow batches, as no builtin parses HTML."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spaces and quotes that become plain ones, marks without width that go.
PLAIN = str.maketrans({
    "\t": " ", " ": " ", "​": None, "‌": None, "‍": None, "﻿": None, " ": "\n", " ": "\n\n",
    "‘": "'", "’": "'", "“": '"', "”": '"', "„": '"',
})
#: Hyphens that only occur mis-decoded.
HYPHENS = str.maketrans({"‐": "-", "‑": "-", "‒": "–"})
EMPHASIS = {"b": "**", "strong": "**", "i": "*", "em": "*"}
_UTF8_RUN = re.compile("[Â-ô][\u0080-¿]{1,3}")


def decode_again(text: str) -> str:
    """UTF-8 that was read as Latin-1, decoded: any lead byte with the continuation bytes that it asks for."""

    def run(m: re.Match) -> str:
        raw = m[0].encode("latin-1")
        size = 2 if raw[0] < 0xE0 else 3 if raw[0] < 0xF0 else 4
        try:
            return raw[:size].decode().translate(HYPHENS) + raw[size:].decode("latin-1")
        except UnicodeDecodeError:
            return m[0]

    return _UTF8_RUN.sub(run, text)


def normal_text(text: str) -> str:
    """Text with mis-decoded runs decoded, their lone rests (a minus before digits, a space) and typographic variants made plain."""
    # The two patterns of stray characters.
    text = re.sub("â(?=[0-9])", "−", decode_again(text))
    return re.sub(r"Â\s*", " ", text).translate(PLAIN)


class _Blocks(HTMLParser):
    """``blocks``: in page order, text as a list of pieces and each table as a ``Table``."""

    class Table(list):
        """Rows of cells; a cell is a list of pieces. ``open``: whether its last row still takes cells."""

        open = False

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[list] = [[]]
        self.table: _Blocks.Table | None = None
        self.depth = 0
        self.cell: list[str] | None = None
        self.caption = False

    def write(self, piece: str) -> None:
        if self.cell is not None:
            self.cell.append(piece)
        elif self.table is None:
            self.blocks[-1].append(piece)
        elif piece.strip() or self.caption:  # a caption, or text that stands in no cell, goes before its table
            self.blocks[-3].append(piece)

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.table = _Blocks.Table()
                self.blocks += [self.table, []]
                return
        if self.depth == 1 and tag == "caption":
            self.cell, self.caption = None, True
            self.write("\n\n")
        elif self.depth == 1 and tag == "tr":
            self.table.append([])
            self.table.open, self.cell = True, None
        elif self.depth == 1 and tag in ("td", "th"):
            if not self.table.open:
                self.table.append([])
                self.table.open = True
            span = dict(attrs).get("colspan") or "1"
            self.cell = []
            self.table[-1] += [self.cell] + [[] for _ in range(min(int(span) if span.isascii() and span.isdigit() else 1, 1000) - 1)]
        elif tag in EMPHASIS:
            self.write(EMPHASIS[tag])
        elif tag == "br":
            self.write("\n")
        elif tag in ("p", "div") or self.depth > 1:
            self.write("\n\n")

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            self.depth -= 1
            if not self.depth:
                self.table, self.cell, self.caption = None, None, False
        elif self.depth == 1 and tag == "caption":
            self.write("\n\n")
            self.caption = False
        elif self.depth == 1 and tag in ("tr", "td", "th"):
            self.table.open, self.cell = self.table.open and tag != "tr", None
        elif tag in EMPHASIS:
            self.write(EMPHASIS[tag])
        elif tag in ("p", "div"):
            self.write("\n\n")

    def handle_data(self, data):
        self.write(data)


def _table_lines(rows: list[list[list[str]]]) -> str:
    """A piped line for each row, a rule as wide as the first below it."""
    lines = [[" ".join(normal_text("".join(cell)).split()) for cell in row] for row in rows if row]
    lines[1:1] = [["---"] * len(lines[0])] if lines else []
    return "\n".join(re.sub(" +", " ", f"| {' | '.join(cells)} |") for cells in lines)


def _paragraphs(pieces: list[str]) -> str:
    """Text with single spaces, none at the end of a line, and at most one empty line."""
    lines = [re.sub(" +", " ", line).rstrip(" ") for line in normal_text("".join(pieces)).split("\n")]
    return re.sub("\n{3,}", "\n\n", "\n".join(lines)).strip()


def html_to_markdown(source: str | None) -> str | None:
    """Markdown of an HTML fragment with tables; breaks inside a cell are spaces; null stays null."""
    if source is None:
        return None
    parser = _Blocks()
    parser.feed(html.unescape(source))
    parser.close()
    done = [_table_lines(b) if isinstance(b, _Blocks.Table) else _paragraphs(b) for b in parser.blocks]
    return "\n\n".join(b for b in done if b)


def table_markdown(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(html_to_markdown)

    return run(c)


def python_list(c: Column) -> Column:
    """Strings of a Python list literal; null and unreadable ones give an empty list."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        import ast

        def read(x):
            try:
                got = ast.literal_eval(x) if isinstance(x, str) else []
                return [str(v) for v in got] if isinstance(got, list | tuple) else []
            except (ValueError, SyntaxError):
                return []

        return s.map(read)

    return run(c)
