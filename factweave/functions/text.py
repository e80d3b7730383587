"""Text, hash and number expressions; all native columns."""

from __future__ import annotations

from functools import reduce

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str) -> Column:
    """Without white space at both ends, line breaks and tabs included."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def words(c: Column | str) -> Column:
    """Runs of non-blank characters; null stays null."""
    return F.filter(F.split(col(c), r"\s+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.coalesce(F.size(words(c)), F.lit(0))


def word_set(c: Column | str) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(words(F.lower(col(c))))


def sentences(c: Column | str) -> Column:
    """Pieces after ``.``, ``!`` or ``?`` and white space that are not blank."""
    return F.filter(F.split(strip(c), r"(?<=[.!?])\s+"), lambda s: strip(s) != "")


def sentence_count(c: Column | str) -> Column:
    return F.coalesce(F.size(sentences(c)), F.lit(0))


def hash16(c: Column | str) -> Column:
    """The first 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(col(c).cast("binary"), 256), 1, 16)


def hash16_mod(c: Column | str, m: int) -> Column:
    """``hash16`` read as a number, modulo ``m``."""
    return (F.conv(hash16(c), 16, 10).cast("decimal(20,0)") % m).cast("int")


def sha256_mod(c: Column | str, m: int) -> Column:
    """The whole SHA-256 read as a number, modulo ``m``: four digits at a time, which stays within a long for ``m`` below 2**47."""
    digest = F.sha2(col(c).cast("binary"), 256)
    parts = [F.conv(F.substring(digest, k, 4), 16, 10).cast("long") for k in range(1, 65, 4)]
    return reduce(lambda rest, part: (rest * 65536 + part) % m, parts, F.lit(0).cast("long")).cast("int")


def is_idk(c: Column | str) -> Column:
    """``I don't know``, whatever the case and the dots and spaces around it, or blank."""
    return (F.lower(F.regexp_replace(col(c), r"^[ .]+|[ .]+$", "")) == "i don't know") | (strip(c) == "")


def text_between(c: Column | str, tag: str, last: bool = False, whole: bool = False) -> Column:
    """Stripped text behind the first (or last) ``<tag>`` up to the next ``</tag>`` or the end; without the tag null, or all text if ``whole``."""
    parts = F.split(col(c), f"<{tag}>", -1)
    pick = F.element_at(parts, -1) if last else F.try_element_at(parts, F.lit(2))
    body = strip(F.element_at(F.split(pick, f"</{tag}>", -1), 1))
    return body if whole or not last else F.when(F.size(parts) > 1, body)


def lookup(c: Column | str, table: dict, kind: str = "string") -> Column:
    """The value of ``table`` for ``c``, null if there is none."""
    if not table:
        return F.lit(None).cast(kind)
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), col(c))


def round_half_even(c: Column) -> Column:
    return F.bround(c, 0)


def zero_div(a: Column, b: Column) -> Column:
    """``a / b``, 0 where ``b`` is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
