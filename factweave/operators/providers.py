"""External models as column providers: a cache table, and a function for what it lacks."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.operators.records import first_by, misses
from factweave.plans.checkpoint import stored


def call_key(tag: str, **config: Column) -> Column:
    """A cache key: SHA-256 of the call's fields as JSON, in name order, and its tag."""
    return F.sha2(F.concat(F.to_json(F.struct(*[config[k].alias(k) for k in sorted(config)])), F.lit(tag)), 256)


def pair_key(evidence: Column, claim: Column) -> Column:
    """The scorer cache's key of an evidence and a claim."""
    return F.sha2(F.concat(evidence, F.lit("\n---\n"), claim), 256)


def upsert(cache: DataFrame, new: DataFrame, key: str = "key", stamp: str = "created_at") -> DataFrame:
    """One row of each key, the latest; of equally late ones that of the greatest hash."""
    return first_by(cache.unionByName(new.select(*cache.columns)), [key], F.lit(None).cast("int") if stamp not in cache.columns else _descending(stamp), F.xxhash64(*cache.columns))


def _descending(stamp: str) -> Column:
    """ISO times in falling order as a rising key."""
    return -F.unix_micros(F.to_timestamp(F.col(stamp)))


class Refused(Exception):
    """Raised by a call that must not be tried again: the request itself is at fault."""


class Unusable(Exception):
    """Raised by a call whose reply can't be used (cut off, empty): tried again a few times only."""


@dataclass(frozen=True)
class Limits:
    """``workers`` tasks with ``in_flight`` calls each; up to ``attempts`` of a call (``unusable`` of unusable replies), with waits
    in seconds that double from ``wait`` to ``most_wait``, a tenth of them at random. An error's ``retry_after`` counts if it is longer."""

    workers: int = 8
    in_flight: int = 16
    attempts: int = 8
    unusable: int = 3
    wait: float = 1.0
    most_wait: float = 60.0


class Provided(NamedTuple):
    """The rows with the provider's value, the cache with what it lacked, and the calls without a value: ``(key, status, attempts, error)``."""

    rows: DataFrame
    cache: DataFrame
    failed: DataFrame


def attempt(call: Callable[[Any], Any], request: Any, limits: Limits, sleep: Callable[[float], None] = time.sleep) -> tuple[Any, str, int, str | None]:
    """Value, status, number of attempts and last error of a call; the status is ``ok``, ``refused``, ``unusable`` or ``exhausted``."""
    pause, unusable = limits.wait, 0
    for k in range(1, limits.attempts + 1):
        try:
            return call(request), "ok", k, None
        except Refused as e:
            return None, "refused", k, f"{type(e).__name__}: {e}"
        except Exception as e:  # noqa: BLE001 - whatever a client raises may pass
            error = f"{type(e).__name__}: {e}"
            unusable += isinstance(e, Unusable)
            if unusable >= limits.unusable:
                return None, "unusable", k, error
            if k < limits.attempts:
                sleep(min(limits.most_wait, max(pause * (1 + random.uniform(0, 0.1)), getattr(e, "retry_after", None) or 0)))
            pause = min(2 * pause, limits.most_wait)
    return None, "exhausted", limits.attempts, error


def replies(requests: DataFrame, key: str, request: str, value: str, kind: str, call: Callable[[Any], Any], limits: Limits = Limits()) -> DataFrame:
    """``(key, value, status, attempts, error)`` for each row of ``requests``, many calls at once, written before anything reads them.

    A call runs again only if its task is lost before its rows are written. ``call`` runs in several threads of a task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(limits.in_flight) as pool:
            for pdf in batches:
                got = list(pool.map(lambda r: attempt(call, r, limits), pdf[request].tolist()))
                out = pd.DataFrame(got, columns=[value, "status", "attempts", "error"], dtype=object)
                out.insert(0, key, pdf[key].to_numpy())
                yield out

    schema = f"`{key}` {requests.schema[key].dataType.simpleString()}, `{value}` {kind}, status string, attempts int, error string"
    return stored(requests.repartition(limits.workers).mapInPandas(run, schema))


def provide(df: DataFrame, cache: DataFrame, key: str, value: str, call: Callable[[Any], Any], limits: Limits = Limits(), request: str | None = None) -> Provided:
    """``df`` with the provider's ``value``: from ``cache``, else from one call for each key that it lacks.

    ``call`` gets the key, or what stands in the column ``request`` (of rows that share a key one of them), and
    returns the value. Replies are written once to the checkpoint folder; the rows, the cache and the failed
    calls are read from there, so they agree and no action calls again. Failed calls leave a
    null value and stay out of the cache. Rows with a null key are not asked for.
    """
    asked = misses(df, cache, key).select(key, F.col(key).alias("__request")) if request is None else first_by(df.where(F.col(key).isNotNull()).select(key, F.col(request).alias("__request")), [key], F.xxhash64("__request")).join(cache.select(key), key, "left_anti")
    new = replies(asked, key, "__request", value, cache.schema[value].dataType.simpleString(), call, limits)
    whole = cache.select(key, value).unionByName(new.where("status = 'ok'").select(key, value))
    return Provided(df.join(whole, key, "left"), whole, new.where("status <> 'ok'").select(key, "status", "attempts", "error"))


def cache_stats(df: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Hits and misses of a read-through."""
    got = df.select(key).join(cache.select(key, F.lit(True).alias("__hit")).distinct(), key, "left")
    return got.agg(F.count_if("__hit").alias("hits"), F.count_if(F.col("__hit").isNull()).alias("misses"))
