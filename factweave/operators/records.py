"""The claim record: normalisation, label maps, evidence assembly, joins with caches and knowledge bases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.text import col, lookup, strip
from factweave.plans.checkpoint import cut

COLUMNS = ("id", "src", "claim", "evidence", "label", "orig_label", "metadata")
#: Fixed value: the two canonical labels.
SUPPORTED, REFUTED = "Supported", "Refuted"


def claim_records(df: DataFrame, src: Column | str, claim: Column, evidence: Column, label: Column, labels: dict | None = None, metadata: Column | None = None, ord: Column | None = None) -> DataFrame:
    """Rows of ``df`` as claim records in the order column ``ord``.

    With ``labels`` the source's labels are mapped and rows with others are dropped;
    without, the label's truth value decides. The id is a hash of source and order,
    so a rerun gives the same ids; without ``ord`` the hash of the whole row stands for
    it, and rows that repeat share it. ``metadata`` is the row as JSON.
    """
    mapped = lookup(label.cast("string"), {str(k): v for k, v in labels.items()}) if labels is not None else F.when(label.cast("boolean"), SUPPORTED).otherwise(REFUTED)
    src = F.lit(src) if isinstance(src, str) else src
    ord = F.xxhash64(F.to_json(F.struct("*"))) if ord is None else ord
    whole = F.to_json(F.struct("*")) if metadata is None else metadata
    staged = df.select(ord.cast("long").alias("ord"), src.alias("src"), strip(claim).alias("claim"), strip(evidence).alias("evidence"), mapped.alias("label"), label.cast("string").alias("orig_label"), whole.alias("metadata"))
    return staged.where("label IS NOT NULL").select("ord", F.sha2(F.concat_ws("|", "src", "ord"), 256).alias("id"), *COLUMNS[1:])


def section_evidence(sections: Column | str, header: str, text: str) -> Column:
    """``## header`` and text of an array of structs, an empty line behind each."""
    return strip(F.array_join(F.transform(col(sections), lambda s: F.concat(F.lit("## "), s[header], F.lit("\n"), s[text], F.lit("\n\n"))), ""))


def parallel_evidence(headers: Column | str, texts: Column | str) -> Column:
    """As ``section_evidence`` from two arrays; the shorter one decides."""
    n = F.least(F.size(col(headers)), F.size(col(texts)))
    return section_evidence(F.arrays_zip(F.slice(col(headers), 1, n).alias("h"), F.slice(col(texts), 1, n).alias("t")), "h", "t")


def map_evidence(entries: Column | str) -> Column:
    """The values of a map in its order, one a line."""
    return F.array_join(F.map_values(col(entries)), "\n")


def markdown_table(names: Column | str, rows: Column | str) -> Column:
    """A markdown table of column names and rows of cells, columns padded to their widest cell."""
    names, rows = col(names), col(rows)
    width = F.transform(names, lambda c, i: F.array_max(F.concat(F.array(F.length(c), F.lit(3)), F.transform(rows, lambda r: F.coalesce(F.length(F.get(r, i)), F.lit(0))))))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c, i: F.rpad(F.coalesce(c, F.lit("")), F.get(width, i), " ")), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(width, lambda w: F.repeat(F.lit("-"), w)), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(names), rule), F.transform(rows, line)), "\n")


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the given order. Aggregates partially before the shuffle, so a hot key costs a row per task."""
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[col(o).alias(f"__o{k}") for k, o in enumerate(order)])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ranked).alias("__row")).select(*keys, "__row.*").select(*df.columns)


def with_order(df: DataFrame, *order: str) -> DataFrame:
    """``ord``: the global place of each row, from a range partitioning and prefix sums; no task sees all rows."""
    # Both uses below must see the same partitions, so they are written once.
    parts = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    sums = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("low"))
    starts = sums.select(F.col("__part").alias("__of"), "low", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("start"))
    return parts.join(starts, F.col("__part") == F.col("__of")).withColumn("ord", F.col("start") + F.col("__at") - F.col("low")).select("ord", *df.columns)


def require(df: DataFrame, cache: DataFrame, key: str, value: str, what: str) -> DataFrame:
    """``df`` with ``value`` of ``cache``; a missing key ends the query with an error that names ``what``."""
    got = df.join(first_by(cache, [key], F.xxhash64(value)), key, "left")
    missing = F.raise_error(F.concat(F.lit(f"no {what} for "), F.coalesce(F.col(key), F.lit("null"))))
    return got.withColumn(value, F.when(F.col(value).isNull(), missing.cast(cache.schema[value].dataType)).otherwise(F.col(value)))


def misses(df: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``df`` that ``cache`` lacks."""
    return df.select(key).where(F.col(key).isNotNull()).distinct().join(cache.select(key), key, "left_anti")


def coalescing_join(df: DataFrame, more: DataFrame, key: str, fill: list[str]) -> DataFrame:
    """Fill the null columns ``fill`` of ``df`` from ``more``."""
    names = {c: f"__{c}" for c in fill}
    got = df.join(more.select(key, *[F.col(c).alias(n) for c, n in names.items()]), key, "left")
    return got.withColumns({c: F.coalesce(c, n) for c, n in names.items()}).drop(*names.values())


def entity_evidence(df: DataFrame, kb: DataFrame, id_col: str, entities: str, kb_key: str, kb_text: str) -> DataFrame:
    """Texts of the distinct entities of each row, found in ``kb`` whatever the case and joined by line breaks in entity order.

    Of knowledge-base rows that differ only in case the greatest key counts; misses are left out.
    """
    each = df.select(id_col, F.posexplode(F.array_distinct(F.transform(entities, lambda e: F.lower(F.replace(e, F.lit("_"), F.lit(" ")))))).alias("place", "entity"))
    base = kb.groupBy(F.lower(kb_key).alias("entity")).agg(F.max_by(kb_text, kb_key).alias("text"))
    found = each.join(base, "entity").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("hits"))
    return df.join(found.select(id_col, F.array_join(F.transform("hits", lambda h: h["text"]), "\n").alias("evidence")), id_col, "left")


def kb_join(claims: DataFrame, kb: DataFrame, key: str, order: str) -> DataFrame:
    """Claims with the knowledge-base row of their key, the first inserted one of each; claims without are dropped."""
    return claims.join(first_by(kb, [key], order), key)
