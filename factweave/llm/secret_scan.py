"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Texts are content-addressed. The ledger holds, for each blob and rule version
that was ever scanned, the findings; a scan reads only the (blob, rule, version)
triples that the ledger lacks, each blob once however many paths and versions
hold it, and joins the findings back to all paths.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.common import fresh, stored

SPAN = "array<struct<start:int,end:int,byte_start:int,byte_end:int>>"
LISTED = "array<struct<start:int,place:int,kind:string,end:int>>"


@dataclass(frozen=True)
class Rule:
    """``pattern``: a Java regex whose matches are leftmost and don't overlap. ``least``: the least length of ``group`` of a match; shorter matches are dropped but keep what they took."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules. Runs are maximal, so the least length can stand in the pattern of access and hex.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """The running results of an associative ``op`` over non-negative ints, from 0.

    An array that grows by one element a step is copied at each step; in chunks of the
    square root of the length, n elements cost n ** 1.5 instead of n ** 2.
    """

    def walk(items: Column, first: Column) -> Column:
        none = F.array().cast("array<int>")
        step = lambda a, x: _let(op(a["at"], x), lambda y: F.struct(y.alias("at"), F.concat(a["out"], F.array(y)).alias("out")))
        return F.aggregate(items, F.struct(first.alias("at"), none.alias("out")), step, lambda a: a["out"])

    def chunked(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda k: F.slice(v, k * width + 1, width))
        before = lambda c: F.concat(F.array(F.lit(0)), walk(F.transform(c, lambda x: F.aggregate(x, F.lit(0), lambda a, b: op(a, b))), F.lit(0)))
        whole = _let(chunks, lambda c: _let(before(c), lambda o: F.flatten(F.transform(c, lambda x, k: walk(x, F.get(o, k))))))
        return F.when(F.size(v) > 0, whole).otherwise(F.array().cast("array<int>"))

    return _let(values, chunked)


def spans(text: Column, rule: Rule) -> Column:
    """Start and end, in code points and in UTF-8 bytes, of the matches of ``rule``.

    The pieces between the matches come from a split, the matches from an
    extraction by the same pattern; the running sums of their lengths are the places.
    """
    pieces = F.split(text, rule.pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(f"({rule.pattern})" if not rule.pattern.startswith("(?i)") else f"(?i)({rule.pattern[4:]})"), F.lit(1))
    last = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    sizes = F.transform(
        F.arrays_zip(pieces.alias("p"), matches.alias("m"), last.alias("g")),
        lambda x: F.struct(
            (F.length(x["p"]) + F.length(x["m"])).alias("both"), F.length(x["m"]).alias("own"),
            (F.octet_length(x["p"]) + F.octet_length(x["m"])).alias("both_bytes"), F.octet_length(x["m"]).alias("own_bytes"), F.length(x["g"]).alias("size"),
        ),
    )
    found = lambda xs: F.filter(xs, lambda x: x["own"].isNotNull())  # noqa: E731 - the last piece has no match
    add = lambda a, b: a + b

    def placed(xs: Column) -> Column:
        ends, byte_ends = _running(F.transform(xs, lambda x: x["both"]), add), _running(F.transform(xs, lambda x: x["both_bytes"]), add)
        at = lambda e, b: F.transform(
            xs,
            lambda x, k: F.struct(
                (F.get(e, k) - x["own"]).alias("start"), F.get(e, k).alias("end"), (F.get(b, k) - x["own_bytes"]).alias("byte_start"), F.get(b, k).alias("byte_end"), x["size"].alias("size")
            ),
        )
        return _let(ends, lambda e: _let(byte_ends, lambda b: at(e, b)))

    whole = _let(_let(sizes, found), placed)
    kept = F.transform(
        F.filter(whole, lambda x: x["size"] >= rule.least),
        lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["byte_start"].alias("byte_start"), x["byte_end"].alias("byte_end")),
    )
    return F.when(F.rlike(text, F.lit(rule.pattern)), kept).otherwise(F.array().cast(SPAN))


def address(text: Column) -> Column:
    """A blob's address: the SHA-256 of its UTF-8 bytes (null: of none)."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan(blobs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows ``(blob, rule, found)`` for the blobs of ``blobs(blob, text)`` under the rules that ``ledger`` has not seen them with."""
    once = blobs.groupBy("blob").agg(F.any_value("text").alias("text"))
    if ledger is None:
        todo = once.withColumn("todo", F.array(*[F.lit(r.key) for r in rules]))
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = (
            blobs.select("blob").distinct().join(seen, "blob", "left")
            .select("blob", F.array_except(F.array(*[F.lit(r.key) for r in rules]), F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
            .where(F.size("todo") > 0)
        )
        todo = blobs.join(todo, "blob").groupBy("blob", "todo").agg(F.any_value("text").alias("text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    each = [F.when(F.array_contains("todo", r.key), F.struct(F.lit(r.key).alias("rule"), spans(text, r).alias("found"))) for r in rules]
    return todo.select("blob", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("x")).select("blob", "x.rule", "x.found")


def hits(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(blob, spans)`` of the blobs with findings of the rules' present versions: structs of start, place of the rule, kind and end (and the byte offsets), in that order."""
    order = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.key), F.lit(k))])
    kind = F.create_map(*[x for r in rules for x in (F.lit(r.key), F.lit(r.kind))])
    each = F.transform(
        "found",
        lambda s: F.struct(
            s["start"].alias("start"), order[F.col("rule")].alias("place"), kind[F.col("rule")].alias("kind"), s["end"].alias("end"), s["byte_start"].alias("byte_start"), s["byte_end"].alias("byte_end")
        ),
    )
    return ledger.where(F.col("rule").isin([r.key for r in rules]) & (F.size("found") > 0)).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(each))).alias("spans"))


def _holds_files(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to ``path``, in whatever file system it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.exists(where) and any(s.getPath().getName().endswith(".parquet") for s in system.listStatus(where))


def scan_docs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings of every row of ``docs`` as ``(id, blob, spans)``, and the ledger that holds them.

    Null texts are scanned as empty and have none. Rows that repeat, equal texts
    under other ids and null ids each get the findings of their blob. An empty
    table gives an empty result; columns that are not named are not read.
    A blob is scanned under a rule once: what ``path`` holds already counts as seen, with or without ``ledger``,
    and of ledger rows that repeat (from calls at the same time) one is read.
    The findings that are not empty are written to the checkpoint folder, in few files:
    rows are shuffled to them only if they are too large to broadcast by the size of
    their files. The ledger is not written here; a caller that keeps one gives ``path``,
    where its new rows are written before anything reads them.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), address(F.col(text_col)).alias("blob"))
    spark = docs.sparkSession
    kept = spark.read.parquet(path) if path is not None and _holds_files(spark, path) else None
    if kept is not None:
        ledger = kept if ledger is None else ledger.select(kept.columns).unionByName(kept)
    if ledger is not None:
        ledger = ledger.dropDuplicates(["blob", "rule"])
    new = scan(rows.select("blob", "text"), ledger, rules)
    if path is not None:
        new.write.mode("append").parquet(path)
        written = spark.read.schema(new.schema).parquet(path)
        whole = (written if ledger is None else ledger.select(new.columns).unionByName(written)).dropDuplicates(["blob", "rule"])
    else:
        whole = new if ledger is None else ledger.select(new.columns).unionByName(new)
    shown = F.transform("spans", lambda s: F.struct(*[s[c].alias(c) for c in ("start", "place", "kind", "end")]))
    found = stored(hits(whole, rules).withColumn("spans", shown).repartition("blob"))
    return rows.select("id", "blob").join(found, "blob", "left").select("id", "blob", F.coalesce("spans", F.array().cast(LISTED)).alias("spans")), whole


def listed(spans_col: str = "spans") -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each stretch of text that findings cover (overlapping ones as one) replaced by ``mark``, and ``length_col`` set to the new length.

    Only texts with findings are rebuilt; the others, null texts among them, stay as they
    are, and so do ids, null and repeated ones too, and all further columns. An empty table
    stays empty. The findings are written to the checkpoint folder without the texts; rows
    join them by broadcast while their files are small, else by blob.
    """
    text, own, of, where = F.col(text_col), fresh(docs, "own_blob"), fresh(docs, "of_blob"), fresh(docs, "blob_spans")
    found = stored(hits(scan(docs.select(address(text).alias("blob"), text.alias("text")), None, rules), rules).repartition("blob")).select(F.col("blob").alias(of), F.col("spans").alias(where))
    rows = docs.withColumn(own, address(text)).join(found, F.col(own) == F.col(of), "left")

    def pieces(raw: Column) -> Column:
        """What lies before, between and behind the covered stretches."""
        upto = _running(F.transform(F.col(where), lambda s: s["byte_end"]), lambda a, b: F.greatest(a, b))

        def cut(ends: Column) -> Column:
            since = lambda k: F.when(k > 0, F.get(ends, k - 1)).otherwise(0)
            free = F.transform(F.col(where), lambda s, k: F.when(s["byte_start"] >= since(k), F.substring(raw, since(k) + 1, s["byte_start"] - since(k))))
            last = F.substring(raw, F.get(ends, F.size(ends) - 1) + 1, F.octet_length(raw))
            return F.concat(F.filter(free, lambda x: x.isNotNull()), F.array(last))

        return _let(upto, cut)

    built = F.array_join(F.transform(_let(text.cast("binary"), pieces), lambda x: x.cast("string")), mark)
    cols = {text_col: F.when(F.col(where).isNull(), text).otherwise(built)}
    out = rows.withColumns(cols)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col(where).isNull(), F.col(length_col)).otherwise(F.length(text_col).cast(docs.schema[length_col].dataType)))
    return out.select(*docs.columns)
