"""Queries of the claim engine over the driver's tables, each with the same in SQL where SQL can express it.

Claims come from ``documents`` and ``labels``: the first sentence is the claim,
the text the evidence, quality the label. Vectors are ``embeddings`` with their
label as group. Generations are conversations in tags.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import tags, text
from factweave.functions.prompts import TASKS, render
from factweave.functions.tables import table_markdown
from factweave.operators import aggregates, dedup, density, filters, judgelog, layout, providers, records, rewards, sampling, selection, similarity
from factweave.plans import corpus_rows, curation, qacheck
from factweave.plans.checkpoint import run_folder, stored
from factweave.sources import local_files
from factweave.streaming import judge_ingest as judge_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

BASE = r"""
docs AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM documents),
claims AS (
  SELECT d.doc_id AS ord, d.source AS src, d.lang, d.n_chars, d.body AS evidence, quality, toxic,
         string_split(regexp_replace(d.body, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1] AS claim,
         CASE quality WHEN 1 THEN 'Supported' WHEN 0 THEN 'Refuted' END AS label
  FROM docs d JOIN labels l ON l.doc_id = d.doc_id
)
"""
WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"
SENTENCES = r"len(list_filter(string_split(regexp_replace({0}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> ''))"


def words_sql(c: str) -> str:
    return WORDS.format(c)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def with_base(sql: str) -> str:
    return f"WITH {BASE}{sql}"


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table; one of long texts is dealt to all cores if its file splits into fewer parts than there are."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "pages") and df.rdd.getNumPartitions() < cores else df


def claims(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("src"), "lang", "n_chars", text.strip("text").alias("evidence"))
    lab = read(spark, sf, "labels").select(F.col("doc_id").alias("ord"), "quality", "toxic")
    label = text.lookup("quality", {1: "Supported", 0: "Refuted"})
    return d.join(lab, "ord").select("ord", "src", "lang", "n_chars", "evidence", "quality", "toxic", F.element_at(F.split("evidence", r"(?<=[.!?])\s+", 2), 1).alias("claim"), label.alias("label"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings")


# ---- records, filters and their summary

KEPT = f"len({words_sql('evidence')}) > 0 AND len({words_sql('claim')}) / len({words_sql('evidence')}) <= 0.15 AND {SENTENCES.format('evidence')} >= 3"


@query(with_base(f"""
SELECT CASE WHEN grouping(src) = 1 THEN 'TOTAL' ELSE src END AS src, count(*) AS before, count(*) FILTER (NOT ({KEPT})) AS removed, count(*) FILTER ({KEPT}) AS after,
       100.0 * count(*) FILTER (NOT ({KEPT})) / count(*) AS pct_removed
FROM claims GROUP BY ROLLUP (src)
"""))
def source_summary(spark, sf):
    got = aggregates.removal_counts(claims(spark, sf), filters.ratio_within() & filters.enough_sentences())
    return got.withColumn("pct_removed", F.col("pct_removed").cast("double"))


@query(with_base("SELECT ord, src, claim, evidence, label, CAST(quality AS VARCHAR) AS orig_label, sha256(src || '|' || ord) AS id FROM claims"))
def claim_record(spark, sf):
    own = claims(spark, sf)
    return records.claim_records(own, F.col("src"), F.col("claim"), F.col("evidence"), F.col("quality"), {1: "Supported", 0: "Refuted"}, ord=F.col("ord")).drop("metadata")


@query(with_base("SELECT label, src, count(*) AS n FROM claims GROUP BY ALL"))
def label_normalize(spark, sf):
    return claims(spark, sf).groupBy("label", "src").agg(F.count(F.lit(1)).alias("n"))


@query(with_base(f"SELECT ord FROM claims WHERE len({words_sql('evidence')}) > 0 AND len({words_sql('claim')}) / len({words_sql('evidence')}) <= (CASE WHEN src IN ('src1', 'src2') THEN 0.4 ELSE 0.15 END)"))
def ratio_filter(spark, sf):
    return claims(spark, sf).where(filters.ratio_within(0.15, {"src1": 0.4, "src2": 0.4})).select("ord")


@query(with_base(f"SELECT ord, {SENTENCES.format('evidence')} AS n FROM claims WHERE {SENTENCES.format('evidence')} >= 3 OR src IN ('pubhealthtab', 'scitab')"))
def sentence_filter(spark, sf):
    return claims(spark, sf).where(filters.enough_sentences()).select("ord", text.sentence_count("evidence").alias("n"))


@query(with_base(f"SELECT ord, len({words_sql('evidence')}) AS tokens FROM claims WHERE len({words_sql('evidence')}) BETWEEN 200 AND 10000"))
def length_filter(spark, sf):
    return claims(spark, sf).where(filters.tokens_within()).select("ord", text.word_count("evidence").alias("tokens"))


@query(with_base(f"SELECT ord, len({words_sql('claim')}) + len({words_sql('evidence')}) + 2 AS prompt_token_length FROM claims WHERE len({words_sql('claim')}) + len({words_sql('evidence')}) + 2 < 300"))
def prompt_filter(spark, sf):
    prompt = render("Claim: {claim}\nEvidence: {evidence}", claim=F.col("claim"), evidence=F.col("evidence"))
    return filters.with_prompt_tokens(claims(spark, sf), prompt, 300).select("ord", "prompt_token_length")


@query(with_base(f"""
, s AS (SELECT ord, list_distinct({words_sql('lower(claim)')}) AS c, list_distinct({words_sql('lower(evidence)')}) AS e FROM claims)
SELECT ord, CASE WHEN len(c) = 0 THEN 0 ELSE len(list_intersect(c, e)) / len(c) END AS overlap FROM s
"""))
def lexical_overlap(spark, sf):
    return claims(spark, sf).select("ord", filters.lexical_overlap().alias("overlap"))


@query(with_base(f"""
, t AS (SELECT src, len({words_sql('evidence')}) AS n FROM claims)
SELECT src, CAST((n >= 50)::INT + (n >= 200)::INT + (n >= 1000)::INT AS INTEGER) AS bin, count(*) AS n FROM t WHERE n BETWEEN 0 AND 10000 GROUP BY 1, 2
"""))
def token_histogram(spark, sf):
    return filters.token_histogram(claims(spark, sf), text.word_count("evidence"), [0, 50, 200, 1000, 10000])


@query(with_base("""
, s AS (SELECT ord, label, (('0x' || substr(sha256(evidence || chr(10) || '---' || chr(10) || claim), 1, 4))::INT % 1000) / 1000.0 AS prob FROM claims)
SELECT ord, CAST(prob AS DOUBLE) AS prob FROM s WHERE (CASE label WHEN 'Supported' THEN prob ELSE 1 - prob END) BETWEEN 0.3005 AND 0.8005
"""))
def scorer_filter(spark, sf):
    own = claims(spark, sf).withColumn("key", providers.pair_key(F.col("evidence"), F.col("claim")))
    cache = own.select("key", ((F.conv(F.substring("key", 1, 4), 16, 10).cast("int") % 1000) / 1000.0).cast("double").alias("prob")).distinct()
    return own.join(cache, "key").where(filters.hard_enough("prob", 0.3005, 0.8005)).select("ord", "prob")


@query(with_base(f"""
, e AS (SELECT ord, list_distinct(list_filter({words_sql('claim')}, lambda w: regexp_full_match(substr(w, 1, 1), '[A-Z]'))) AS ents FROM claims)
SELECT ord, len(ents) AS n FROM e WHERE len(ents) >= 2
"""))
def entity_filter(spark, sf):
    own = claims(spark, sf)
    cache = own.select("claim", F.array_distinct(F.filter(text.words("claim"), lambda w: F.rlike(F.substring(w, 1, 1), F.lit("^[A-Z]$")))).alias("all_entities"))
    got = records.require(own, cache, "claim", "all_entities", "entities")
    return got.where(filters.enough_entities()).select("ord", F.size("all_entities").alias("n"))


@query(with_base(f"""
, e AS (SELECT len(list_distinct(list_filter({words_sql('claim')}, lambda w: regexp_full_match(substr(w, 1, 1), '[A-Z]')))) AS entities FROM claims)
SELECT entities, count(*) AS n FROM e GROUP BY 1
"""))
def entity_distribution(spark, sf):
    n = F.size(F.array_distinct(F.filter(text.words("claim"), lambda w: F.rlike(F.substring(w, 1, 1), F.lit("^[A-Z]$")))))
    return claims(spark, sf).groupBy(n.alias("entities")).agg(F.count(F.lit(1)).alias("n"))


HEX_MOD = "list_reduce(list_transform(range(1, 65), lambda k: CAST(strpos('0123456789abcdef', substr(sha256({0}), k, 1)) - 1 AS BIGINT)), lambda a, x: (a * 16 + x) % 10000)"


@query(with_base(f"SELECT ord FROM claims WHERE ({HEX_MOD.format('claim')}) / 10000.0 < 0.3"))
def supervision_filter(spark, sf):
    return claims(spark, sf).where(filters.is_supervised(0.3)).select("ord")


# ---- deduplication and decontamination


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def exact_dedup(spark, sf):
    return dedup.first_wins(read(spark, sf, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id")


def greedy_sql(nodes: str, pairs: str, key: str) -> str:
    """The sequential pass: nodes in order, each kept if no kept earlier node is its partner."""
    return f"""
n AS (SELECT {key} AS k, row_number() OVER (ORDER BY {key}) AS i FROM ({nodes})),
p AS MATERIALIZED ({pairs}),
adj AS MATERIALIZED (SELECT n.i, n.k, list(p.a) FILTER (p.a IS NOT NULL) AS before FROM n LEFT JOIN p ON p.b = n.k GROUP BY ALL),
walk(i, kept) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT adj.i, CASE WHEN len(list_intersect(walk.kept, coalesce(adj.before, []))) > 0 THEN walk.kept ELSE list_append(walk.kept, adj.k) END
  FROM walk JOIN adj ON adj.i = walk.i + 1
)
SELECT unnest(kept) AS {key} FROM walk WHERE i = (SELECT max(i) FROM n)
"""


@query(f"""
WITH RECURSIVE w AS (SELECT doc_id, list_distinct({words_sql('lower(text)')}) AS s FROM documents),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.s, b.s)) AS n, len(a.s) AS p, len(b.s) AS q FROM w a JOIN w b ON a.doc_id < b.doc_id AND len(a.s) >= 0.7 * len(b.s) AND len(b.s) >= 0.7 * len(a.s)),
""" + greedy_sql("SELECT doc_id FROM documents", "SELECT a, b FROM x WHERE n / (p + q - n) >= 0.7", "doc_id").lstrip())
def jaccard_dedup(spark, sf):
    return dedup.jaccard_dedup(read(spark, sf, "documents"), "text", "doc_id").select("doc_id")


@query(r"""
WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS t FROM documents),
b AS (SELECT DISTINCT lower(trim(t)) AS t FROM (SELECT unnest(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS t FROM benchmark))
SELECT doc_id, count(*) AS hits FROM s WHERE lower(trim(t)) IN (SELECT t FROM b) GROUP BY doc_id
""")
def decontam_exact(spark, sf):
    lines = lambda df, key: df.select(key, F.explode(F.split(text.strip("text"), r"(?<=[.!?])\s+")).alias("t"))
    own = lines(read(spark, sf, "documents"), "doc_id")
    refs = lines(read(spark, sf, "benchmark"), "item_id")
    clean = dedup.exact_decontaminate(own, refs, "t", "t")
    counts = lambda df, n: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(n))
    return counts(own, "whole").join(counts(clean, "clean"), "doc_id", "left").select("doc_id", (F.col("whole") - F.coalesce("clean", F.lit(0))).alias("hits")).where("hits > 0")


@query(rf"""
WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS t FROM documents),
w AS (SELECT doc_id, list_distinct({words_sql('lower(t)')}) AS s FROM (SELECT DISTINCT doc_id, t FROM s)),
bs AS (SELECT unnest(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS t FROM benchmark),
b AS (SELECT list_distinct({words_sql('lower(t)')}) AS s FROM bs),
hit AS (SELECT DISTINCT doc_id FROM w JOIN b ON len(w.s) > 0 AND len(b.s) > 0 AND len(list_intersect(w.s, b.s)) / (len(w.s) + len(b.s) - len(list_intersect(w.s, b.s))) >= 0.9)
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hit)
""")
def decontam_jaccard(spark, sf):
    docs = read(spark, sf, "documents")
    lines = lambda df, key: df.select(F.col(key).alias("id"), F.explode(F.split(text.strip("text"), r"(?<=[.!?])\s+")).alias("t")).distinct()
    own, refs = lines(docs, "doc_id").withColumn("k", F.xxhash64("t")), lines(read(spark, sf, "benchmark"), "item_id").withColumn("k", F.xxhash64("t"))
    once = records.first_by(own.select("k", "t"), ["k"], "t")
    clean = dedup.jaccard_decontaminate(once, refs.select("k", "t"), "k", "t", "k", "t", 0.9)
    hit = own.join(clean, "k", "left_anti").select(F.col("id").alias("doc_id")).distinct()
    return docs.select("doc_id").join(hit, "doc_id", "left_anti")


@query("WITH RECURSIVE " + greedy_sql("SELECT vec_id FROM embeddings", "SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3", "vec_id"))
def semantic_dedup(spark, sf):
    return similarity.semantic_dedup(vectors(spark, sf), "vec_id", "embedding", 0.3).select("vec_id")


@query("""
WITH r AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE label >= 5)
SELECT vec_id FROM embeddings t WHERE label < 5 AND NOT EXISTS (SELECT 1 FROM r WHERE list_cosine_similarity(t.embedding::DOUBLE[], r.e) >= 0.3)
""")
def semantic_decontam(spark, sf):
    e = vectors(spark, sf)
    return similarity.semantic_decontaminate(e.where("label < 5"), e.where("label >= 5"), "vec_id", "embedding", "vec_id", "embedding", 0.3).select("vec_id")


@query("""
WITH b AS (SELECT t.vec_id, max(list_cosine_similarity(t.embedding::DOUBLE[], r.embedding::DOUBLE[])) AS best FROM embeddings t CROSS JOIN embeddings r WHERE t.label < 5 AND r.label >= 5 GROUP BY 1)
SELECT vec_id, round(1 - best, 6) AS distance, row_number() OVER (ORDER BY round(1 - best, 6), vec_id) / (SELECT count(*) FROM b) AS cdf FROM b
""")
def nn_coverage(spark, sf):
    e = vectors(spark, sf)
    best = similarity.best_similarity(e.where("label < 5"), e.where("label >= 5"), "vec_id", "embedding", "vec_id", "embedding")
    placed = records.with_order(best.select("vec_id", F.round(1 - F.col("best"), 6).alias("distance")), "distance", "vec_id")
    total = placed.agg(F.count(F.lit(1)).alias("total"))
    return placed.crossJoin(F.broadcast(total)).select("vec_id", "distance", ((F.col("ord") + 1) / F.col("total")).alias("cdf"))


@query("""
WITH p AS (SELECT a.label, avg(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS d FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1)
SELECT label, round(d, 6) AS distance FROM p
""")
def avg_cos_dist(spark, sf):
    return similarity.avg_cosine_distance(vectors(spark, sf), "embedding", ["label"]).select("label", F.round("distance", 6).alias("distance"))


# ---- sampling and selection


@query("""
WITH RECURSIVE c AS (SELECT source AS src, count(*) AS n, min(doc_id) AS first_ord FROM documents GROUP BY 1),
b AS (SELECT *, least(CAST(round_even(300 * sqrt(n) / sum(sqrt(n)) OVER (), 0) AS BIGINT), n) AS b FROM c),
d AS (SELECT *, n - b AS room, greatest(0, 300 - sum(b) OVER ()) AS deficit FROM b)
SELECT src, n, first_ord, CAST(b + greatest(0, least(room, deficit - coalesce(sum(room) OVER (ORDER BY n DESC, first_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS budget FROM d
""")
def source_budget(spark, sf):
    counts = read(spark, sf, "documents").groupBy(F.col("source").alias("src")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_ord"))
    return sampling.source_budgets(counts.withColumn("g", F.lit(0)), 300, ["g"]).drop("g")


RANKED = "row_number() OVER (PARTITION BY {by} ORDER BY sha256('{seed}|' || {key}), {key})"


@query(with_base(f"SELECT ord, label FROM (SELECT *, {RANKED.format(by='label', seed=42, key='ord')} AS r FROM claims) WHERE r <= 40"))
def random_sample(spark, sf):
    return sampling.random_select(claims(spark, sf).select("ord", "label"), "label", "ord", 40)


SPLIT = "(CASE WHEN ('0x' || substr(sha256({0}), 1, 16))::UBIGINT % 100 < 90 THEN 'train' WHEN ('0x' || substr(sha256({0}), 1, 16))::UBIGINT % 100 < 95 THEN 'validation' ELSE 'test' END)"


@query(with_base(f"SELECT ord, {SPLIT.format('claim')} AS split FROM claims"))
def hash_split(spark, sf):
    return claims(spark, sf).select("ord", sampling.hash_split("claim").alias("split"))


@query(with_base(f"""
, s AS (SELECT ord, label, {SPLIT.format('claim')} AS split FROM claims),
c AS (SELECT split, label, count(*) AS n FROM s GROUP BY ALL), m AS (SELECT split, min(n) AS least FROM c GROUP BY 1),
r AS (SELECT *, {RANKED.format(by='split, label', seed=0, key='ord')} AS r FROM s)
SELECT ord, label, split FROM r JOIN m USING (split) WHERE r <= least
"""))
def balanced_sample(spark, sf):
    own = claims(spark, sf).select("ord", "label", sampling.hash_split("claim").alias("split"))
    return sampling.balanced(own, "label", "ord")


@query("""
WITH RECURSIVE c AS (SELECT length(CAST(n_chars AS VARCHAR)) AS label, count(*) AS n FROM documents GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY n, label) AS i, count(*) OVER () AS k FROM c),
f(i, rest, label, budget) AS (
  SELECT CAST(0 AS BIGINT), CAST(300 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT)
  UNION ALL
  SELECT o.i, f.rest - least(CASE WHEN o.i = o.k THEN f.rest ELSE f.rest // (o.k - o.i + 1) END, o.n), o.label, least(CASE WHEN o.i = o.k THEN f.rest ELSE f.rest // (o.k - o.i + 1) END, o.n)
  FROM f JOIN o ON o.i = f.i + 1
)
SELECT label, budget FROM f WHERE i > 0
""")
def waterfill(spark, sf):
    """Documents by the digits of their length: classes of very unequal size."""
    d = read(spark, sf, "documents").groupBy(F.length(F.col("n_chars").cast("string")).cast("long").alias("label"))
    return sampling.waterfill(d.agg(F.count(F.lit(1)).alias("n")), 300)


@query(with_base(f"""
, r AS (SELECT ord, quality, {RANKED.format(by='quality', seed=42, key='ord')} AS r, count(*) OVER (PARTITION BY quality) AS n FROM claims)
SELECT ord, quality FROM r WHERE r <= CASE WHEN quality = 0 THEN least(n, 50) ELSE 100 - least((SELECT count(*) FROM claims WHERE quality = 0), 50) END
"""))
def stratified_sample(spark, sf):
    return sampling.stratified(claims(spark, sf).select("ord", "quality"), "quality", "ord", 100)


SAMPLED = f"SELECT ord FROM (SELECT *, {RANKED.format(by='label', seed=42, key='ord')} AS r FROM claims) WHERE r <= 40"


@query(with_base(f", base AS ({SAMPLED}) SELECT ord FROM base UNION ALL SELECT ord FROM claims WHERE ord NOT IN (SELECT ord FROM base) AND len({words_sql('evidence')}) >= 1000"))
def long_augment(spark, sf):
    """The random sample and all claims of long evidence beside it."""
    own = claims(spark, sf)
    return sampling.augment(sampling.random_select(own, "label", "ord", 40), own, "ord", text.word_count("evidence") >= 1000).select("ord")


@query("""
WITH RECURSIVE r AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS MATERIALIZED (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM r),
d AS (SELECT label, i, sum(e[i]) AS s FROM u, range(1, len(e) + 1) AS t(i) GROUP BY ALL),
c AS (SELECT label, list(s ORDER BY i) AS c FROM d GROUP BY 1),
walk AS (
  SELECT 1 AS n, label, [vec_id] AS taken, [e] AS near FROM u JOIN c USING (label)
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(list_dot_product(e, c) / sqrt(list_dot_product(c, c)), 12) DESC, vec_id) = 1
  UNION ALL
  SELECT n + 1, walk.label, list_append(taken, vec_id), list_append(near, e) FROM walk JOIN u ON u.label = walk.label AND NOT list_contains(taken, vec_id) WHERE n < 10
  QUALIFY row_number() OVER (PARTITION BY walk.label ORDER BY round(1 - list_max(list_transform(near, lambda x: list_dot_product(x, e))), 12) DESC, vec_id) = 1
)
SELECT unnest(taken) AS vec_id, label FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC) = 1)
""")
def farthest_point(spark, sf):
    return selection.select(vectors(spark, sf), "farthest", ["label"], "vec_id", "embedding", 10).select("vec_id", "label")


@query("""
WITH RECURSIVE r AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS MATERIALIZED (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM r),
g AS (SELECT label, list(e ORDER BY vec_id) AS g FROM u GROUP BY 1),
s AS MATERIALIZED (SELECT vec_id, label, list_transform(g, lambda x: list_dot_product(x, e)) AS sim FROM u JOIN g USING (label)),
walk AS (
  SELECT 0 AS n, label, CAST([] AS BIGINT[]) AS taken, list_transform(g, lambda x: CAST(-1 AS DOUBLE)) AS best FROM g
  UNION ALL
  SELECT n + 1, walk.label, list_append(taken, vec_id), list_transform(sim, lambda x, i: greatest(x, best[i])) FROM walk JOIN s ON s.label = walk.label AND NOT list_contains(taken, vec_id) WHERE n < 10
  QUALIFY row_number() OVER (PARTITION BY walk.label ORDER BY round(list_sum(list_transform(sim, lambda x, i: greatest(x - best[i], 0))), 9) DESC, vec_id) = 1
)
SELECT unnest(taken) AS vec_id, label FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC) = 1)
""")
def facility_location(spark, sf):
    return selection.select(vectors(spark, sf), "facility", ["label"], "vec_id", "embedding", 10).select("vec_id", "label")


@query()
def kmeans_select(spark, sf):
    return selection.select(vectors(spark, sf), "kmeans", ["label"], "vec_id", "embedding", 10).select("vec_id", "label")


@query()
def kdpp_select(spark, sf):
    return selection.select(vectors(spark, sf), "kdpp", ["label"], "vec_id", "embedding", 10).select("vec_id", "label")


@query()
def vendi(spark, sf):
    return selection.vendi(vectors(spark, sf), ["label"], "vec_id", "embedding")


PAIRS = """
WITH d AS (SELECT a.label, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS distance FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id),
s AS (SELECT label, min(distance) AS low, stddev_samp(distance) * pow(count(*), -0.2) / 64 AS width FROM d GROUP BY 1)
SELECT label, CAST(floor((distance - low) / width) AS BIGINT) AS bin, count(*) AS n FROM d JOIN s USING (label) GROUP BY 1, 2
"""


def pair_distances(spark, sf) -> DataFrame:
    """The distances of up to 100,000 pairs of each label (the plot's own limit)."""
    return similarity.sampled_distances(vectors(spark, sf), "vec_id", "embedding", ["label"]).select("label", F.round("distance", 9).alias("distance"))


@query(PAIRS)
def distance_bins(spark, sf):
    return density.pair_bins(vectors(spark, sf), "vec_id", "embedding", "label")


@query()
def distance_density(spark, sf):
    return density.density(pair_distances(spark, sf), ["label"], "distance")


@query()
def neighbour_graph(spark, sf):
    return layout.neighbours(vectors(spark, sf), "vec_id", "embedding")


@query()
def tsne_layout(spark, sf):
    """All vectors, laid out and marked with the selections that chose them."""
    e = vectors(spark, sf)
    picked = [selection.select(e, m, ["label"], "vec_id", "embedding", 10).select("vec_id", F.lit(m).alias("method")) for m in ("farthest", "kmeans", "facility")]
    member = aggregates.membership(picked[0].unionByName(picked[1]).unionByName(picked[2]), "vec_id", "method", ["farthest", "kmeans", "facility"])
    return layout.tsne(e, "vec_id", "embedding").withColumnRenamed("id", "vec_id").join(member, "vec_id", "left")


@query()
def selection_comparison(spark, sf):
    """Three selections of the vectors side by side, each against all vectors."""
    e = vectors(spark, sf).select(F.col("vec_id").alias("ord"), F.col("label").cast("string").alias("src"), (F.col("label") % 2).cast("string").alias("label"), "embedding")
    picked = [selection.select(e, m, ["src"], "ord", "embedding", 10).withColumn("method", F.lit(m)) for m in ("farthest", "kmeans", "facility")]
    return curation.comparison(picked[0].unionByName(picked[1]).unionByName(picked[2]), e)


@query()
def pca_coverage(spark, sf):
    return selection.pca_coverage(vectors(spark, sf).withColumn("chosen", F.col("label") < 3), "embedding", "chosen")


# ---- aggregates and metrics


@query("SELECT lang, source, count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM documents) AS pct FROM documents GROUP BY 1, 2")
def source_shares(spark, sf):
    return aggregates.shares(read(spark, sf, "documents"), "lang", "source").withColumn("pct", F.col("pct").cast("double"))


@query("SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY 1")
def crosstab(spark, sf):
    return aggregates.crosstab(read(spark, sf, "documents"), "source", "lang", ["en", "de", "fr", "es"])


@query("WITH p AS (SELECT count(*) / (SELECT count(*) FROM documents) AS p FROM documents GROUP BY source) SELECT round(-sum(p * log2(p)), 9) AS entropy FROM p")
def source_entropy(spark, sf):
    return aggregates.entropy(read(spark, sf, "documents"), "source").select(F.round("entropy", 9).alias("entropy"))


@query("WITH p AS (SELECT count(*) / (SELECT count(*) FROM documents) AS p FROM documents GROUP BY lang) SELECT round(1 - sum(abs(p - 1.0 / (SELECT count(*) FROM p))) / 2, 9) AS balance FROM p")
def label_balance(spark, sf):
    return aggregates.label_balance(read(spark, sf, "documents"), "lang").select(F.round("balance", 9).alias("balance"))


@query("""
WITH m AS (SELECT source, avg(n_chars) AS a, CAST(count(DISTINCT lang) AS DOUBLE) AS b FROM documents GROUP BY 1)
SELECT source, round(CASE WHEN max(a) OVER () = min(a) OVER () THEN 1 ELSE (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) END, 9) AS a,
       round(CASE WHEN max(b) OVER () = min(b) OVER () THEN 1 ELSE (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) END, 9) AS b FROM m
""")
def min_max_metrics(spark, sf):
    m = read(spark, sf, "documents").groupBy("source").agg(F.avg("n_chars").alias("a"), F.count_distinct("lang").cast("double").alias("b"))
    return aggregates.min_max(m, ["a", "b"]).select("source", F.round("a", 9).alias("a"), F.round("b", 9).alias("b"))


def predictions(spark, sf) -> DataFrame:
    pred = F.when(F.col("ord") % 7 == 0, F.lit(None)).when(F.col("n_chars") % 2 == 0, "Supported").otherwise("refuted")
    return claims(spark, sf).select("ord", F.col("label").alias("gt_label"), pred.alias("pred_label"), F.col("quality").alias("label"), (F.col("n_chars") % 3).cast("int").alias("pred3"), (F.col("ord") % 3).cast("int").alias("truth3"), (F.col("n_chars") % 2).cast("int").alias("pred2"), ((F.col("n_chars") % 1000) / 1000.0).cast("double").alias("prob"))


@query(with_base("""
, x AS (SELECT lower(label) AS t, CASE WHEN ord % 7 = 0 THEN NULL WHEN n_chars % 2 = 0 THEN 'supported' ELSE 'refuted' END AS p0 FROM claims),
y AS (SELECT t, coalesce(p0, 'refuted') AS p, p0 IS NULL AS u FROM x),
s AS (SELECT count(*) AS n, count(*) FILTER (u) AS unparsed, count(*) FILTER (t = p) AS hit, count(*) FILTER (t = 'supported' AND p = t) AS tp, count(*) FILTER (t = 'supported') AS pt, count(*) FILTER (p = 'supported') AS pp, count(*) FILTER (t = 'refuted' AND p = t) AS tn, count(*) FILTER (t = 'refuted') AS nt FROM y)
SELECT n AS total_samples, unparsed, hit / n AS accuracy, (tp / pt + tn / nt) / 2 AS balanced_accuracy, tp / pp AS precision, tp / pt AS recall, 2 * (tp / pp) * (tp / pt) / (tp / pp + tp / pt) AS f1 FROM s
"""))
def binary_metrics(spark, sf):
    return aggregates.binary_metrics(predictions(spark, sf))


CLASS_SQL = """
, x AS (SELECT {t} AS t, {p} AS p FROM claims), c AS (SELECT unnest({classes}) AS class),
m AS (SELECT class, count(*) FILTER (t = class AND p = class) AS tp, count(*) FILTER (p = class) AS predicted, count(*) FILTER (t = class) AS support FROM c CROSS JOIN x GROUP BY 1),
r AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall FROM m),
k AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM r)
"""


@query(with_base(CLASS_SQL.format(t="ord % 3", p="n_chars % 3", classes="[0, 1, 2]") + "SELECT CAST(class AS INTEGER) AS class, tp, predicted, support, precision, recall, f1 FROM k"))
def class_metrics(spark, sf):
    return aggregates.class_metrics(predictions(spark, sf), [0, 1, 2], "truth3", "pred3")


@query(with_base(CLASS_SQL.format(t="quality", p="n_chars % 2", classes="[0, 1]") + """
SELECT round(sum(tp) / sum(support), 9) AS accuracy, round(avg(f1) FILTER (support > 0 OR predicted > 0), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1, round(avg(recall) FILTER (support > 0), 9) AS balanced_accuracy,
       round((SELECT (count(*) FILTER (t = 1 AND p = 1)::DOUBLE * count(*) FILTER (t = 0 AND p = 0) - count(*) FILTER (t = 0 AND p = 1)::DOUBLE * count(*) FILTER (t = 1 AND p = 0)) / sqrt(count(*) FILTER (p = 1)::DOUBLE * count(*) FILTER (t = 1) * count(*) FILTER (t = 0) * count(*) FILTER (p = 0)) FROM x), 9) AS mcc FROM k
"""))
def multiclass_metrics(spark, sf):
    got = aggregates.multiclass_metrics(predictions(spark, sf), [0, 1], "label", "pred2")
    return got.select(*[F.round(c, 9).alias(c) for c in got.columns])


@query(with_base("""
, x AS (SELECT CAST((n_chars % 1000) / 1000.0 AS DOUBLE) AS p, lower(label) AS l FROM claims), y AS (SELECT *, CASE l WHEN 'supported' THEN p ELSE 1 - p END AS o, greatest(p, 1 - p) AS c FROM x)
SELECT round(avg(p), 9) AS prob_mean, round(stddev_pop(p), 9) AS prob_std, round(median(p), 9) AS prob_median, round(min(c), 9) AS conf_min, round(max(c), 9) AS conf_max, round(avg(o), 9) AS correct_mean, round(stddev_pop(o), 9) AS correct_std, round(median(o), 9) AS correct_median,
       round(avg(p) FILTER (l = 'supported'), 9) AS supported_mean, round(avg(p) FILTER (l = 'refuted'), 9) AS refuted_mean FROM y
"""))
def score_stats(spark, sf):
    got = aggregates.score_stats(predictions(spark, sf), "prob", "gt_label")
    return got.select(*[F.round(c, 9).alias(c) for c in got.columns])


@query(with_base(f"SELECT min(n) AS min, round(avg(n), 9) AS mean, median(n) AS median, max(n) AS max FROM (SELECT len({words_sql('evidence')}) AS n FROM claims)"))
def token_stats(spark, sf):
    return aggregates.token_stats(claims(spark, sf), "evidence").withColumn("mean", F.round("mean", 9))


NR = "max(n) FILTER (r = round_even({0} / 100.0 * (c - 1), 0) + 1) AS p{0}"


@query(with_base(f"""
, s AS (SELECT {SPLIT.format('claim')} AS split, length(evidence) AS n, claim, quality FROM claims),
r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY n) AS r, count(*) OVER (PARTITION BY split) AS c FROM s)
SELECT split, count(*) AS n, min(n) AS len_min, max(n) AS len_max, round(avg(n), 6) AS len_mean, round(stddev_pop(n), 6) AS len_std, count(DISTINCT claim) AS claims, count(DISTINCT quality) AS labels, '0:' || count(*) FILTER (quality = 0) || ',1:' || count(*) FILTER (quality = 1) AS label_counts, {', '.join(NR.format(p) for p in (25, 50, 75, 95, 99))}
FROM r GROUP BY split
"""))
def split_stats(spark, sf):
    own = claims(spark, sf).select("evidence", "quality", text.hash16("claim").alias("claim_hash"), sampling.hash_split("claim").alias("split"))
    got = aggregates.split_stats(own, "evidence", "quality", "claim_hash")
    listed = F.array_join(F.transform(F.array(F.lit(0), F.lit(1)), lambda k: F.concat(k.cast("string"), F.lit(":"), F.coalesce(F.try_element_at(F.col("label_counts"), k.cast("double")), F.lit(0)).cast("string"))), ",")
    return got.withColumn("label_counts", listed).withColumns({"len_mean": F.round("len_mean", 6), "len_std": F.round("len_std", 6)})


@query(with_base("""
, x AS (SELECT lower(label) AS t, CAST((n_chars % 1000) / 1000.0 AS DOUBLE) AS p FROM claims)
SELECT t AS gt, CASE WHEN p >= 0.5 THEN 'supported' ELSE 'refuted' END AS pred_label, count(*) AS n, round(avg(CASE WHEN p >= 0.5 THEN p ELSE 1 - p END), 9) AS confidence, round(avg(CASE WHEN t = 'supported' THEN p ELSE 1 - p END), 9) AS correctness FROM x GROUP BY 1, 2
"""))
def nli_results(spark, sf):
    got = aggregates.nli_results(predictions(spark, sf).drop("pred_label"), "prob")
    return got.groupBy(F.lower("gt_label").alias("gt"), "pred_label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("pred_confidence"), 9).alias("confidence"), F.round(F.avg("correctness_confidence"), 9).alias("correctness"))


@query(with_base("SELECT count(*) AS total_samples, round(avg(CAST(n_chars % 5 AS DOUBLE)), 9) AS mean_num_turns, round(avg((n_chars % 2)::DOUBLE), 9) AS frac_exited_early, round(avg(CASE WHEN ord % 3 = 0 THEN NULL ELSE (n_chars % 1000) / 1000.0 END), 9) AS mean_frac_yes_decisive FROM claims"))
def evaluation_means(spark, sf):
    own = predictions(spark, sf).join(claims(spark, sf).select("ord", (F.col("n_chars") % 5).alias("num_turns")), "ord")
    own = own.withColumns({"early": F.col("pred2") == 1, "decisive": F.when(F.col("truth3") != 0, F.col("prob"))})
    got = aggregates.evaluation_metrics(own, {"mean_num_turns": "num_turns", "frac_exited_early": "early", "mean_frac_yes_decisive": "decisive"})
    return got.select("total_samples", *[F.round(c, 9).alias(c) for c in ("mean_num_turns", "frac_exited_early", "mean_frac_yes_decisive")])


#: The selections that are compared: a random sample, a stratified one, and the random one with long evidence.
SELECTED = f"""
, strata AS (SELECT ord, quality, {RANKED.format(by='quality', seed=42, key='ord')} AS r, count(*) OVER (PARTITION BY quality) AS n FROM claims),
base AS ({SAMPLED}),
s AS (
  SELECT ord, 'a' AS method FROM base
  UNION ALL SELECT ord, 'b' FROM strata WHERE r <= CASE WHEN quality = 0 THEN least(n, 50) ELSE 100 - least((SELECT count(*) FROM claims WHERE quality = 0), 50) END
  UNION ALL SELECT ord, 'c' FROM base UNION ALL SELECT ord, 'c' FROM claims WHERE ord NOT IN (SELECT ord FROM base) AND len({words_sql('evidence')}) >= 1000
)
"""


def chosen(spark, sf) -> DataFrame:
    parts = {"a": random_sample, "b": stratified_sample, "c": long_augment}
    each = [f(spark, sf).select("ord", F.lit(m).alias("method")) for m, f in parts.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query(with_base(SELECTED + """
, x AS (SELECT s.method, c.src, c.lang FROM s JOIN claims c USING (ord)),
a AS (SELECT method, count(*) / sum(count(*)) OVER (PARTITION BY method) AS p, sum(count(*)) OVER (PARTITION BY method) AS rows FROM x GROUP BY method, src),
b AS (SELECT method, count(*) / sum(count(*)) OVER (PARTITION BY method) AS p, count(*) OVER (PARTITION BY method) AS k FROM x GROUP BY method, lang)
SELECT x.method, CAST(x.rows AS BIGINT) AS rows, round(x.e, 9) AS entropy, round(y.b, 9) AS balance
FROM (SELECT method, max(rows) AS rows, -sum(p * log2(p)) AS e FROM a GROUP BY 1) x JOIN (SELECT method, 1 - sum(abs(p - 1.0 / k)) / 2 AS b FROM b GROUP BY 1) y USING (method)
"""))
def method_report(spark, sf):
    own = chosen(spark, sf).join(claims(spark, sf).select("ord", "src", "lang"), "ord")
    return aggregates.method_report(own, "method", "src", "lang").select("method", "rows", F.round("entropy", 9).alias("entropy"), F.round("balance", 9).alias("balance"))


@query(with_base(SELECTED + ", f AS (SELECT ord, max((method = 'a')::INT) AS a, max((method = 'b')::INT) AS b FROM s WHERE method IN ('a', 'b') GROUP BY 1) SELECT 'a' AS method_a, 'b' AS method_b, CAST(sum(a * b) AS BIGINT) AS both, CAST(sum(a * (1 - b)) AS BIGINT) AS only_a, CAST(sum((1 - a) * b) AS BIGINT) AS only_b, sum(a * b) / count(*) AS jaccard FROM f"))
def method_overlap(spark, sf):
    return aggregates.set_overlap(chosen(spark, sf), "ord", "method", "a", "b")


@query(with_base(SELECTED + "SELECT ord, CASE WHEN count(DISTINCT method) = 3 THEN 'All' ELSE string_agg(DISTINCT method, ' + ' ORDER BY method) END AS membership FROM s GROUP BY 1"))
def method_membership(spark, sf):
    return aggregates.membership(chosen(spark, sf), "ord", "method", ["a", "b", "c"])


@query(with_base(SELECTED + "SELECT ord FROM s GROUP BY 1 HAVING count(DISTINCT method) = 3"))
def method_common(spark, sf):
    return aggregates.common_items(chosen(spark, sf), "ord", "method")


@query("SELECT sum(n_chars)::BIGINT AS input_tokens, sum(doc_id % 100)::BIGINT AS output_tokens, sum(n_chars + doc_id % 100)::BIGINT AS total_tokens, sum(n_chars) * 0.25 / 1e6 + sum(doc_id % 100) * 2.0 / 1e6 AS cost FROM documents")
def usage_cost(spark, sf):
    d = read(spark, sf, "documents").select(F.col("n_chars").alias("input_tokens"), (F.col("doc_id") % 100).alias("output_tokens"), (F.col("n_chars") + F.col("doc_id") % 100).alias("total_tokens"))
    return aggregates.usage_cost(d, 0.25, 2.0)


# ---- generations

GEN = r"""
WITH gen AS (
  SELECT conv_id, '<think>plan</think>' || string_agg(CASE role WHEN 'user' THEN '<question>' || text || '</question>' WHEN 'assistant' THEN '<answer>' || text || '</answer>' ELSE '<think>' || text || '</think>' END, '' ORDER BY turn)
    || '<verification>' || CASE conv_id % 3 WHEN 0 THEN 'Supported' WHEN 1 THEN 'refuted' ELSE 'Mixed' END || '</verification>' || CASE WHEN conv_id % 5 = 0 THEN ' tail' ELSE '' END AS generation,
    't' || string_agg(CASE role WHEN 'user' THEN 'q' WHEN 'assistant' THEN 'a' ELSE 't' END, '' ORDER BY turn) || 'v' AS letters
  FROM conversations GROUP BY conv_id
)
"""


def generations(spark, sf) -> DataFrame:
    piece = F.when(F.col("role") == "user", F.concat(F.lit("<question>"), "text", F.lit("</question>"))).when(F.col("role") == "assistant", F.concat(F.lit("<answer>"), "text", F.lit("</answer>"))).otherwise(F.concat(F.lit("<think>"), "text", F.lit("</think>")))
    whole = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", piece.alias("p")))), lambda x: x["p"]), "").alias("body"))
    end = F.when(F.col("conv_id") % 3 == 0, "Supported").when(F.col("conv_id") % 3 == 1, "refuted").otherwise("Mixed")
    tail = F.when(F.col("conv_id") % 5 == 0, " tail").otherwise("")
    return whole.select("conv_id", F.concat(F.lit("<think>plan</think>"), "body", F.lit("<verification>"), end, F.lit("</verification>"), tail).alias("generation"))


STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@query(f"""
SELECT q.conv_id, CAST(row_number() OVER (PARTITION BY q.conv_id ORDER BY q.turn) AS INTEGER) AS index, {STRIP.format('q.text')} AS question,
       coalesce((SELECT arg_min({STRIP.format('a.text')}, a.turn) FROM conversations a WHERE a.conv_id = q.conv_id AND a.role = 'assistant' AND a.turn > q.turn), '[No answer found]') AS answer
FROM conversations q WHERE q.role = 'user'
""")
def qa_pairs(spark, sf):
    return generations(spark, sf).select("conv_id", F.explode(tags.qa_pairs("generation")).alias("x")).select("conv_id", "x.*")


@query(GEN + """
SELECT conv_id, (1 + (letters LIKE '%q%')::INT + (letters LIKE '%a%')::INT + (length(letters) - length(replace(letters, 't', '')) >= 2)::INT + 1 + (conv_id % 3 <> 1)::INT + (conv_id % 5 <> 0)::INT + (regexp_matches(letters, '^t(t|qa)*v$') AND letters LIKE '%qa%')::INT) / 8.0 AS reward FROM gen
""")
def format_reward(spark, sf):
    return generations(spark, sf).select("conv_id", tags.format_reward("generation").alias("reward"))


@query(GEN + "SELECT conv_id, (conv_id % 3 = 1)::INT::DOUBLE AS score, CASE conv_id % 3 WHEN 0 THEN 'Supported' WHEN 1 THEN 'refuted' ELSE 'Mixed' END AS label, CASE conv_id % 3 WHEN 0 THEN 'supported' WHEN 1 THEN 'refuted' END AS parsed FROM gen")
def verification_reward(spark, sf):
    r = tags.verification_reward("generation", F.lit("Refuted"))
    return generations(spark, sf).select("conv_id", r["score"].alias("score"), r["label"].alias("label"), tags.verification_label("generation").alias("parsed"))


@query("""
WITH c AS (SELECT conv_id, count(*) FILTER (role = 'user') AS g, conv_id % 4 AS t FROM conversations GROUP BY 1), r AS (SELECT *, g / greatest(t, 1) AS r FROM c)
SELECT conv_id, CAST(CASE WHEN r <= 0 THEN 0 WHEN r <= 1 THEN r WHEN r <= 2 THEN 2 - r ELSE 0 END AS DOUBLE) AS reward FROM r
""")
def count_reward(spark, sf):
    got = generations(spark, sf).select("conv_id", rewards.question_count_reward(F.size(tags.qa_pairs("generation")), F.col("conv_id") % 4).alias("reward"))
    return got.withColumn("reward", F.col("reward").cast("double"))


REPLIES = ["Supported", " refuted.\n", "<verdict>Refuted</verdict> supported", "not_supported <verdict>x</verdict>", "it is [SUPPORTED]", "supported, then refuted", "refuted then supported words", "nothing", "refuted maybe supported", "<verdict>Supported</verdict><verdict> refuted </verdict>", ""]
REPLY_SQL = "WITH r AS (SELECT doc_id, list_extract([" + ", ".join("'" + r.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for r in REPLIES) + f"], CAST(doc_id % {len(REPLIES)} + 1 AS INTEGER)) AS t FROM documents)"


def replies(spark, sf) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, REPLIES)), (F.col("doc_id") % len(REPLIES) + 1).cast("int")).alias("t"))


@query(REPLY_SQL + r"""
, x AS (SELECT doc_id, t, lower(t) AS g, lower(trim(string_split(string_split(t, '<verdict>')[-1], '</verdict>')[1])) AS tag, lower(regexp_replace(t, '^\s+|\s+$', '', 'g')) AS s, lower(trim(string_split(string_split(t, '<verdict>')[2], '</verdict>')[1])) AS cot FROM r),
y AS (SELECT *, list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '') AS w, CASE WHEN contains(g, 'supported') THEN length(g) - strpos(reverse(g), 'detroppus') ELSE -1 END AS ls, CASE WHEN contains(g, 'refuted') THEN length(g) - strpos(reverse(g), 'detufer') ELSE -1 END AS lr FROM x),
z AS (SELECT *, CASE WHEN s IN ('supported', 'refuted') THEN s WHEN contains(s, 'supported') AND NOT contains(s, 'refuted') THEN 'supported' WHEN contains(s, 'refuted') AND NOT contains(s, 'supported') THEN 'refuted' WHEN w[1] IN ('supported', 'refuted') THEN w[1] WHEN w[-1] IN ('supported', 'refuted') THEN w[-1] END AS plain FROM y)
SELECT doc_id, CASE WHEN tag IN ('supported', 'refuted') THEN tag WHEN contains(g, 'not_supported') THEN 'refuted' WHEN contains(g, '[supported]') THEN 'supported' WHEN ls = -1 AND lr = -1 THEN NULL WHEN ls - 9 > lr - 7 THEN 'supported' ELSE 'refuted' END AS verdict,
       plain, CASE WHEN cot IN ('supported', 'refuted') THEN cot ELSE plain END AS cot,
       CASE WHEN contains(g, 'supported') THEN 0 WHEN contains(g, 'refuted') THEN 1 WHEN contains(g, 'not enough') OR contains(g, 'not_enough') THEN 2 END AS code,
       CASE WHEN contains(g, 'supported') THEN 'supported' WHEN contains(g, 'refuted') THEN 'refuted' ELSE 'not enough information' END AS coverage FROM z
""")
def verdict_cascade(spark, sf):
    return replies(spark, sf).select("doc_id", tags.verdict_tag("t").alias("verdict"), tags.prompted_label("t").alias("plain"), tags.prompted_label("t", cot=True).alias("cot"), tags.coverage_code("t").alias("code"), tags.coverage_verdict("t").alias("coverage"))


VOTE = "array_to_string(list_transform(range(1, CAST(doc_id % 5 + 1 AS BIGINT)), lambda k: 'A' || k || ': ' || list_extract(['Yes', 'no', 'UNKNOWN'], CAST((doc_id + k * n_chars) % 3 + 1 AS INTEGER))), chr(10))"


@query(f"""
WITH g AS (SELECT doc_id, {VOTE} AS t FROM documents), v AS (SELECT doc_id, list_transform(regexp_extract_all(t, '(?m)^A\\d+: (\\w+)', 1), lambda x: lower(x)) AS votes FROM g),
n AS (SELECT doc_id, votes, len(list_filter(votes, lambda x: x = 'yes')) AS y, len(list_filter(votes, lambda x: x = 'no')) AS n FROM v)
SELECT doc_id, CASE WHEN len(votes) = 0 THEN NULL WHEN y + n > 0 AND y * 2 >= y + n THEN 'supported' ELSE 'refuted' END AS verdict, CASE WHEN len(votes) > 0 THEN y / greatest(y + n, 1) END AS yes_share, array_to_string(votes, ',') AS votes FROM n
""")
def claimdecomp_vote(spark, sf):
    lines = F.transform(F.slice(F.sequence(F.lit(1), F.lit(5)), 1, (F.col("doc_id") % 5).cast("int")), lambda k: F.concat(F.lit("A"), k.cast("string"), F.lit(": "), F.element_at(F.array(F.lit("Yes"), F.lit("no"), F.lit("UNKNOWN")), ((F.col("doc_id") + k * F.col("n_chars")) % 3 + 1).cast("int"))))
    got = read(spark, sf, "documents").select("doc_id", F.array_join(lines, "\n").alias("t"))
    votes = tags.answer_votes("t")
    return got.select("doc_id", tags.vote_verdict(votes).alias("verdict"), tags.yes_share(votes).alias("yes_share"), F.array_join(votes, ",").alias("votes"))


@query(with_base(r"""
, q AS (SELECT ord, list_filter(list_transform(string_split(regexp_replace(evidence, '[.,]?\s+', ' ', 'g'), ' '), lambda w: lower(regexp_replace(w, '[\s"''`.,;:!?]+', ' ', 'g'))), lambda w: trim(w) <> '') AS w FROM claims)
SELECT ord, least(100, len(list_distinct(list_transform(w, lambda x: trim(x))))) AS n FROM q
"""))
def subquestion_parse(spark, sf):
    w = F.filter(F.transform(F.split(F.regexp_replace("evidence", r"[.,]?\s+", " "), " "), lambda x: F.regexp_replace(F.lower(x), r"""[\s"'`.,;:!?]+""", " ")), lambda x: F.trim(x) != "")
    asked = F.array_join(F.transform(w, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x, F.lit("?"))), " ")
    return claims(spark, sf).select("ord", F.size(tags.subquestions(asked, 100)).alias("n"))


def judged(spark, sf) -> DataFrame:
    """Questions with stub verdicts from hashes."""
    qa = generations(spark, sf).select(F.col("conv_id").alias("prompt_id"), F.lit(0).alias("gen_idx"), "generation")
    h = lambda *c: F.conv(F.substring(F.sha2(F.concat_ws("|", *c), 256), 1, 4), 16, 10).cast("int")
    q = rewards.questions(qa).withColumn("answer", F.when(F.col("index") % 3 == 0, "I don't know.").otherwise(F.col("answer")))
    stub = h("question", "answer")
    return q.withColumns({"answerable": F.when(stub % 7 == 0, F.lit(None)).otherwise(stub % 2), "correct": (stub % 3 == 0).cast("int"), "criteria": F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: (stub / F.pow(F.lit(2), k)).cast("int") % 2)})


JUDGED = f"""
, q AS (
  SELECT c.conv_id AS prompt_id, CAST(row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS INTEGER) AS index, {STRIP.format('c.text')} AS question,
         coalesce((SELECT arg_min({STRIP.format('a.text')}, a.turn) FROM conversations a WHERE a.conv_id = c.conv_id AND a.role = 'assistant' AND a.turn > c.turn), '[No answer found]') AS answer0
  FROM conversations c WHERE c.role = 'user'),
j0 AS (SELECT prompt_id, index, question, CASE WHEN index % 3 = 0 THEN 'I don''t know.' ELSE answer0 END AS answer FROM q),
j1 AS (SELECT *, ('0x' || substr(sha256(question || '|' || answer), 1, 4))::INT AS stub FROM j0),
j AS (SELECT *, index % 3 = 0 AS idk, CASE WHEN stub % 7 = 0 THEN NULL ELSE stub % 2 END AS answerable, (stub % 3 = 0)::INT AS correct, ((stub // 2) % 2 + (stub // 4) % 2 + (stub // 8) % 2 + (stub // 16) % 2 + (stub // 32) % 2) / 5.0 AS atomic FROM j1),
s AS (SELECT *, CASE WHEN answerable IS NULL THEN 0 WHEN idk THEN (answerable = 0)::INT ELSE (answerable = 1)::INT END AS able FROM j)
"""


@query(GEN.strip() + JUDGED + "SELECT prompt_id, round(avg(able), 9) AS answerable, round(avg(correct), 9) AS correct, round(avg(atomic), 9) AS atomic, round(avg(able * atomic * CASE WHEN idk THEN 1 ELSE correct END), 9) AS joint FROM s GROUP BY 1")
def joint_quality(spark, sf):
    q = judged(spark, sf)
    able, right, atomic = rewards.answerable_score(F.col("answer"), F.col("answerable")), rewards.correct_score(F.col("correct")), rewards.atomic_score(F.col("criteria"))
    joint = rewards.joint_score(F.col("answer"), F.col("answerable"), F.col("criteria"), F.col("correct"))
    return q.groupBy("prompt_id").agg(F.round(F.avg(able), 9).alias("answerable"), F.round(F.avg(right), 9).alias("correct"), F.round(F.avg(atomic), 9).alias("atomic"), F.round(F.avg(joint), 9).alias("joint"))


NECESSITY = """
, a AS (SELECT prompt_id, list(answer ORDER BY index) AS l, count(*) AS n FROM s GROUP BY 1),
k AS (SELECT prompt_id, n, l, unnest(range(0, n + 1)) AS left_out FROM a),
w AS (SELECT prompt_id, n, left_out, array_to_string(list_filter(list_transform(range(1, n + 1), lambda i: CASE WHEN i = left_out THEN NULL ELSE l[i] END), lambda x: x IS NOT NULL), '|') AS t FROM k),
v AS (SELECT prompt_id, n, left_out, list_extract(['supported', 'refuted', 'not enough information'], CAST(('0x' || substr(sha256(t), 1, 4))::INT % 3 + 1 AS INTEGER)) AS verdict FROM w),
f AS (SELECT prompt_id, verdict AS full_v FROM v WHERE left_out = 0),
x AS (SELECT v.prompt_id, v.n, verdict, full_v, CASE v.prompt_id % 2 WHEN 0 THEN 'supported' ELSE 'refuted' END AS truth FROM v JOIN f USING (prompt_id) WHERE left_out > 0)
SELECT prompt_id, round(avg(CASE WHEN n = 1 THEN (full_v = truth)::INT WHEN full_v = truth AND verdict <> truth THEN 1 WHEN full_v = truth THEN 0.5 WHEN verdict = truth THEN -1 ELSE 0 END), 9) AS supervised,
       CAST(min(CASE WHEN n = 1 THEN 1 WHEN verdict <> full_v THEN 1 ELSE 0 END) AS DOUBLE) AS unsupervised FROM x GROUP BY 1
"""


@query(GEN.strip() + JUDGED + NECESSITY)
def necessity_loo(spark, sf):
    loo = rewards.leave_one_out(judged(spark, sf))
    code = F.conv(F.substring(F.sha2(F.array_join("answers", "|"), 256), 1, 4), 16, 10).cast("int") % 3 + 1
    v = loo.withColumns({"verdict": F.element_at(F.array(*map(F.lit, ("supported", "refuted", "not enough information"))), code), "truth": F.when(F.col("prompt_id") % 2 == 0, "Supported").otherwise("Refuted")})
    a = rewards.necessity(v, True).select("prompt_id", F.round("score", 9).alias("supervised"))
    return a.join(rewards.necessity(v, False, "min").select("prompt_id", F.round("score", 9).alias("unsupervised")), "prompt_id")


@query("""
WITH v AS (SELECT doc_id // 4 AS prompt_id, CAST(doc_id % 4 AS INTEGER) AS gen_idx, list_extract(['supported', 'refuted', NULL], CAST(n_chars % 3 + 1 AS INTEGER)) AS v FROM documents),
c AS (SELECT prompt_id, v, count(*) AS n FROM v WHERE v IS NOT NULL GROUP BY 1, 2), m AS (SELECT prompt_id, v AS majority FROM c QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY n DESC, v) = 1)
SELECT prompt_id, gen_idx, coalesce((v = CASE WHEN prompt_id % 2 = 0 THEN 'refuted' ELSE majority END)::INT::DOUBLE, 0) AS score FROM v LEFT JOIN m USING (prompt_id)
""")
def coverage_vote(spark, sf):
    d = read(spark, sf, "documents")
    verdict = F.when(F.col("n_chars") % 3 == 0, "supported").when(F.col("n_chars") % 3 == 1, "refuted")
    own = d.select(F.floor(F.col("doc_id") / 4).alias("prompt_id"), (F.col("doc_id") % 4).cast("int").alias("gen_idx"), verdict.alias("verdict"))
    return rewards.coverage(own.withColumns({"truth": F.lit("Refuted"), "sup": F.col("prompt_id") % 2 == 0}), "verdict", "truth", "sup")


@query("""
WITH e AS (SELECT vec_id // 5 AS prompt_id, 0 AS gen_idx, vec_id % 5 AS i, embedding::DOUBLE[] AS v FROM embeddings),
m AS (SELECT a.prompt_id, a.i, max(list_dot_product(a.v, b.v)) AS best FROM e a JOIN e b ON a.prompt_id = b.prompt_id AND b.i < a.i GROUP BY 1, 2),
n AS (SELECT prompt_id, count(*) AS n FROM e GROUP BY 1)
SELECT n.prompt_id, 0 AS gen_idx, round(CASE WHEN n.n <= 1 THEN -1 ELSE -sum(m.best) / n.n END, 9) AS margin FROM n LEFT JOIN m USING (prompt_id) GROUP BY n.prompt_id, n.n
""")
def question_margin(spark, sf):
    e = vectors(spark, sf).select(F.floor(F.col("vec_id") / 5).alias("prompt_id"), F.lit(0).alias("gen_idx"), (F.col("vec_id") % 5).cast("int").alias("index"), "embedding")
    return rewards.margin_reward(e, "embedding", "embedding").select("prompt_id", "gen_idx", F.round("score", 9).alias("margin"))


@query()
def question_diversity(spark, sf):
    e = vectors(spark, sf).select(F.floor(F.col("vec_id") / 5).alias("prompt_id"), F.lit(0).alias("gen_idx"), (F.col("vec_id") % 5).cast("int").alias("index"), "embedding")
    a = rewards.margin_reward(e, "embedding", "embedding").withColumnRenamed("score", "margin")
    return a.join(rewards.vendi_reward(e, "embedding").withColumnRenamed("score", "vendi"), rewards.KEY)


# ---- logs, caches, joins


def logs(spark, sf) -> DataFrame:
    c = claims(spark, sf)
    prompt = F.when(F.col("ord") % 11 == 0, "old prompt").otherwise(render(TASKS["question_answerable"], document=F.col("evidence"), question=F.col("claim")))
    reply = F.when(F.col("ord") % 5 == 0, "maybe").otherwise(F.concat(F.lit(" "), (F.col("ord") % 2).cast("string"), F.lit("\n")))
    doc = F.when(F.col("ord") % 13 == 0, " ").otherwise(F.col("evidence"))
    raw = F.to_json(F.struct(F.when(F.col("ord") % 7 == 0, "other").otherwise("judge").alias("judge_model_id"), prompt.alias("prompt"), doc.alias("document"), F.col("claim").alias("question"), reply.alias("extracted_response")))
    return c.select("ord", F.col("src").alias("source_run"), F.lpad(F.col("ord").cast("string"), 9, "0").alias("path"), F.when(F.col("ord") % 17 == 0, F.lit("{broken")).otherwise(raw).alias("raw"))


STATUS = "CASE WHEN ord % 17 = 0 THEN 'json_err' WHEN ord % 7 = 0 THEN 'wrong_judge_model' WHEN ord % 13 = 0 OR claim = '' THEN 'missing_input' WHEN ord % 11 = 0 THEN 'prompt_mismatch' WHEN ord % 5 = 0 THEN 'unparseable_response' ELSE 'ok' END"


def gated(spark, sf) -> DataFrame:
    return judgelog.gate(judgelog.read_logs(logs(spark, sf)), "question_answerable", "judge", render(TASKS["question_answerable"], document=F.col("document"), question=F.col("question")))


@query(with_base(f"SELECT {STATUS} AS status, count(*) AS n FROM claims GROUP BY 1"))
def judge_log_gate(spark, sf):
    return judgelog.reject_counts(gated(spark, sf))


JUDGED = with_base(f"""
, t AS (SELECT 'Document: ' || evidence || chr(10) || 'Question: ' || claim AS text, CAST(ord % 2 AS INTEGER) AS label, ord, src, evidence FROM claims WHERE {STATUS} = 'ok'),
h AS (SELECT substr(sha256(text), 1, 16) AS text_hash, substr(sha256(evidence), 1, 16) AS claim_hash, {SPLIT.format('evidence')} AS split, label, src AS source_run, row_number() OVER (PARTITION BY text ORDER BY src, lpad(ord::VARCHAR, 9, '0')) AS r FROM t)
SELECT text_hash, claim_hash, split, label, source_run FROM h WHERE r = 1
""")


@query(JUDGED)
def judge_dataset(spark, sf):
    return judgelog.dataset(gated(spark, sf), "question_answerable").select("text_hash", "claim_hash", "split", "label", "source_run")


@query(JUDGED)
def judge_ingest(spark, sf):
    """The rows of ``judge_dataset`` by a stream over files of logs, two files to a batch, stopped and started again."""
    folder = run_folder(spark)
    own = logs(spark, sf).select("raw", "path", "source_run").repartition(6)
    for _ in range(2):
        own.write.mode("append").parquet(f"{folder}/logs")  # the second time the same rows arrive again
        arriving = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/logs")
        prompt = render(TASKS["question_answerable"], document=F.col("document"), question=F.col("question"))
        judge_stream.ingest(arriving, f"{folder}/table", f"{folder}/state", "question_answerable", "judge", prompt).awaitTermination()
    return judge_stream.current(spark, f"{folder}/table").select("text_hash", "claim_hash", "split", "label", "source_run")


@query("""
WITH c AS (SELECT user_id AS key, value, ts, event_id FROM events)
SELECT key, arg_max(value, (ts, event_id)) AS value, count(*) AS n FROM c GROUP BY 1
""")
def cache_upsert(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").alias("key"), "value", "ts", "event_id")
    latest = records.first_by(e, ["key"], -F.unix_micros(F.col("ts").cast("timestamp")), -F.col("event_id")).select("key", "value")
    return latest.join(e.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")


@query("SELECT count(*) FILTER (doc_id % 3 = 0) AS hits, count(*) FILTER (doc_id % 3 <> 0) AS misses FROM documents")
def cache_stats(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("key"))
    return providers.cache_stats(d, d.where("key % 3 = 0"), "key")


@query("SELECT doc_id AS key FROM documents WHERE doc_id % 3 <> 0")
def cache_misses(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("key"))
    return records.misses(d, d.where("key % 3 = 0"), "key")


@query("SELECT doc_id, source, n_chars FROM documents WHERE n_chars >= 200 AND source IN (SELECT DISTINCT source FROM documents WHERE lang = 'en')")
def sqlite_scan(spark, sf):
    """Documents as databases, one for each partition, read again in ranges of row ids; long documents of the sources that have English ones."""
    local_files.register(spark)
    folder, d = run_folder(spark), read(spark, sf, "documents")
    local_files.write_sqlite_parts(d.select("doc_id", "source", "n_chars"), folder, "documents")
    own = local_files.lookup(spark, "sqlite", "n_chars >= 200", path=folder, table="documents", rows=1_000)
    return own.join(d.where("lang = 'en'").select("source").distinct(), "source", "left_semi").select("doc_id", "source", "n_chars")


@query("SELECT vec_id, label, len(embedding) AS n, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings WHERE label > 2")
def npz_scan(spark, sf):
    """Vectors as numpy archives, one for each partition, read again in slabs."""
    local_files.register(spark)
    folder = run_folder(spark)
    local_files.write_npz_parts(vectors(spark, sf).select("vec_id", "label", "embedding"), folder)
    return local_files.lookup(spark, "npz", "label > 2", path=folder, rows=100).select("vec_id", F.col("label").cast("int").alias("label"), F.size("embedding").cast("long").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


@query("""
SELECT doc_id AS key, CASE WHEN doc_id % 17 <> 0 AND doc_id % 19 <> 0 THEN upper(source) END AS value,
       CASE WHEN doc_id % 17 = 0 THEN 'refused' WHEN doc_id % 19 = 0 THEN 'exhausted' ELSE 'ok' END AS status,
       CASE WHEN doc_id % 17 = 0 THEN 1 WHEN doc_id % 19 = 0 THEN 4 ELSE doc_id % 4 + 1 END AS attempts
FROM documents
""")
def provider_replies(spark, sf):
    """A model that is busy up to three times for each key, refuses some and never answers others, asked for every document."""

    def call(request: str, seen: dict[str, int] = {}) -> str:  # noqa: B006 - attempts of this worker's keys
        key, source = request.split(" ", 1)
        seen[key] = seen.get(key, 0) + 1
        if int(key) % 17 == 0:
            raise providers.Refused(key)
        if int(key) % 19 == 0 or seen[key] <= int(key) % 4:
            raise TimeoutError(key)
        return source.upper()

    d = read(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.concat_ws(" ", "doc_id", "source").alias("request"))
    limits = providers.Limits(attempts=4, wait=0.0001, most_wait=0.001)
    return providers.replies(d, "key", "request", "value", "string", call, limits).select("key", "value", "status", F.col("attempts").cast("long").alias("attempts"))


@query("SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.k')) AS with_k, count(*) FILTER (json_valid(props)) AS valid FROM events GROUP BY 1")
def json_props(spark, sf):
    e = read(spark, sf, "events").withColumn("v", F.expr("try_parse_json(props)"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.expr("try_variant_get(v, '$.k', 'string')")).alias("with_k"), F.count("v").alias("valid"))


@query("""
SELECT conv_id, regexp_replace(string_agg('## ' || role || chr(10) || text || chr(10) || chr(10), '' ORDER BY turn), '^\\s+|\\s+$', '', 'g') AS evidence FROM conversations GROUP BY 1
""".replace("\\\\", "\\"))
def evidence_assembly(spark, sf):
    c = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("s"))
    return c.select("conv_id", records.section_evidence("s", "role", "text").alias("evidence"))


@query("""
WITH kb AS (SELECT upper(source) AS id, count(*) || ' texts' AS text FROM documents GROUP BY 1),
e AS (SELECT doc_id, unnest([source, lang, 'src' || (doc_id % 30)]) AS entity, unnest([0, 1, 2]) AS place FROM documents),
f AS (SELECT doc_id, lower(entity) AS entity, min(place) AS place FROM e GROUP BY 1, 2)
SELECT d.doc_id, h.evidence FROM documents d LEFT JOIN (SELECT doc_id, string_agg(kb.text, chr(10) ORDER BY place) AS evidence FROM f JOIN kb ON lower(kb.id) = f.entity GROUP BY 1) h ON h.doc_id = d.doc_id
""")
def kb_lookup(spark, sf):
    d = read(spark, sf, "documents")
    kb = d.groupBy(F.upper("source").alias("id")).agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(" texts")).alias("text"))
    own = d.select("doc_id", F.array("source", "lang", F.concat(F.lit("src"), (F.col("doc_id") % 30).cast("string"))).alias("entities"))
    return records.entity_evidence(own, kb, "doc_id", "entities", "id", "text").select("doc_id", "evidence")


@query(with_base("""
SELECT ord, CASE WHEN ord % 2 = 0 THEN ord % 4 ELSE ord % 5 + 10 END AS num_of_questions FROM claims WHERE ord % 2 = 0 OR ord % 3 <> 0 UNION ALL SELECT ord, NULL FROM claims WHERE ord % 2 <> 0 AND ord % 3 = 0
"""))
def decomp_merge(spark, sf):
    c = claims(spark, sf).select("ord", F.when(F.col("ord") % 2 == 0, F.col("ord") % 4).alias("num_of_questions"))
    more = c.where("ord % 3 <> 0").select("ord", (F.col("ord") % 5 + 10).alias("num_of_questions"))
    return records.coalescing_join(c, more, "ord", ["num_of_questions"])


@query("""
SELECT conv_id AS id, CAST(least(3, conv_id % 5) AS INTEGER) AS num_turns, conv_id % 5 <= 2 AS exited_early, CASE conv_id % 2 WHEN 0 THEN 'supported' ELSE 'refuted' END AS pred_label FROM (SELECT DISTINCT conv_id FROM conversations)
""")
def qacheck_loop(spark, sf):
    """The loop with a stub model: enough after ``id % 5`` turns."""
    c = read(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.max("turn").alias("t"))
    own = c.select("id", F.concat(F.lit("claim "), F.col("id").cast("string")).alias("claim"), F.lit("text").alias("evidence"))

    def reply(prompt: Column) -> Column:
        k = F.regexp_extract(prompt, r"claim (\d+)", 1)
        n = k.try_cast("int")
        asked = F.size(F.regexp_extract_all(prompt, F.lit(r"(?m)^Q\d+: "), F.lit(0)))
        return (
            F.when(F.contains(prompt, F.lit("<enough>")), F.concat(F.lit("<enough>"), F.when(asked >= n % 5, "Yes").otherwise("No"), F.lit("</enough>")))
            .when(F.contains(prompt, F.lit("<question>")), "<question>Is it so?</question>")
            .when(F.contains(prompt, F.lit("<answer>")), "<answer>Yes</answer>")
            .otherwise(F.concat(F.lit("<verdict>"), F.when(n % 2 == 0, "Supported").otherwise("Refuted"), F.lit("</verdict>")))
        )

    return qacheck.run(own, reply, 3).select("id", "num_turns", "exited_early", "pred_label")


MARKDOWN = r"""
WITH d AS (SELECT doc_id, source, lang, translate(text, chr(160) || chr(9) || chr(8216) || chr(8217) || chr(8220) || chr(8221) || chr(8222), '  ' || chr(39) || chr(39) || chr(34) || chr(34) || chr(34)) AS t FROM documents)
SELECT doc_id, '| Source and language | Text |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || source || ' / ' || lang || ' | ' || regexp_replace(regexp_replace(regexp_replace(t, '[\x{200B}-\x{200D}\x{FEFF}]', '', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g') || ' |' AS markdown FROM d
"""


@query(MARKDOWN)
def html_to_markdown(spark, sf):
    """Each document as an HTML table with a break inside a cell and its text escaped (twice, since references are decoded before and while parsing)."""
    safe = F.col("text")
    for _ in range(2):
        safe = F.replace(F.replace(F.replace(safe, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<div><table><tr><th>Source<br/>and  language</th><th>Text</th></tr><tr><td>"), "source", F.lit(" / "), "lang", F.lit("<td>"), safe, F.lit("</table></div>"))
    return read(spark, sf, "documents").select("doc_id", table_markdown(page).alias("markdown"))


@query(with_base(corpus_rows.records_sql(f"len({words_sql('evidence')})")))
def corpus_records(spark, sf):
    """Every claim in the fields of each corpus, with the corpus's labels in turn, as claim records."""
    return corpus_rows.records(claims(spark, sf).select("ord", "claim", "evidence", "src", "lang"))


@query()
def curation_plan(spark, sf):
    """The whole plan at its defaults: rules, entities, scorer, near-duplicates and benchmark claims, decompositions, selection, long evidence.

    Cache tables stand in for models: longer words are entities, hash digits are scores and vectors.
    """
    own = stored(claims(spark, sf).withColumn("id", F.col("ord").cast("string")))
    tests = read(spark, sf, "benchmark").select(F.col("item_id").alias("ord"), F.element_at(F.split(text.strip("text"), r"(?<=[.!?])\s+", 2), 1).alias("claim"))
    names = own.select("claim", F.array_distinct(F.filter(text.words("claim"), lambda w: F.length(w) > 4)).alias("all_entities"))
    digits = lambda c, k: F.conv(F.substring(c, 4 * k + 1, 4), 16, 10).cast("double")
    scores = own.select(providers.pair_key(F.col("evidence"), F.col("claim")).alias("key")).distinct().select("key", (digits(F.col("key"), 0) / 65536).alias("prob"))
    hashed = F.sha2("claim", 256)
    vec = own.select("claim").unionByName(tests.select("claim")).distinct().select("claim", F.array(*[digits(hashed, k) / 32768 - 1 for k in range(16)]).alias("embedding"))
    lists = own.select("claim", F.transform(text.words("claim"), lambda w: F.concat(w, F.lit("?"))).alias("decomposed_questions")).distinct()
    counts = lists.select("claim", F.size("decomposed_questions").alias("num_of_questions"))
    kept = stored(curation.scored(curation.entities(curation.rules(own), names), scores))
    kept = stored(curation.decomposed(curation.semantic(kept, vec, tests), counts, lists))
    picked = curation.selected(kept, vec, "farthest")
    return curation.augmented(picked, kept).select("ord", "src", "label", "num_of_questions")
