"""Summaries and metrics; all are partial aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.text import word_count, zero_div


def removal_summary(before: DataFrame, after: DataFrame, by: str = "src") -> DataFrame:
    """Before, removed, after and percent removed of each source, and a TOTAL row."""
    marked = before.select(by, F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select(by, F.lit(0).alias("b"), F.lit(1).alias("a")))
    sums = marked.rollup(by).agg(F.sum("b").alias("before"), F.sum("a").alias("after"), F.grouping(by).alias("g"))
    return sums.select(
        F.when(F.col("g") == 1, "TOTAL").otherwise(F.col(by)).alias(by),
        "before",
        (F.col("before") - F.col("after")).alias("removed"),
        "after",
        F.coalesce(F.try_divide(100.0 * (F.col("before") - F.col("after")), F.col("before")), F.lit(0.0)).alias("pct_removed"),
    )


def removal_counts(df: DataFrame, keep: Column, by: str = "src") -> DataFrame:
    """As ``removal_summary`` of the rows that hold ``keep``, in one pass over ``df``."""
    kept = F.coalesce(keep, F.lit(False)).cast("int")
    sums = df.select(by, kept.alias("k")).rollup(by).agg(F.count(F.lit(1)).alias("before"), F.sum("k").alias("after"), F.grouping(by).alias("g"))
    removed = F.col("before") - F.coalesce("after", F.lit(0))
    return sums.select(
        F.when(F.col("g") == 1, "TOTAL").otherwise(F.col(by)).alias(by), "before", removed.alias("removed"), F.coalesce("after", F.lit(0)).alias("after"),
        F.coalesce(F.try_divide(100.0 * removed, F.col("before")), F.lit(0.0)).alias("pct_removed"),
    )


def shares(df: DataFrame, *by: str) -> DataFrame:
    """Rows and percent of each value."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(*by, "n", (100.0 * F.col("n") / F.col("total")).alias("pct"))


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts by two columns, zero where there are none."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(str(v)) for v in values])


def binary_metrics(df: DataFrame, truth: str = "gt_label", pred: str = "pred_label") -> DataFrame:
    """Accuracy, balanced accuracy, precision, recall and F1 of ``supported``; a missing prediction counts as refuted; 0 for empty denominators."""
    t, p = F.lower(F.col(truth)), F.coalesce(F.lower(F.col(pred)), F.lit("refuted"))
    pos = lambda c: c == "supported"
    s = df.select(t.alias("t"), p.alias("p"), F.col(pred).isNull().alias("u")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("u").alias("unparsed"), F.count_if(F.col("t") == F.col("p")).alias("hit"),
        F.count_if(pos(F.col("t")) & pos(F.col("p"))).alias("tp"), F.count_if(pos(F.col("t"))).alias("pt"), F.count_if(pos(F.col("p"))).alias("pp"),
        F.count_if((F.col("t") == "refuted") & (F.col("p") == "refuted")).alias("tn"), F.count_if(F.col("t") == "refuted").alias("nt"),
    )
    precision, recall = zero_div(F.col("tp"), F.col("pp")), zero_div(F.col("tp"), F.col("pt"))
    classes = (F.col("pt") > 0).cast("int") + (F.col("nt") > 0).cast("int")
    return s.select(
        F.col("n").alias("total_samples"), "unparsed", zero_div(F.col("hit"), F.col("n")).alias("accuracy"),
        zero_div(recall + zero_div(F.col("tn"), F.col("nt")), classes).alias("balanced_accuracy"),
        precision.alias("precision"), recall.alias("recall"), zero_div(2 * precision * recall, precision + recall).alias("f1"),
    )


def class_metrics(df: DataFrame, classes: list[int], truth: str = "label", pred: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support of each class."""
    cells = df.groupBy(F.col(truth).cast("int").alias("t"), F.col(pred).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    each = cells.select("t", "p", "n", F.explode(F.array(*map(F.lit, classes))).alias("class"))
    hit = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    c = F.col("class")
    sums = each.groupBy("class").agg(hit((F.col("t") == c) & (F.col("p") == c)).alias("tp"), hit(F.col("t") == c).alias("support"), hit(F.col("p") == c).alias("predicted"))
    precision, recall = zero_div(F.col("tp"), F.col("predicted")), zero_div(F.col("tp"), F.col("support"))
    return sums.select("class", "tp", "predicted", "support", precision.alias("precision"), recall.alias("recall"), zero_div(2 * precision * recall, precision + recall).alias("f1"))


def multiclass_metrics(df: DataFrame, classes: list[int], truth: str = "label", pred: str = "pred") -> DataFrame:
    """Accuracy, macro and weighted F1 over the classes seen, balanced accuracy over those in the truth, and Matthews' coefficient for two classes."""
    per = class_metrics(df, classes, truth, pred)
    seen = (F.col("support") > 0) | (F.col("predicted") > 0)
    out = per.agg(
        zero_div(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.coalesce(F.avg(F.when(seen, F.col("f1"))), F.lit(0.0)).alias("macro_f1"),
        zero_div(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("recall"))), F.lit(0.0)).alias("balanced_accuracy"),
        *([F.max_by("tp", "class").alias("tp"), F.min_by("tp", "class").alias("tn"), F.max_by("predicted", "class").alias("pp"), F.min_by("predicted", "class").alias("pn"), F.max_by("support", "class").alias("sp"), F.min_by("support", "class").alias("sn")] if len(classes) == 2 else []),
    )
    if len(classes) != 2:
        return out
    d = lambda c: F.col(c).cast("double")
    fp, fn = d("pp") - d("tp"), d("sp") - d("tp")
    mcc = zero_div(d("tp") * d("tn") - fp * fn, F.sqrt(d("pp") * d("sp") * d("sn") * d("pn")))
    return out.withColumn("mcc", mcc).drop("tp", "tn", "pp", "pn", "sp", "sn")


def score_stats(df: DataFrame, prob: str, label: str) -> DataFrame:
    """Mean, population deviation and median of a probability and of the probability of the own label; confidence range; means by label."""
    p = F.col(prob)
    conf, own = F.greatest(p, 1 - p), F.when(F.lower(F.col(label)) == "supported", p).otherwise(1 - p)
    return df.agg(
        F.avg(p).alias("prob_mean"), F.stddev_pop(p).alias("prob_std"), F.percentile(p, 0.5).alias("prob_median"),
        F.min(conf).alias("conf_min"), F.max(conf).alias("conf_max"),
        F.avg(own).alias("correct_mean"), F.stddev_pop(own).alias("correct_std"), F.percentile(own, 0.5).alias("correct_median"),
        F.avg(F.when(F.lower(F.col(label)) == "supported", p)).alias("supported_mean"), F.avg(F.when(F.lower(F.col(label)) == "refuted", p)).alias("refuted_mean"),
    )


def token_stats(df: DataFrame, text: str) -> DataFrame:
    n = word_count(text)
    return df.agg(F.min(n).alias("min"), F.avg(n).alias("mean"), F.percentile(n, 0.5).alias("median"), F.max(n).alias("max"))


def nearest_rank(df: DataFrame, value: Column, by: list[str], percents: list[int]) -> DataFrame:
    """Values at place ``round(p / 100 * (n - 1))``, halves to even, of each group's ascending values.

    Equal values are counted first, so a place is found from prefix sums over
    distinct values and a group with many rows is never sorted whole.
    """
    counts = df.groupBy(*by, value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy("v")
    placed = counts.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    at = lambda p: F.bround(F.lit(p / 100.0) * (F.col("total") - 1), 0)
    return placed.groupBy(*by).agg(*[F.min(F.when(F.col("upto") > at(p), F.col("v"))).alias(f"p{p}") for p in percents])


def split_stats(df: DataFrame, text: str, label: str, claim_hash: str, by: str = "split") -> DataFrame:
    """Rows, text-length percentiles, mean and population deviation, distinct claims and labels of each split, and its rows by label (rounded to two places)."""
    n = F.length(text)
    base = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.min(n).alias("len_min"), F.max(n).alias("len_max"), F.avg(n).alias("len_mean"), F.stddev_pop(n).alias("len_std"),
        F.count_distinct(claim_hash).alias("claims"), F.count_distinct(F.round(F.col(label).cast("double"), 2)).alias("labels"),
    )
    each = df.groupBy(by, F.round(F.col(label).cast("double"), 2).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    histogram = each.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("label_counts"))  # a row per label
    return base.join(nearest_rank(df, n, [by], [25, 50, 75, 95, 99]), by).join(histogram, by)


def entropy(df: DataFrame, by: str) -> DataFrame:
    """Base-2 entropy of the values of ``by``."""
    p = F.col("pct") / 100.0
    return shares(df, by).agg((-F.sum(p * F.log2(p))).alias("entropy"))


def label_balance(df: DataFrame, by: str) -> DataFrame:
    """``1 - sum(abs(p - 1/k)) / 2`` over the ``k`` values of ``by``."""
    got = shares(df, by)
    k = got.agg(F.count(F.lit(1)).alias("k"))
    return got.crossJoin(F.broadcast(k)).agg((1 - F.sum(F.abs(F.col("pct") / 100.0 - 1.0 / F.col("k"))) / 2).alias("balance"))


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column scaled to 0 to 1; constants become 1. The range is one aggregate row, so no task gathers the table."""
    low = df.agg(*[x for c in columns for x in (F.min(c).alias(f"__lo_{c}"), F.max(c).alias(f"__hi_{c}"))])
    scaled = {c: F.when(F.col(f"__hi_{c}") == F.col(f"__lo_{c}"), 1.0).otherwise((F.col(c) - F.col(f"__lo_{c}")) / (F.col(f"__hi_{c}") - F.col(f"__lo_{c}"))) for c in columns}
    return df.crossJoin(F.broadcast(low)).withColumns(scaled).select(*df.columns)


def majority_vote(df: DataFrame, by: list[str], vote: str) -> DataFrame:
    """The most frequent vote of each group, of equally frequent ones the smallest; null votes don't count."""
    counts = df.where(F.col(vote).isNotNull()).groupBy(*by, vote).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.min_by(vote, F.struct(-F.col("n"), F.col(vote))).alias("majority"))


def set_overlap(df: DataFrame, item: str, method: str, a: str, b: str) -> DataFrame:
    """Sizes of two selections' intersection, differences and Jaccard similarity."""
    flags = df.where(F.col(method).isin(a, b)).groupBy(item).agg(F.max((F.col(method) == a).cast("int")).alias("a"), F.max((F.col(method) == b).cast("int")).alias("b"))
    s = flags.agg(F.sum(F.col("a") * F.col("b")).alias("both"), F.sum(F.col("a") * (1 - F.col("b"))).alias("only_a"), F.sum((1 - F.col("a")) * F.col("b")).alias("only_b"))
    return s.select(F.lit(a).alias("method_a"), F.lit(b).alias("method_b"), "both", "only_a", "only_b", zero_div(F.col("both"), F.col("both") + F.col("only_a") + F.col("only_b")).alias("jaccard"))


def membership(df: DataFrame, item: str, method: str, methods: list[str]) -> DataFrame:
    """Which selections hold each item: ``All`` or their names joined by `` + ``."""
    got = df.groupBy(item).agg(F.array_sort(F.collect_set(method)).alias("m"))
    return got.select(item, F.when(F.size("m") == len(methods), "All").otherwise(F.array_join("m", " + ")).alias("membership"))


def usage_cost(df: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """Summed token counters and their price per million."""
    s = df.agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("total_tokens").alias("total_tokens"))
    return s.withColumn("cost", F.col("input_tokens") * price_in / 1e6 + F.col("output_tokens") * price_out / 1e6)


def nli_results(df: DataFrame, prob: str = "minicheck_prob", threshold: float = 0.5) -> DataFrame:
    """Scorer rows with the predicted label, its confidence, and the probability of the true label."""
    p = F.col(prob)
    return df.withColumns({
        "pred_label": F.when(p >= threshold, "supported").otherwise("refuted"),
        "pred_confidence": F.when(p >= threshold, p).otherwise(1 - p),
        "correctness_confidence": F.when(F.lower("gt_label") == "supported", p).otherwise(1 - p),
    })


def evaluation_metrics(df: DataFrame, means: dict[str, str]) -> DataFrame:
    """Classification metrics and the means of the columns that ``means`` names, nulls left out."""
    extra = df.agg(*[F.avg(F.col(c).cast("double")).alias(name) for name, c in means.items()])
    return binary_metrics(df).crossJoin(F.broadcast(extra))


def common_items(df: DataFrame, item: str, method: str) -> DataFrame:
    """Items that all selections hold."""
    total = df.agg(F.count_distinct(method).alias("methods"))
    got = df.groupBy(item).agg(F.count_distinct(method).alias("n"))
    return got.crossJoin(F.broadcast(total)).where("n = methods").select(item)


def method_report(df: DataFrame, method: str, source: str, label: str) -> DataFrame:
    """Rows, source entropy and label balance of each selection."""
    def share(by: str) -> DataFrame:
        counts = df.groupBy(method, by).agg(F.count(F.lit(1)).alias("n"))
        total = counts.groupBy(method).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
        return counts.join(total, method).withColumn("p", F.col("n") / F.col("total"))

    a = share(source).groupBy(method).agg(F.max("total").alias("rows"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))
    b = share(label).groupBy(method).agg((1 - F.sum(F.abs(F.col("p") - 1.0 / F.col("k"))) / 2).alias("balance"))
    return a.join(b, method)
