"""Budgets, hash splits and balanced or random samples; hash order stands in for a random generator, so a rerun gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.text import hash16_mod

#: The selection's rows, and percent bounds of the split.
BUDGET, TRAIN, VALID = 5_000, 90, 95


def source_budgets(counts: DataFrame, budget: int, by: list[str], source: str = "src", n: str = "n", first: str = "first_ord") -> DataFrame:
    """A share of ``budget`` for each source by the square root of its count.

    A source gets at most its rows; a deficit from rounding goes to the largest
    sources (the first met of equal ones), a surplus stays. The table has a row per
    source, so its windows are small.
    """
    whole = Window.partitionBy(*by)
    share = F.bround(F.lit(float(budget)) * F.sqrt(n) / F.sum(F.sqrt(n)).over(whole), 0).cast("long")
    base = counts.withColumn("b", F.least(share, F.col(n)))
    base = base.withColumn("deficit", F.greatest(F.lit(0), budget - F.sum("b").over(whole))).withColumn("room", F.col(n) - F.col("b"))
    before = F.coalesce(F.sum("room").over(whole.orderBy(F.desc(n), first).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return base.withColumn("budget", F.col("b") + F.greatest(F.lit(0), F.least(F.col("room"), F.col("deficit") - before))).drop("b", "deficit", "room")


def hash_order(key: Column | str, seed: int = 42) -> Column:
    """A fixed random order: the hash of seed and key."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), (F.col(key) if isinstance(key, str) else key).cast("string")), 256)


def take_per_group(df: DataFrame, by: list[str], quota: DataFrame | int, order: Column, key: str, quota_col: str = "budget") -> DataFrame:
    """The first rows of each group in ``order``, as many as its quota.

    A group is ranked in parts by the leading hash digits: whole parts below the
    quota are taken by prefix sums and only the part at the border is ranked, so no
    task sorts a whole group.
    """
    staged = df.withColumn("__o", order).withColumn("__part", F.substring("__o", 1, 3))
    staged = staged.withColumn(quota_col, F.lit(quota)) if isinstance(quota, int) else staged.join(quota.select(*by, quota_col), by)
    sums = staged.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__part")) - F.col("__n")
    starts = sums.withColumn("__before", before).drop("__n")
    ranked = staged.join(starts, [*by, "__part"]).where(F.col("__before") < F.col(quota_col))
    place = F.row_number().over(Window.partitionBy(*by, "__part").orderBy("__o", key))
    return ranked.withColumn("__r", place).where(F.col("__before") + F.col("__r") <= F.col(quota_col)).drop("__o", "__part", "__before", "__r", *([quota_col] if quota_col not in df.columns else []))


def random_select(df: DataFrame, label: str, key: str, per_label: int, seed: int = 42) -> DataFrame:
    """As many rows of each label, without replacement; all of a label with fewer."""
    return take_per_group(df, [label], per_label, hash_order(key, seed), key)


def hash_split(claim: Column | str) -> Column:
    """train, valid or test by the claim's hash, 90 / 5 / 5."""
    m = hash16_mod(claim, 100)
    return F.when(m < TRAIN, "train").when(m < VALID, "validation").otherwise("test")


def balanced(df: DataFrame, label: str, key: str, split: str = "split", seed: int = 0) -> DataFrame:
    """In each split as many rows of each label as its rarest label has."""
    counts = df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))
    least = counts.groupBy(split).agg(F.min("n").alias("budget"))
    quota = counts.join(least, split).select(split, label, "budget")
    return take_per_group(df, [split, label], quota, hash_order(key, seed), key)


def waterfill(counts: DataFrame, target: int, group: str = "label", n: str = "n") -> DataFrame:
    """A quota for each class: from the smallest class on, an equal share of what is left, capped by its rows; the last takes the rest.

    One row per class is folded; classes are few by nature.
    """
    listed = counts.agg(F.array_sort(F.collect_list(F.struct(F.col(n).cast("long").alias("n"), F.col(group).alias("g")))).alias("c"))
    empty = F.array().cast(f"array<struct<g:{counts.schema[group].dataType.simpleString()},budget:bigint>>")
    k = F.size("c")
    filled = F.aggregate(
        "c",
        F.struct(F.lit(target).cast("long").alias("rest"), F.lit(0).alias("i"), empty.alias("out")),
        lambda a, x: F.struct(
            (a["rest"] - F.least(F.when(a["i"] == k - 1, a["rest"]).otherwise(F.floor(a["rest"] / (k - a["i"]))), x["n"])).alias("rest"),
            (a["i"] + 1).alias("i"),
            F.concat(a["out"], F.array(F.struct(x["g"].alias("g"), F.least(F.when(a["i"] == k - 1, a["rest"]).otherwise(F.floor(a["rest"] / (k - a["i"]))), x["n"]).alias("budget")))).alias("out"),
        ),
        lambda a: a["out"],
    )
    return listed.select(F.explode(filled).alias("x")).select(F.col("x.g").alias(group), F.col("x.budget").alias("budget"))


def stratified(df: DataFrame, label: str, key: str, target: int, seed: int = 42) -> DataFrame:
    """``target`` rows (or all), rare labels whole and the others equally, by ``waterfill``. Float labels that are not whole raise an error."""
    if df.schema[label].dataType.typeName() in ("float", "double"):
        bad = F.raise_error(F.lit("labels must be whole numbers")).cast("double")
        df = df.withColumn(label, F.when(F.col(label) == F.floor(label), F.col(label)).otherwise(bad))
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return take_per_group(df, [label], waterfill(counts, target, label), hash_order(key, seed), key)


def augment(base: DataFrame, pool: DataFrame, key: str, keep: Column) -> DataFrame:
    """``base`` and the rows of ``pool`` that hold ``keep`` and are not in it."""
    more = pool.where(keep).join(base.select(key), key, "left_anti")
    return base.unionByName(more.select(*base.columns))
