"""Deterministic samples: by hash order within strata, quotas, quantile grids, evenly spaced picks.

Every sample is a function of the rows and the seed alone, so a task that runs again picks the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from delibera.functions.text import hash_order
from delibera.operators.sequence import quantile_bins, ranked_within


def per_stratum(df: DataFrame, strata: list[str], key: str, n: int, seed: str) -> DataFrame:
    """The first ``n`` of each stratum in hash order."""
    w = Window.partitionBy(*strata).orderBy(hash_order(seed, key), key)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def of_all(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    return df.orderBy(hash_order(seed, key), key).limit(n)


def quota(df: DataFrame, strata: str, key: str, total: int, seed: str) -> DataFrame:
    """``total`` rows shared out by stratum size: floors first, what is left to the largest remainders (ties: by name)."""
    sizes = df.groupBy(strata).agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy()
    exact = F.col("_c") * F.lit(total) / F.sum("_c").over(whole)
    s = sizes.withColumn("_e", exact).withColumn("_q", F.floor("_e"))
    s = s.withColumn("_q", F.col("_q") + (F.row_number().over(whole.orderBy((F.col("_e") - F.col("_q")).desc(), strata)) <= F.lit(total) - F.sum("_q").over(whole)).cast("long"))
    w = Window.partitionBy(strata).orderBy(hash_order(seed, key), key)
    return df.withColumn("_rn", F.row_number().over(w)).join(s.select(strata, "_q"), strata).where("_rn <= _q").drop("_rn", "_q")


def quantile_grid(df: DataFrame, x: str, y: str, key: str, bins: int, per_cell: int, seed: str) -> DataFrame:
    """``per_cell`` rows of each cell of a grid of rank quantiles."""
    a = quantile_bins(df, [x, key], bins).withColumnRenamed("bin", "bx")
    b = quantile_bins(a, [y, key], bins).withColumnRenamed("bin", "by")
    return per_stratum(b, ["bx", "by"], key, per_cell, seed)


def evenly_spaced(df: DataFrame, strata: list[str], by: list[str], n: int) -> DataFrame:
    """``n`` rows of each stratum, evenly spaced along its order, both ends included; all rows of smaller strata."""
    p = ranked_within(df, strata, by)
    picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.bround(k * (F.col("n") - 1) / F.lit(max(1, n - 1)), 0).cast("long"))
    return p.where((F.col("n") <= n) | F.array_contains(picks, F.col("pos").cast("long"))).drop("pos", "n")


def priority_fill(df: DataFrame, priority: str, key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows, lower ``priority`` first, hash order within."""
    return df.orderBy(priority, hash_order(seed, key), key).limit(n)


def first_claims(df: DataFrame, category: str, item: str, score: str, n: int) -> DataFrame:
    """Top ``n`` items of each category by score; an item goes to its first category by name only."""
    own = df.groupBy(item).agg(F.min(category).alias(category))
    w = Window.partitionBy(category).orderBy(F.desc(score), item)
    return df.join(own, [item, category]).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
