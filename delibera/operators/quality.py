"""Data-quality rules: each gives the rows that break it, or counts of them. Nothing is dropped silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count. Null keys count as a key."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dangling(df: DataFrame, ref: str, target: DataFrame, key: str) -> DataFrame:
    """Rows whose non-null reference names nothing in ``target``."""
    return df.where(F.col(ref).isNotNull()).join(target.select(F.col(key).alias(ref)).distinct(), ref, "left_anti")


def broken_rules(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, key) for every row and rule that isn't true for it; a null outcome breaks a rule. One scan for all rules."""
    marks = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return df.select(F.col(key), F.explode(F.array_compact(marks)).alias("rule")).select("rule", key)


def share_over(df: DataFrame, key: str, ceiling: float) -> DataFrame:
    """Values that hold more than ``ceiling`` of all rows."""
    total = max(1, df.count())
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / F.lit(total)).where(F.col("share") > ceiling)


def partition_faults(whole: DataFrame, parts: DataFrame, key: str, part: str) -> DataFrame:
    """Keys of ``whole`` in no part or in several, and keys of parts that ``whole`` hasn't."""
    p = parts.groupBy(key).agg(F.count_distinct(part).alias("parts"))
    j = whole.select(key).distinct().withColumn("_w", F.lit(True)).join(p, key, "full_outer")
    fault = F.when(F.col("_w").isNull(), "foreign").when(F.col("parts").isNull(), "missing").when(F.col("parts") > 1, "several")
    return j.select(key, fault.alias("fault")).where("fault IS NOT NULL")


def confusion(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    return df.groupBy(expected, predicted).agg(F.count(F.lit(1)).alias("n"))


def ordinal_least(values: Column, scale: list[str]) -> Column:
    """The least of an array of labels on an ordered scale; labels off the scale don't count."""
    order = F.array(*[F.lit(s) for s in scale])
    at = F.array_min(F.filter(F.transform(values, lambda v: F.array_position(order, v)), lambda p: p > 0))
    return F.try_element_at(order, at.cast("int"))
