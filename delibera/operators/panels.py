"""Panel statistics: agreement, dissent, overlap and reliability of raters within groups.

Groups without enough raters give no rows. Ratios with an empty denominator are null. Minimum supports are parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rater_signs(df: DataFrame, group: list[str], rater: str, topic: str, sign: str) -> DataFrame:
    """Sign of the summed signs of each rater on each topic of a group."""
    return df.groupBy(*group, rater, topic).agg(F.signum(F.sum(sign)).cast("int").alias("s"))


def contested(signs: DataFrame, group: list[str], topic: str) -> DataFrame:
    """Topics of a group with two or more raters; ``contested`` where both signs occur."""
    by = signs.groupBy(*group, topic).agg(F.count(F.lit(1)).alias("raters"), F.max(F.col("s") == 1).alias("_p"), F.max(F.col("s") == -1).alias("_n"))
    return by.where("raters >= 2").select(*group, topic, "raters", (F.col("_p") & F.col("_n")).alias("contested"))


def one_way_icc(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Intraclass correlation ICC(1,1) of groups with two or more values, from mergeable moments of each group."""
    g = df.where(F.col(value).isNotNull()).groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), (F.coalesce(F.var_pop(value), F.lit(0.0)) * F.count(value)).alias("ss")).where("n >= 2")
    t = g.agg(
        F.count(F.lit(1)).alias("j"), F.sum("n").alias("total"), F.sum("ss").alias("ssw"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("n") * F.col("m")).alias("s1"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2")
    ).where("j >= 2")
    msb = (F.col("s2") - F.col("s1") * F.col("s1") / F.col("total")) / (F.col("j") - 1)
    msw = F.col("ssw") / (F.col("total") - F.col("j"))
    n0 = (F.col("total") - F.col("n2") / F.col("total")) / (F.col("j") - 1)
    t = t.withColumn("msb", msb).withColumn("msw", msw).withColumn("n0", n0)
    return t.select(
        F.col("j").alias("groups"),
        "total",
        "msb",
        "msw",
        "n0",
        F.try_divide(F.col("msb") - F.col("msw"), F.col("msb") + (F.col("n0") - 1) * F.col("msw")).alias("icc"),
        F.sqrt(F.col("msw")).alias("sd_within"),
        F.sqrt(F.greatest(F.lit(0.0), (F.col("msb") - F.col("msw")) / F.col("n0"))).alias("sd_between"),
    )


def mean_gap(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Mean |difference| over all pairs within groups, without making the pairs.

    In sorted order a value is the larger of a pair as often as rows stand before it, and the smaller as often as
    stand behind: the sum of all gaps is the sum of value * rows of it * (before - behind). Equal values are counted
    together first, so the windows run over the values that occur, not over the rows.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*group)
    upto, n = F.sum("_c").over(w.orderBy(value)), F.sum("_c").over(w)
    x = c.select(*group, (F.col(value) * F.col("_c") * ((upto - F.col("_c")) - (n - upto))).alias("_g"), n.alias("_n"))
    by = x.groupBy(*group).agg(F.sum("_g").alias("_s"), F.first("_n").alias("_n"))
    return by.agg((F.sum("_s") / F.nullif(F.sum(F.col("_n") * (F.col("_n") - 1) / 2), F.lit(0.0))).alias("mean_gap"), F.sum(F.col("_n") * (F.col("_n") - 1) / 2).cast("long").alias("pairs"))


def normalized_entropy(df: DataFrame, group: list[str], level: str) -> DataFrame:
    """Shannon entropy of the levels of a group over its maximum; 0 where there is one level."""
    c = df.groupBy(*group, level).agg(F.count(F.lit(1)).alias("_c"))
    p = F.col("_c") / F.sum("_c").over(Window.partitionBy(*group))
    return c.withColumn("_p", p).groupBy(*group).agg(F.sum("_c").alias("n"), F.count(F.lit(1)).alias("levels"), F.when(F.count(F.lit(1)) > 1, -F.sum(F.col("_p") * F.ln("_p")) / F.ln(F.count(F.lit(1)))).otherwise(0.0).alias("entropy"))


def set_overlap(df: DataFrame, group: list[str], rater: str, item: str) -> DataFrame:
    """(group, jaccard, pairs): the Jaccard likeness of the item sets of the raters of a group, with the pairs that have it.

    Raters of one set are a class, and classes are compared, not raters: for a list of k items a group has 2^k classes at
    most, however many its raters are. Null raters have no pairs; a null item is none; two empty sets are unlike.
    """
    sets = df.where(F.col(rater).isNotNull()).groupBy(*group, rater).agg(F.sort_array(F.collect_set(item)).alias("s"))
    c = sets.groupBy(*group, "s").agg(F.count(F.lit(1)).alias("c"))
    a, b = (c.select(*group, F.col("s").alias(f"s{k}"), F.col("c").alias(f"c{k}")) for k in "ab")
    both = a.join(b, group).where("sa <= sb")
    pairs = F.when(F.col("sa") == F.col("sb"), (F.col("ca") * (F.col("ca") - 1) / 2).cast("long")).otherwise(F.col("ca") * F.col("cb"))
    like = F.coalesce(F.try_divide(F.size(F.array_intersect("sa", "sb")), F.size(F.array_union("sa", "sb"))), F.lit(0.0))
    return both.select(*group, like.alias("jaccard"), pairs.alias("pairs")).where("pairs > 0")
