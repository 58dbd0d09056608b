"""Ordered-sequence operators: every function takes a frame with its group and order columns named.

A row of the sequence is any row of the frame; ties of the order column are broken by the columns that follow it in
``order``. Nulls in the measured column form a level of their own. An empty frame gives an empty frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delibera.runtime import cut


def ranked(df: DataFrame, order: list) -> tuple[DataFrame, int]:
    """``df`` with ``rank0``, its place from 0 in the order of all rows, and the number of rows.

    Rows are cut by range into pieces, numbered within each, and raised by the sizes of the pieces before, of which
    there are as many as shuffle partitions. No task sees more than a piece.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    pieces = cut(df.repartitionByRange(*columns).withColumn("_piece", F.spark_partition_id()), "pieces")
    sizes = {r["_piece"]: r["n"] for r in pieces.groupBy("_piece").agg(F.count(F.lit(1)).alias("n")).collect()}
    add, total = {}, 0
    for k in sorted(sizes):
        add[k], total = total, total + sizes[k]
    before = F.element_at(F.create_map(*[F.lit(x) for kv in (add or {0: 0}).items() for x in kv]), F.col("_piece")).cast("long")
    within = Window.partitionBy("_piece").orderBy(*columns)
    return pieces.withColumn("rank0", F.row_number().over(within) - 1 + before).drop("_piece"), total


def ranked_within(df: DataFrame, group: list[str], order: list) -> DataFrame:
    """``df`` with ``pos`` (from 0) and ``n`` within groups that may be few and large: ranks of all rows less that of the group's first."""
    r, _ = ranked(df, [*group, *order])
    first = r.groupBy(*[F.col(g).alias(f"_g_{g}") for g in group]).agg(F.min("rank0").alias("_first"), F.count(F.lit(1)).alias("n"))
    same = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]
    return r.join(first, same).withColumn("pos", F.col("rank0") - F.col("_first")).drop("rank0", "_first", *[f"_g_{g}" for g in group])


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` up to each row, within groups that may be few and large: by range pieces, raised by the sums of the pieces before."""
    keys = [*group, *order]
    pieces = cut(df.repartitionByRange(*keys).withColumn("_piece", F.spark_partition_id()), "pieces")
    upto = Window.partitionBy(*group, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = pieces.groupBy(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_piece").alias("_p")).agg(F.sum(value).alias("_s"))
    sums = sums.withColumn("_add", F.coalesce(F.sum("_s").over(Window.partitionBy(*[f"_g_{g}" for g in group]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    same = [*[F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group], F.col("_piece") == F.col("_p")]
    return pieces.join(sums, same).withColumn(name, F.sum(value).over(upto) + F.col("_add")).drop("_piece", "_p", "_add", *[f"_g_{g}" for g in group])


def positioned(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds ``pos`` (from 0) and ``n`` (rows of the group)."""
    w = Window.partitionBy(*group)
    return df.withColumn("pos", F.row_number().over(w.orderBy(*order)) - 1).withColumn("n", F.count(F.lit(1)).over(w))


def ends(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """First and last value of each group; one partial aggregation, no sort."""
    key = F.struct(*order)
    return df.groupBy(*group).agg(F.min_by(value, key).alias("first"), F.max_by(value, key).alias("last"), F.count(F.lit(1)).alias("n"))


def lift_at(df: DataFrame, group: list[str], order: list[str], value: str, end: str) -> DataFrame:
    """How much more often a value opens (``first``) or closes (``last``) a group than it occurs at all."""
    overall = df.groupBy(value).agg(F.count(F.lit(1)).alias("n_all"))
    at = ends(df, group, order, value).groupBy(F.col(end).alias(value)).agg(F.count(F.lit(1)).alias("n_at"))
    whole = Window.partitionBy()
    j = overall.join(at, overall[value].eqNullSafe(at[value]), "left").select(overall[value], "n_all", F.coalesce("n_at", F.lit(0)).alias("n_at"))
    return j.withColumn("lift", (F.col("n_at") / F.sum("n_at").over(whole)) / (F.col("n_all") / F.sum("n_all").over(whole)))


def transitions(df: DataFrame, group: list[str], order: list[str], value: str, support: int = 1) -> DataFrame:
    """Counts and lift of each value followed by each value, with at least ``support`` occurrences."""
    nxt = F.lead(value).over(Window.partitionBy(*group).orderBy(*order))
    step = df.withColumn("to", nxt).where(F.col("to").isNotNull() & F.col(value).isNotNull())
    c = step.groupBy(F.col(value).alias("from"), "to").agg(F.count(F.lit(1)).alias("n"))
    row, col, all_ = Window.partitionBy("from"), Window.partitionBy("to"), Window.partitionBy()
    return c.withColumn("lift", F.col("n") * F.sum("n").over(all_) / (F.sum("n").over(row) * F.sum("n").over(col))).where(F.col("n") >= support)


def position_bin(pos: Column, n: Column, bins: int = 5) -> Column:
    """Bin of a relative position; for groups of two rows or more."""
    return F.least(F.lit(bins - 1), F.floor(pos / F.nullif(n - 1, F.lit(0)) * bins)).cast("int")


def quantile_bins(df: DataFrame, by: list[str], bins: int, within: list[str] = ()) -> DataFrame:
    """``bin`` by rank: floor(rank * bins / n), ties by the later columns of ``by``. Bins of all rows are ranked in pieces."""
    if not within:
        r, n = ranked(df, by)
        return r.withColumn("bin", F.floor(F.col("rank0") * bins / F.lit(max(1, n))).cast("int")).drop("rank0")
    return ranked_within(df, list(within), by).withColumn("bin", F.floor(F.col("pos") * bins / F.col("n")).cast("int")).drop("pos", "n")


def shares(counts: DataFrame, n: str, within: list[str] = ()) -> DataFrame:
    return counts.withColumn("share", F.col(n) / F.sum(n).over(Window.partitionBy(*within)))


def leave_one_out(df: DataFrame, group: list[str], value: str, least: int = 3) -> DataFrame:
    """``others``: the mean of the other rows of a group with at least ``least`` rows, rounded half to even.

    Sums and counts are combined before the shuffle and joined back, so that a large group needs no task of its own.
    """
    t = df.groupBy(*group).agg(F.count(value).alias("_n"), F.sum(value).alias("_s")).where(F.col("_n") >= least)
    j = df.where(F.col(value).isNotNull()).join(t, group)
    return j.withColumn("others", F.bround((F.col("_s") - F.col(value)) / (F.col("_n") - 1), 0).cast("int")).drop("_n", "_s")


def run_lengths(df: DataFrame, group: list[str], order: list[str], flag: str, few: bool = False) -> DataFrame:
    """Maximal runs of rows with ``flag`` (gaps and islands): start position and length. ``few``: the groups are few and large."""
    if few:
        p = ranked_within(df, group, order).where(flag).select(*group, F.col("pos").alias("_at"))
        q = ranked_within(p, group, ["_at"]).withColumn("_i", F.col("_at") - F.col("pos"))
        return q.groupBy(*group, "_i").agg(F.min("_at").cast("int").alias("start"), F.count(F.lit(1)).alias("length")).drop("_i")
    p = positioned(df, group, order).where(flag)
    w = Window.partitionBy(*group).orderBy("pos")
    return p.withColumn("_i", F.col("pos") - F.row_number().over(w)).groupBy(*group, "_i").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("length")).drop("_i")
