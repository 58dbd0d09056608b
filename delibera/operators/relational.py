"""Keyed writes, reconciliation and calendars as frame operators.

Upserts give the table after the write; what they are written with is the caller's choice. Null keys never match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delibera.runtime import cut


def upsert_last(old: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Old and new rows, of each key the last by ``order``; on ties the new row."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(*order, F.col("_new").desc())
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def upsert_keep_null(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New values win unless they are null."""
    rest = [c for c in old.columns if c not in key]
    o, n = old.select(*key, *[F.col(c).alias(f"_o_{c}") for c in rest]), new.select(*key, *[F.col(c).alias(f"_n_{c}") for c in rest])
    return o.join(n, key, "full_outer").select(*key, *[F.coalesce(f"_n_{c}", f"_o_{c}").alias(c) for c in rest])


def insert_or_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows and the new ones whose key is not there yet (of repeated new keys one row)."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti"))


def unseen(rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows still to be processed."""
    return rows.join(done.select(*key), key, "left_anti")


def reconcile(expected: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Keys that are missing or unexpected."""
    e, f = expected.select(*key).distinct().withColumn("_e", F.lit(True)), found.select(*key).distinct().withColumn("_f", F.lit(True))
    j = e.join(f, key, "full_outer").where(F.col("_e").isNull() | F.col("_f").isNull())
    return j.select(*key, F.when(F.col("_f").isNull(), "missing").otherwise("unexpected").alias("state"))


def daily(df: DataFrame, at: Column, kind: str) -> DataFrame:
    """Rows per day and kind between the first and the last day, days without rows included."""
    d = df.select(F.to_date(at).alias("day"), F.col(kind).alias("kind")).where(F.col("day").isNotNull())
    c = d.groupBy("day", "kind").agg(F.count(F.lit(1)).alias("n"))
    span = d.agg(F.min("day").alias("a"), F.max("day").alias("b")).where(F.col("a").isNotNull())
    days = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    kinds = d.select("kind").distinct()
    grid = days.join(F.broadcast(kinds))  # days x kinds: calendar rows, not data rows
    return grid.join(c, (grid["day"] == c["day"]) & grid["kind"].eqNullSafe(c["kind"]), "left").select(grid["day"], grid["kind"], F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def season(df: DataFrame, opens: list[str], closes: list[str], least: int = 5, after: int = 3) -> DataFrame:
    """Rows of (year, day, kind) per day and kind of each year, days without rows included, and whether the day is ``dense``.

    A year's dense window begins with the first day that has ``least`` rows of one of the kinds ``opens`` and ends
    ``after`` days after the last one that has as many of one of ``closes``. Days outside it stay, as not dense; a year
    that lacks either edge has no dense day.
    """
    c = cut(df.where("day IS NOT NULL").groupBy("year", "day", "kind").agg(F.count(F.lit(1)).alias("n")), "season")
    edge = lambda kinds: F.when(F.col("kind").isin(kinds) & (F.col("n") >= least), F.col("day"))
    span = c.groupBy("year").agg(F.min("day").alias("a"), F.max("day").alias("b"), F.min(edge(opens)).alias("first"), F.date_add(F.max(edge(closes)), after).alias("last"))
    days = span.select("year", F.explode(F.sequence("a", F.greatest("b", "last"))).alias("day"), F.coalesce(F.col("day").between(F.col("first"), F.col("last")), F.lit(False)).alias("dense"))
    grid = days.crossJoin(F.broadcast(c.select("kind").distinct())).withColumn("n", F.lit(0).cast("long"))  # calendar rows, not data rows
    both = grid.unionByName(c.withColumn("dense", F.lit(None).cast("boolean")))
    return both.groupBy("year", "day", "kind").agg(F.sum("n").alias("n"), F.max("dense").alias("dense"))


def pack_with_reset(df: DataFrame, group: str, order: list[str], size: str, max_rows: int, max_size: int) -> DataFrame:
    """Consecutive packs of a group of at most ``max_rows`` rows and ``max_size`` size; a larger row is a pack alone.

    A pack starts where the one before is full, which no window frame can say: a state runs over the sorted rows of a
    group in Arrow batches and holds two numbers.
    """
    import pandas as pd

    schema = ", ".join([f"{c} {t}" for c, t in df.dtypes] + ["pack int"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        pack, rows, used, out = 0, 0, 0, []
        for s in pdf[size].fillna(0):
            if rows and (rows >= max_rows or used + s > max_size):
                pack, rows, used = pack + 1, 0, 0
            rows, used = rows + 1, used + s
            out.append(pack)
        return pdf.assign(pack=out)

    return df.groupBy(group).applyInPandas(run, schema)


def least_loaded(df: DataFrame, key: str, weight: str, bins: int, seed: str = "bins") -> DataFrame:
    """Groups to bins, the heaviest first to the least loaded bin; ties by hash. The group table is one row a key."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        load, out = [0.0] * bins, []
        for r in pdf.sort_values([weight, "_h"], ascending=[False, True], kind="stable").itertuples():
            b = min(range(bins), key=lambda k: (load[k], k))
            load[b] += getattr(r, weight)
            out.append((getattr(r, key), getattr(r, weight), b))
        return pd.DataFrame(out, columns=[key, weight, "bin"])

    kinds = dict(df.dtypes)
    hashed = df.select(key, weight, F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256).alias("_h"))
    return hashed.groupBy().applyInPandas(run, f"{key} {kinds[key]}, {weight} {kinds[weight]}, bin int")
