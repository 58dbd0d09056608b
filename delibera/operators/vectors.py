"""Vector operators over ``array<float>`` columns: similarity, centroids, nearest centroid, drift, grids.

Of the centroids at most ``most`` are held by a task at once; more are taken in blocks, and the best of all blocks
counts. Null vectors are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delibera.runtime import cut


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Unit-length mean vector and member count of each key; sums are combined before the shuffle."""
    x = df.where(F.col(vector).isNotNull()).select(key, F.posexplode(vector).alias("i", "x"))
    m = x.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    v = m.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("v"), F.max("n").alias("n"))
    return v.select(key, F.transform("v", lambda c: c / F.sqrt(dot(F.col("v"), F.col("v")))).alias("centroid"), "n")


def nearest(df: DataFrame, vector: str, centers: DataFrame, key: str, most: int = 5000) -> DataFrame:
    """``df`` with the key of the nearest centroid and the cosine to it (ties: the least key)."""
    found = centers.orderBy(key).limit(most + 1).collect()
    if len(found) > most:
        return _nearest_in_blocks(df, vector, centers, key, most)
    keys, matrix = [r[key] for r in found], np.array([r["centroid"] for r in found], dtype=np.float64)
    schema = ", ".join([f"{c} {t}" for c, t in df.dtypes] + [f"nearest {dict(centers.dtypes)[key]}, cos double"])

    def run(batches):
        for pdf in batches:
            pdf = pdf[pdf[vector].notna()]
            if not len(pdf) or not len(keys):
                continue
            v = np.vstack(pdf[vector].to_numpy()).astype(np.float64)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            like = v @ matrix.T
            best = like.argmax(1)
            yield pdf.assign(nearest=[keys[i] for i in best], cos=like[np.arange(len(best)), best])

    return df.mapInPandas(run, schema)


def _nearest_in_blocks(df: DataFrame, vector: str, centers: DataFrame, key: str, most: int) -> DataFrame:
    """``nearest`` for any number of centroids: a pass over ``df`` for each block of them; no task holds more than a block."""
    from delibera.operators.sequence import ranked

    placed, total = ranked(centers.select(key, "centroid"), [key])
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    numbered = cut(numbered, "rows")
    best = None
    for b in range(-(-total // most)):
        block = placed.where((F.col("rank0") >= b * most) & (F.col("rank0") < (b + 1) * most)).drop("rank0")
        part = nearest(numbered.select("_row", vector), vector, block, key, most).select("_row", "nearest", "cos")
        best = part if best is None else best.unionByName(part)
    won = best.groupBy("_row").agg(F.min(F.struct((-F.col("cos")).alias("far"), "nearest")).alias("_b"))
    return numbered.join(won, "_row").drop("_row").withColumns({"nearest": F.col("_b.nearest"), "cos": -F.col("_b.far")}).drop("_b")


def grid_cells(df: DataFrame, columns: list[str], steps: int = 4095) -> DataFrame:
    """Columns min-max scaled to whole cells 0..steps; constant columns are 0."""
    edges = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = df
    for c in columns:
        lo, hi = edges[f"lo_{c}"], edges[f"hi_{c}"]
        out = out.withColumn(f"q_{c}", F.lit(0) if lo is None or hi == lo else F.bround((F.col(c) - F.lit(lo)) / F.lit(hi - lo) * steps, 0).cast("int"))
    return out


def convex_hulls(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Corners of the convex hull of each key, counter-clockwise from the leftmost.

    A hull of hulls is the hull: batches are reduced to their hulls first, and only those are grouped.
    """
    kinds = dict(df.dtypes)

    def hull(points: np.ndarray) -> np.ndarray:
        p = np.unique(points, axis=0)
        if len(p) < 3:
            return p
        turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        sides = []
        for seq in (p, p[::-1]):
            side: list = []
            for q in seq:
                while len(side) > 1 and turn(side[-2], side[-1], q) <= 0:
                    side.pop()
                side.append(q)
            sides += side[:-1]
        return np.array(sides)

    def part(batches):
        for pdf in batches:
            for k, g in pdf.groupby(key):
                h = hull(g[[x, y]].to_numpy())
                yield pd.DataFrame({key: k, x: h[:, 0], y: h[:, 1]})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        h = hull(pdf[[x, y]].to_numpy())
        return pd.DataFrame({key: pdf[key].iloc[0], "corner": np.arange(len(h), dtype=np.int32), x: h[:, 0], y: h[:, 1]})

    reduced = df.select(key, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).dropna().mapInPandas(part, f"{key} {kinds[key]}, {x} double, {y} double")
    return reduced.groupBy(key).applyInPandas(whole, f"{key} {kinds[key]}, corner int, {x} double, {y} double")


def dense_core(df: DataFrame, key: str, x: str, y: str, order: str, share: float = 0.6, least: int = 50) -> DataFrame:
    """Of each key the ``share`` of its points nearest to their mean, at least ``least`` of them (ties by ``order``)."""
    mean = df.groupBy(F.col(key).alias("_k")).agg(F.avg(x).alias("_x"), F.avg(y).alias("_y"), F.count(F.lit(1)).alias("_n"))
    far = F.pow(F.col(x) - F.col("_x"), 2) + F.pow(F.col(y) - F.col("_y"), 2)
    ranked = df.join(mean, F.col(key).eqNullSafe(F.col("_k"))).withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(far, order)))
    return ranked.where(F.col("_rn") <= F.greatest(F.lit(least), F.floor(F.col("_n") * share))).drop("_k", "_x", "_y", "_n", "_rn")


def majority(df: DataFrame, key: str, category: str) -> DataFrame:
    """Rows and most frequent category of each key (ties: the least)."""
    c = df.groupBy(key, category).agg(F.count(F.lit(1)).alias("_n"))
    return c.groupBy(key).agg(F.sum("_n").alias("n"), F.min(F.struct((-F.col("_n")).alias("m"), F.col(category).alias("c")))["c"].alias(category))
