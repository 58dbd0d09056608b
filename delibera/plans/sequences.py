"""Sequence queries: the order of the units of each reviewer."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from delibera.functions import text as T
from delibera.functions.sql import UNITS, cascade
from delibera.operators import sequence as S
from delibera.plans import base

GROUP, ORDER = ["forum_id", "reviewer_key"], ["unit_index", "unit_pk"]
SEQ = f"{UNITS}, s AS (SELECT forum_id, reviewer_key, unit_index, unit_pk, year, lower(trim(valence)) v, {cascade('inspected_object', T.TOPIC_RULES, 'other')} topic FROM u)"
POS = f"{SEQ}, p AS (SELECT *, row_number() OVER (PARTITION BY forum_id, reviewer_key ORDER BY unit_index, unit_pk) - 1 pos, count(*) OVER (PARTITION BY forum_id, reviewer_key) n FROM s)"
GRP = "CASE v WHEN 'negative' THEN 'neg' WHEN 'positive' THEN 'pos' ELSE 'hedged' END"


def seq(spark, d):
    return base.units(spark, d, "forum_id", "reviewer_key", "unit_index", "year", "valence", "inspected_object").select(
        *GROUP, *ORDER, "year", F.lower(F.trim("valence")).alias("v"), T.first_match(F.col("inspected_object"), T.TOPIC_RULES, "other").alias("topic")
    )


Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


@query(f"WITH {SEQ} SELECT forum_id, reviewer_key, first(topic ORDER BY unit_index, unit_pk) AS first, last(topic ORDER BY unit_index, unit_pk) AS last, count(*) n FROM s GROUP BY ALL")
def w1_first_last(spark, d):
    return S.ends(seq(spark, d), GROUP, ORDER, "topic")


@query(f"""WITH {POS}, t AS (SELECT topic a, lead(topic) OVER (PARTITION BY forum_id, reviewer_key ORDER BY unit_index, unit_pk) b FROM s),
 c AS (SELECT a, b, count(*) n FROM t WHERE b IS NOT NULL GROUP BY ALL)
 SELECT * FROM (SELECT a AS "from", b AS "to", n, round(n * sum(n) OVER () / (sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b)), 6) lift FROM c) WHERE n >= 5""")
def w2_g14_transitions(spark, d):
    return S.transitions(seq(spark, d), GROUP, ORDER, "topic", support=5).withColumn("lift", F.round("lift", 6))


@query(f"WITH {POS} SELECT unit_pk, CAST(pos AS INT) pos, n FROM p")
def w3_positions(spark, d):
    return S.positioned(seq(spark, d), GROUP, ORDER).select("unit_pk", "pos", "n")


def _lift_sql(end):
    return f"""WITH {SEQ}, e AS (SELECT {end}(topic ORDER BY unit_index, unit_pk) t FROM s GROUP BY forum_id, reviewer_key), a AS (SELECT topic, count(*) n_all FROM s GROUP BY 1),
 x AS (SELECT topic, n_all, (SELECT count(*) FROM e WHERE t = topic) n_at FROM a)
 SELECT topic, n_all, n_at, round((n_at / sum(n_at) OVER ()) / (n_all / sum(n_all) OVER ()), 6) lift FROM x"""


@query(_lift_sql("first"))
def g13_opening_lift(spark, d):
    return S.lift_at(seq(spark, d), GROUP, ORDER, "topic", "first").withColumn("lift", F.round("lift", 6))


@query(_lift_sql("last"))
def g13_closing_lift(spark, d):
    return S.lift_at(seq(spark, d), GROUP, ORDER, "topic", "last").withColumn("lift", F.round("lift", 6))


@query(f"""WITH {POS}, b AS (SELECT *, CAST(least(4, floor(pos / (n - 1) * 5)) AS INT) bin FROM p WHERE n >= 3)
 SELECT bin, count(*) n, count(*) FILTER (v = 'negative') neg, count(*) FILTER (v = 'positive') pos, round(count(*) FILTER (v = 'negative') / count(*), 6) neg_rate FROM b GROUP BY 1""")
def g15_position_curve(spark, d):
    p = S.positioned(seq(spark, d), GROUP, ORDER).where("n >= 3").withColumn("bin", S.position_bin(F.col("pos"), F.col("n")))
    return p.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") == "negative").alias("neg"), F.count_if(F.col("v") == "positive").alias("pos"), F.round(F.count_if(F.col("v") == "negative") / F.count(F.lit(1)), 6).alias("neg_rate")
    )


@query(f"""WITH {POS}, b AS (SELECT topic, CAST(least(4, floor(pos / (n - 1) * 5)) AS INT) bin, count(*) n FROM p WHERE n >= 3 GROUP BY ALL)
 SELECT topic, bin, n, round(n / sum(n) OVER (PARTITION BY bin), 6) share FROM b""")
def g15_topic_curve(spark, d):
    p = S.positioned(seq(spark, d), GROUP, ORDER).where("n >= 3").withColumn("bin", S.position_bin(F.col("pos"), F.col("n")))
    return S.shares(p.groupBy("topic", "bin").agg(F.count(F.lit(1)).alias("n")), "n", ["bin"]).withColumn("share", F.round("share", 6))


@query(f"""WITH {SEQ}, g AS (SELECT first({GRP} ORDER BY unit_index, unit_pk) a, last({GRP} ORDER BY unit_index, unit_pk) b, count(*) c FROM s GROUP BY forum_id, reviewer_key)
 SELECT a AS "first", b AS "last", count(*) n FROM g WHERE c >= 3 GROUP BY ALL""")
def g16_arcs(spark, d):
    g = seq(spark, d).withColumn("g", T.valence_group(F.col("v")))
    return S.ends(g, GROUP, ORDER, "g").where("n >= 3").groupBy("first", "last").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SEQ}, l AS (SELECT count(*) c FROM s GROUP BY forum_id, reviewer_key) SELECT least(c, 15) len, count(*) n FROM l GROUP BY 1")
def g17_lengths(spark, d):
    return seq(spark, d).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("c")).groupBy(F.least("c", F.lit(15)).alias("len")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SEQ} SELECT topic, v, year, count(*) n FROM s GROUP BY ALL")
def g45_cube_cells(spark, d):
    return seq(spark, d).groupBy("topic", "v", "year").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SEQ}, c AS (SELECT year, topic, count(*) n FROM s GROUP BY ALL) SELECT year, topic, n, round(n / sum(n) OVER (PARTITION BY year), 6) share FROM c")
def g12_shares(spark, d):
    return S.shares(seq(spark, d).groupBy("year", "topic").agg(F.count(F.lit(1)).alias("n")), "n", ["year"]).withColumn("share", F.round("share", 6))


@query(f"WITH {SEQ}, c AS (SELECT forum_id, count(*) c FROM s GROUP BY 1) SELECT forum_id, c, CAST((row_number() OVER (ORDER BY c, forum_id) - 1) * 5 // count(*) OVER () AS INT) bin FROM c")
def w4_rank_bins(spark, d):
    return S.quantile_bins(seq(spark, d).groupBy("forum_id").agg(F.count(F.lit(1)).alias("c")), ["c", "forum_id"], 5)


@query(f"""WITH {SEQ}, c AS (SELECT forum_id, year, count(*) c FROM s GROUP BY ALL), r AS (SELECT *, (row_number() OVER (PARTITION BY year ORDER BY c, forum_id) - 1) * 4 // count(*) OVER (PARTITION BY year) w FROM c),
 k AS (SELECT *, row_number() OVER (PARTITION BY year, w ORDER BY sha256('seed:' || forum_id)) rn FROM r) SELECT year, CAST(w AS INT) w, forum_id FROM k WHERE rn = 1""")
def w5_window_picks(spark, d):
    c = seq(spark, d).groupBy("forum_id", "year").agg(F.count(F.lit(1)).alias("c"))
    r = S.quantile_bins(c, ["c", "forum_id"], 4, ["year"]).withColumnRenamed("bin", "w")
    return r.withColumn("rn", F.row_number().over(Window.partitionBy("year", "w").orderBy(T.hash_order("seed", "forum_id")))).where("rn = 1").select("year", "w", "forum_id")


@query(f"""WITH {SEQ}, t AS (SELECT DISTINCT year, topic FROM s) SELECT year, topic, CAST((row_number() OVER (PARTITION BY year ORDER BY topic) - 1 + 2) % 3 AS INT) shard, CAST((row_number() OVER (PARTITION BY year ORDER BY topic) - 1) // 4 AS INT) chunk FROM t""")
def w15_w16_shards(spark, d):
    t = seq(spark, d).select("year", "topic").distinct()
    rn = F.row_number().over(Window.partitionBy("year").orderBy("topic")) - 1
    return t.withColumn("shard", ((rn + 2) % 3).cast("int")).withColumn("chunk", F.floor(rn / 4).cast("int"))


@query(f"""WITH {POS}, k AS (SELECT *, row_number() OVER (PARTITION BY forum_id, topic ORDER BY unit_pk) r FROM s) SELECT unit_pk, forum_id, topic FROM k WHERE r = 1""")
def w17_keep_first(spark, d):
    s = seq(spark, d)
    return s.groupBy("forum_id", "topic").agg(F.min("unit_pk").alias("unit_pk"))


@query(f"""WITH {POS}, r AS (SELECT *, pos - row_number() OVER (PARTITION BY forum_id, reviewer_key ORDER BY pos) i FROM p WHERE v = 'negative')
 SELECT forum_id, reviewer_key, CAST(min(pos) AS INT) AS start, count(*) length FROM r GROUP BY forum_id, reviewer_key, i""")
def t7_negative_runs(spark, d):
    return S.run_lengths(seq(spark, d).withColumn("_neg", F.col("v") == "negative"), GROUP, ORDER, "_neg")


@query(f"""WITH {POS} SELECT unit_pk, pos = 0 AS is_first, pos = n - 1 AS is_last FROM p WHERE pos = 0 OR pos = n - 1""")
def d12_boundaries(spark, d):
    p = S.positioned(seq(spark, d), GROUP, ORDER)
    return p.where("pos = 0 OR pos = n - 1").select("unit_pk", (F.col("pos") == 0).alias("is_first"), (F.col("pos") == F.col("n") - 1).alias("is_last"))


@query(f"""WITH {POS}, q AS (SELECT forum_id, reviewer_key, pos // 2 pair, count(*) c, min(unit_pk) a, max(unit_pk) b FROM p GROUP BY ALL) SELECT forum_id, reviewer_key, CAST(pair AS INT) pair, a, b FROM q WHERE c = 2""")
def d11_pairs(spark, d):
    p = S.positioned(seq(spark, d), GROUP, ORDER).withColumn("pair", F.floor(F.col("pos") / 2).cast("int"))
    return p.groupBy(*GROUP, "pair").agg(F.count(F.lit(1)).alias("c"), F.min("unit_pk").alias("a"), F.max("unit_pk").alias("b")).where("c = 2").drop("c")


@query(f"""WITH {UNITS} SELECT unit_pk, 'U-' || regexp_extract(reviewer_key, '(\\d+)', 1) || '-' || printf('%02d', unit_index + 1) AS made_id FROM u""")
def w11_ordinal_ids(spark, d):
    u = base.units(spark, d, "reviewer_key", "unit_index")
    return u.select("unit_pk", F.concat(F.lit("U-"), F.regexp_extract("reviewer_key", r"(\d+)", 1), F.lit("-"), T.padded(F.col("unit_index") + 1, 2)).alias("made_id"))


QUERIES = Q
