"""Sampling queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from delibera.functions import text as T
from delibera.functions.sql import UNITS, cascade
from delibera.operators import sampling as S
from delibera.operators import sequence
from delibera.plans import base, panels

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


TOPIC = f"{UNITS}, t AS (SELECT unit_pk, year, forum_id, reviewer_key rk, lower(trim(valence)) v, length(coalesce(reasoning,'')) rl, length(coalesce(observation,'')) ol, {cascade('inspected_object', T.TOPIC_RULES, 'other')} topic FROM u)"


def topics(spark, d):
    u = base.units(spark, d, "year", "forum_id", "reviewer_key", "valence", "inspected_object", "reasoning", "observation")
    size = lambda c: F.length(F.coalesce(c, F.lit(""))).cast("bigint")
    return u.select("unit_pk", "year", "forum_id", F.col("reviewer_key").alias("rk"), F.lower(F.trim("valence")).alias("v"), size("reasoning").alias("rl"), size("observation").alias("ol"), T.first_match(F.col("inspected_object"), T.TOPIC_RULES, "other").alias("topic"))


H = "sha256('{0}:' || CAST(unit_pk AS VARCHAR))"


@query(f"WITH {UNITS} SELECT unit_pk FROM u ORDER BY {H.format('s1')}, unit_pk LIMIT 200")
def r1_o3_hash_sample(spark, d):
    return S.of_all(base.units(spark, d, "year"), "unit_pk", 200, "s1").select("unit_pk")


@query(f"WITH {TOPIC} SELECT unit_pk, topic FROM t QUALIFY row_number() OVER (PARTITION BY topic ORDER BY {H.format('s2')}, unit_pk) <= 25")
def r2_capped_per_group(spark, d):
    return S.per_stratum(topics(spark, d), ["topic"], "unit_pk", 25, "s2").select("unit_pk", "topic")


@query(f"""WITH {TOPIC}, md AS (SELECT topic, median(rl) a, median(ol) b FROM t GROUP BY 1), q AS (SELECT t.*, CASE WHEN rl > a THEN 2 ELSE 0 END + CASE WHEN ol > b THEN 1 ELSE 0 END qd FROM t JOIN md USING (topic)), r AS (SELECT *, row_number() OVER (PARTITION BY topic, qd ORDER BY {H.format('s3')}, unit_pk) rn FROM q)
 SELECT topic, CAST(qd AS INT) qd, unit_pk FROM r QUALIFY row_number() OVER (PARTITION BY topic ORDER BY rn, qd) <= 10""")
def r3_median_quadrants(spark, d):
    t = topics(spark, d)
    md = t.groupBy("topic").agg(F.median("rl").alias("a"), F.median("ol").alias("b"))
    q = t.join(md, "topic").withColumn("qd", (F.when(F.col("rl") > F.col("a"), 2).otherwise(0) + F.when(F.col("ol") > F.col("b"), 1).otherwise(0)).cast("int"))
    r = q.withColumn("rn", F.row_number().over(Window.partitionBy("topic", "qd").orderBy(T.hash_order("s3", "unit_pk"), "unit_pk")))
    return r.withColumn("k", F.row_number().over(Window.partitionBy("topic").orderBy("rn", "qd"))).where("k <= 10").select("topic", "qd", "unit_pk")


@query(f"""WITH {TOPIC}, s AS (SELECT topic, count(*) c FROM t GROUP BY 1), e AS (SELECT topic, c * 120 / sum(c) OVER () e FROM s), f AS (SELECT *, floor(e) q FROM e), k AS (SELECT topic, q + CASE WHEN row_number() OVER (ORDER BY e - q DESC, topic) <= 120 - sum(q) OVER () THEN 1 ELSE 0 END q FROM f),
 r AS (SELECT topic, unit_pk, row_number() OVER (PARTITION BY topic ORDER BY {H.format('s4')}, unit_pk) rn FROM t) SELECT unit_pk, topic FROM r JOIN k USING (topic) WHERE rn <= q""")
def r4_quota(spark, d):
    return S.quota(topics(spark, d), "topic", "unit_pk", 120, "s4").select("unit_pk", "topic")


@query(f"""WITH {TOPIC}, a AS (SELECT *, CAST((row_number() OVER (ORDER BY rl, unit_pk) - 1) * 5 // count(*) OVER () AS INT) bx, CAST((row_number() OVER (ORDER BY ol, unit_pk) - 1) * 5 // count(*) OVER () AS INT) "by" FROM t) SELECT bx, "by", unit_pk FROM a QUALIFY row_number() OVER (PARTITION BY bx, "by" ORDER BY {H.format('s5')}, unit_pk) <= 4""")
def r5_quantile_grid(spark, d):
    return S.quantile_grid(topics(spark, d), "rl", "ol", "unit_pk", 5, 4, "s5").select("bx", "by", "unit_pk")


@query(f"WITH {panels.RAT}, g AS (SELECT forum_id, max(rating) - min(rating) spread, arg_min(note_id, (rating, sha256('s6:' || note_id))) low, arg_max(note_id, (rating, sha256('s6:' || note_id))) high FROM rt GROUP BY 1 HAVING count(*) >= 2) SELECT forum_id, spread, low, high FROM g ORDER BY spread DESC, forum_id LIMIT 30")
def r6_disagreement_pairs(spark, d):
    key = F.struct("rating", T.hash_order("s6", "note_id").alias("h"))
    g = base.ratings(spark, d).groupBy("forum_id").agg((F.max("rating") - F.min("rating")).alias("spread"), F.min_by("note_id", key).alias("low"), F.max_by("note_id", key).alias("high"), F.count(F.lit(1)).alias("n"))
    return g.where("n >= 2").orderBy(F.desc("spread"), "forum_id").limit(30).drop("n")


@query(f"WITH {TOPIC}, p AS (SELECT *, CASE WHEN v = 'mixed' THEN 1 WHEN v = 'conditional' THEN 2 WHEN v = 'uncertain' THEN 3 ELSE 4 END pr FROM t) SELECT unit_pk, CAST(pr AS INT) pr FROM p ORDER BY pr, {H.format('s8')}, unit_pk LIMIT 500")
def r8_priority_fill(spark, d):
    p = topics(spark, d).withColumn("pr", F.when(F.col("v") == "mixed", 1).when(F.col("v") == "conditional", 2).when(F.col("v") == "uncertain", 3).otherwise(4))
    return S.priority_fill(p, "pr", "unit_pk", 500, "s8").select("unit_pk", "pr")


@query(f"WITH {TOPIC}, p AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY rl, unit_pk) - 1 i, count(*) OVER (PARTITION BY year) n FROM t) SELECT year, unit_pk FROM p WHERE n <= 7 OR i IN (SELECT CAST(round_even(k * (n - 1) / 6, 0) AS BIGINT) FROM generate_series(0, 6) s(k))")
def r9_o9_evenly_spaced(spark, d):
    return S.evenly_spaced(topics(spark, d), ["year"], ["rl", "unit_pk"], 7).select("year", "unit_pk")


@query(f"WITH {TOPIC}, r AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY topic, v ORDER BY {H.format('s10')}, unit_pk) = 1) SELECT topic, v, unit_pk FROM r ORDER BY {H.format('s10')}, unit_pk LIMIT 40")
def r10_one_per_stratum(spark, d):
    return S.of_all(S.per_stratum(topics(spark, d), ["topic", "v"], "unit_pk", 1, "s10"), "unit_pk", 40, "s10").select("topic", "v", "unit_pk")


@query(f"WITH {TOPIC}, g AS (SELECT topic, forum_id, count(*) c FROM t GROUP BY ALL), o AS (SELECT forum_id, min(topic) topic FROM g GROUP BY 1), r AS (SELECT g.*, row_number() OVER (PARTITION BY topic ORDER BY c DESC, forum_id) rn FROM g JOIN o USING (forum_id, topic)) SELECT topic, forum_id, CAST(rn AS INT) rn FROM r WHERE rn <= 5")
def r11_w6_first_claims(spark, d):
    g = topics(spark, d).groupBy("topic", "forum_id").agg(F.count(F.lit(1)).alias("c"))
    return S.first_claims(g, "topic", "forum_id", "c", 5).select("topic", "forum_id", F.col("rn").cast("int").alias("rn"))


@query(f"WITH {UNITS} SELECT unit_pk, CASE WHEN CAST('0x' || left({H.format('s12')}, 2) AS INT) % 2 = 0 THEN 'AB' ELSE 'BA' END ord FROM u")
def r12_blind_order(spark, d):
    h = T.hash_order("s12", "unit_pk")
    return base.units(spark, d, "year").select("unit_pk", F.when(F.conv(F.substring(h, 1, 2), 16, 10).cast("int") % 2 == 0, "AB").otherwise("BA").alias("ord"))


@query(f"WITH {TOPIC}, g AS (SELECT forum_id, count(*) c, count(DISTINCT topic) k, count(*) FILTER (v = 'negative') neg FROM t GROUP BY 1), a AS (SELECT 'most' sc, forum_id FROM g ORDER BY c DESC, forum_id LIMIT 3), b AS (SELECT 'widest' sc, forum_id FROM g WHERE forum_id NOT IN (SELECT forum_id FROM a) ORDER BY k DESC, forum_id LIMIT 3), e AS (SELECT 'harshest' sc, forum_id FROM g WHERE forum_id NOT IN (SELECT forum_id FROM a) AND forum_id NOT IN (SELECT forum_id FROM b) ORDER BY neg DESC, forum_id LIMIT 3) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM e")
def o7_r7_scenario_picks(spark, d):
    g = topics(spark, d).groupBy("forum_id").agg(F.count(F.lit(1)).alias("c"), F.count_distinct("topic").alias("k"), F.count_if(F.col("v") == "negative").alias("neg"))
    a = g.orderBy(F.desc("c"), "forum_id").limit(3).select(F.lit("most").alias("sc"), "forum_id")
    b = g.join(a, "forum_id", "left_anti").orderBy(F.desc("k"), "forum_id").limit(3).select(F.lit("widest").alias("sc"), "forum_id")
    e = g.join(a.unionByName(b), "forum_id", "left_anti").orderBy(F.desc("neg"), "forum_id").limit(3).select(F.lit("harshest").alias("sc"), "forum_id")
    return a.unionByName(b).unionByName(e)


@query(f"WITH {TOPIC}, s AS (SELECT DISTINCT year, forum_id, rk FROM t), a AS (SELECT year, rk, forum_id, row_number() OVER (PARTITION BY year ORDER BY sha256('x:' || forum_id || ':' || rk), forum_id, rk) i FROM s), b AS (SELECT a.year, a.forum_id fa, a.rk ra, c.forum_id fb, c.rk rb FROM a JOIN a c ON c.year = a.year AND c.i = a.i + 1 WHERE a.i % 2 = 1 AND a.forum_id <> c.forum_id) SELECT * FROM b")
def j19_stranger_pairs(spark, d):
    s = topics(spark, d).select("year", "forum_id", "rk").distinct()
    a = sequence.ranked_within(s.withColumn("_h", T.hash_order("x", "forum_id", "rk")), ["year"], ["_h", "forum_id", "rk"])
    row = F.struct("forum_id", "rk")
    pairs = a.groupBy("year", F.floor(F.col("pos") / 2).alias("_k")).agg(F.min_by(row, "pos").alias("a"), F.max_by(row, "pos").alias("b"), F.count(F.lit(1)).alias("c"))
    return pairs.where("c = 2 AND a.forum_id <> b.forum_id").select("year", F.col("a.forum_id").alias("fa"), F.col("a.rk").alias("ra"), F.col("b.forum_id").alias("fb"), F.col("b.rk").alias("rb"))


QUERIES = Q
