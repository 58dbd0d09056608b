"""Document-shaping and reconciliation queries: nested projections, packets, consensus, lineage, manifests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from delibera.functions import text as T
from delibera.functions.sql import CALLS, MEMOS, UNITS, cascade, instant
from delibera.operators import hierarchy
from delibera.operators import sequence as S
from delibera.plans import base
from delibera.runtime import read

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


TOPIC = f"{UNITS}, t AS (SELECT unit_pk, year, forum_id, reviewer_key rk, unit_id, unit_index, support_status ss, confidence cf, lower(trim(valence)) v, {cascade('inspected_object', T.TOPIC_RULES, 'other')} topic FROM u)"


def topics(spark, d):
    u = base.units(spark, d, "year", "forum_id", "reviewer_key", "unit_id", "unit_index", "support_status", "confidence", "valence", "inspected_object")
    return u.select("unit_pk", "year", "forum_id", F.col("reviewer_key").alias("rk"), "unit_id", "unit_index", F.col("support_status").alias("ss"), F.col("confidence").alias("cf"), F.lower(F.trim("valence")).alias("v"), T.first_match(F.col("inspected_object"), T.TOPIC_RULES, "other").alias("topic"))


@query(f"WITH {TOPIC} SELECT forum_id, rk, count(*) n, array_to_string(list_sort(list(DISTINCT ss)), ',') statuses, array_to_string(list_sort(list(DISTINCT topic)), ',') topics FROM t GROUP BY ALL")
def d1_compact_records(spark, d):
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return topics(spark, d).groupBy("forum_id", "rk").agg(F.count(F.lit(1)).alias("n"), joined("ss").alias("statuses"), joined("topic").alias("topics"))


@query(f"WITH {TOPIC}, f AS (SELECT DISTINCT year, forum_id FROM t), p AS (SELECT *, (row_number() OVER (PARTITION BY year ORDER BY forum_id) - 1) // 10 packet FROM f) SELECT p.year, CAST(packet AS INT) packet, count(*) units, count(DISTINCT (t.forum_id, rk)) reviews, count(DISTINCT t.forum_id) forums FROM t JOIN p ON p.forum_id = t.forum_id AND p.year = t.year GROUP BY ALL")
def d2_packets(spark, d):
    t = topics(spark, d)
    f = t.select("year", "forum_id").distinct()
    p = S.ranked_within(f, ["year"], ["forum_id"]).select("year", "forum_id", F.floor(F.col("pos") / 10).cast("int").alias("packet"))
    return t.join(p, ["year", "forum_id"]).groupBy("year", "packet").agg(F.count(F.lit(1)).alias("units"), F.count_distinct("forum_id", "rk").alias("reviews"), F.count_distinct("forum_id").alias("forums"))


@query(f"""WITH {TOPIC}, g AS (SELECT topic, forum_id, count(*) n, count(*) FILTER (v = 'negative') neg, count(*) FILTER (v = 'positive') pos FROM t GROUP BY ALL), r AS (
 SELECT topic, forum_id, 'most' AS role FROM g QUALIFY row_number() OVER (PARTITION BY topic ORDER BY n DESC, forum_id) <= 3 UNION ALL SELECT topic, forum_id, 'against' FROM g QUALIFY row_number() OVER (PARTITION BY topic ORDER BY neg DESC, forum_id) <= 2 UNION ALL SELECT topic, forum_id, 'for' FROM g QUALIFY row_number() OVER (PARTITION BY topic ORDER BY pos DESC, forum_id) <= 1)
 SELECT forum_id, array_to_string(list_sort(list(DISTINCT topic)), ',') topics, array_to_string(list_sort(list(DISTINCT role)), ',') roles FROM r GROUP BY 1""")
def d6_role_accumulation(spark, d):
    g = topics(spark, d).groupBy("topic", "forum_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") == "negative").alias("neg"), F.count_if(F.col("v") == "positive").alias("pos"))
    rank = lambda c: F.row_number().over(Window.partitionBy("topic").orderBy(F.desc(c), "forum_id"))
    ranked = g.select("topic", "forum_id", rank("n").alias("a"), rank("neg").alias("b"), rank("pos").alias("c"))
    roles = F.array_compact(F.array(F.when(F.col("a") <= 3, F.lit("most")), F.when(F.col("b") <= 2, F.lit("against")), F.when(F.col("c") <= 1, F.lit("for"))))
    r = ranked.select("topic", "forum_id", F.explode(roles).alias("role"))
    return r.groupBy("forum_id").agg(F.array_join(F.sort_array(F.collect_set("topic")), ",").alias("topics"), F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"))


@query(f"WITH {TOPIC}, o AS (SELECT forum_id, list_distinct(list(topic) FILTER (cf = 'high')) a, list_distinct(list(topic) FILTER (cf = 'low' AND v = 'uncertain')) b FROM t GROUP BY 1), c AS (SELECT forum_id, unnest(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))) topic FROM o) SELECT forum_id, topic, CAST((row_number() OVER (ORDER BY sha256('d7:' || forum_id || ':' || topic), forum_id, topic) - 1) // 25 AS INT) chunk FROM c")
def d7_d8_candidates(spark, d):
    o = topics(spark, d).groupBy("forum_id").agg(F.collect_set(F.when(F.col("cf") == "high", F.col("topic"))).alias("a"), F.collect_set(F.when((F.col("cf") == "low") & (F.col("v") == "uncertain"), F.col("topic"))).alias("b"))
    c = o.select("forum_id", F.explode(F.array_union("a", "b")).alias("topic"))
    r, _ = S.ranked(c, [T.hash_order("d7", "forum_id", "topic"), "forum_id", "topic"])
    return r.select("forum_id", "topic", F.floor(F.col("rank0") / 25).cast("int").alias("chunk"))


@query(f"WITH {TOPIC}, x AS (SELECT DISTINCT topic, v FROM t WHERE v IS NOT NULL), i AS (SELECT v, list_sort(list(topic)) topics FROM x GROUP BY 1) SELECT v, len(topics) n, array_to_string(topics, ',') topics FROM i")
def d9_inversion(spark, d):
    x = topics(spark, d).where("v IS NOT NULL").select("topic", "v").distinct()
    return x.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("topic")), ",").alias("topics"))


@query(f"WITH {TOPIC} SELECT unit_pk, topic FROM t WHERE v <> 'mixed' QUALIFY count(*) OVER (PARTITION BY forum_id, rk, unit_id) = 1")
def d10_exclude_and_guard(spark, d):
    t = topics(spark, d).where("v <> 'mixed'")
    return t.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("forum_id", "rk", "unit_id"))).where("_n = 1").select("unit_pk", "topic")


@query(f"WITH {TOPIC}, a2 AS (SELECT forum_id, topic, v, count(*) c FROM t GROUP BY ALL) SELECT forum_id, topic, arg_max(v, (c, v)) top FROM a2 WHERE v IS NOT NULL GROUP BY ALL")
def j13_majority_label(spark, d):
    c = topics(spark, d).where("v IS NOT NULL").groupBy("forum_id", "topic", "v").agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy("forum_id", "topic").agg(F.max_by("v", F.struct("c", "v")).alias("top"))


@query(f"""WITH {TOPIC}, f AS (SELECT forum_id, topic, bool_or(v = 'negative') neg FROM t WHERE rk = 'R1' GROUP BY ALL), s AS (SELECT forum_id, topic, bool_or(v = 'negative') neg FROM t WHERE rk = 'R2' GROUP BY ALL)
 SELECT CASE WHEN s.neg IS NULL THEN 'unseen' WHEN f.neg = s.neg THEN 'confirmed' ELSE 'disputed' END verdict, f.neg, count(*) n FROM f LEFT JOIN s USING (forum_id, topic) GROUP BY ALL""")
def j12_j14_second_pass(spark, d):
    t = topics(spark, d)
    one = lambda k, n: t.where(F.col("rk") == k).groupBy("forum_id", "topic").agg(F.max(F.coalesce(F.col("v") == "negative", F.lit(False))).alias(n))
    j = one("R1", "neg").join(one("R2", "other"), ["forum_id", "topic"], "left")
    verdict = F.when(F.col("other").isNull(), "unseen").when(F.col("neg") == F.col("other"), "confirmed").otherwise("disputed")
    return j.groupBy(verdict.alias("verdict"), "neg").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TOPIC}, mp(topic, meta) AS (VALUES ('theory','formal'),('notation','formal'),('data','empirical'),('baselines','empirical'),('ablation','empirical'),('measurement','empirical'),('resources','practical')), x AS (SELECT DISTINCT meta, forum_id FROM t JOIN mp USING (topic)) SELECT meta, count(*) forums FROM x GROUP BY 1")
def j22_transitive_mapping(spark, d):
    pairs = [("theory", "formal"), ("notation", "formal"), ("data", "empirical"), ("baselines", "empirical"), ("ablation", "empirical"), ("measurement", "empirical"), ("resources", "practical")]
    mp = spark.createDataFrame(pairs, "topic string, meta string")
    return topics(spark, d).select("topic", "forum_id").distinct().join(F.broadcast(mp), "topic").select("meta", "forum_id").distinct().groupBy("meta").agg(F.count(F.lit(1)).alias("forums"))  # seven rows


@query(f"WITH {CALLS}, o AS (SELECT job_id, status, row_number() OVER (PARTITION BY job_id ORDER BY coalesce({instant('started_at')}, -1), status, coalesce(completion_tokens,-1)) i FROM c) SELECT job_id, CAST(max(i) - 1 AS INT) depth, arg_max(status, i) last_status FROM o GROUP BY 1")
def j24_retry_lineage(spark, d):
    """Each call of a job is the retry of the one before: lineage to its end by the hierarchy operator."""
    order = Window.partitionBy("job_id").orderBy(F.coalesce(T.instant_of(F.col("started_at")), F.lit(-1)), "status", F.coalesce("completion_tokens", F.lit(-1)))
    o = base.calls(spark, d).select("job_id", "status", F.row_number().over(order).alias("i"))
    node = F.concat_ws("#", "job_id", F.col("i").cast("string"))
    up = F.when(F.col("i") > 1, F.concat_ws("#", "job_id", (F.col("i") - 1).cast("string")))
    places = hierarchy.resolve(o.select(node.alias("node"), up.alias("parent"), F.when(F.col("i") == 1, F.lit("ok")).alias("start"), F.when(F.col("i") == 2, F.lit("ok")).alias("top")))
    last = o.groupBy("job_id").agg(F.max_by("status", "i").alias("last_status"))
    depth = places.groupBy(F.substring_index("root", "#", 1).alias("job_id")).agg(F.max("depth").cast("int").alias("depth"))
    return depth.join(last, "job_id").select("job_id", "depth", "last_status")


@query(f"WITH {MEMOS} SELECT stage, count(*) n, count(DISTINCT job_id) ids, CAST(sum(length(memo)) AS BIGINT) chars, CAST(sum(CAST('0x' || left(md5(memo), 8) AS BIGINT)) AS BIGINT) digest FROM memo GROUP BY 1")
def v18_manifest(spark, d):
    m = base.memos(spark, d).select("stage", "job_id", F.length("memo").cast("long").alias("l"), F.md5("memo").alias("h"))
    g = m.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("job_id").alias("ids"), F.sum("l").alias("chars"), F.sum(F.conv(F.substring("h", 1, 8), 16, 10).cast("long")).alias("digest"))
    return g


@query(f"WITH {UNITS}, n AS (SELECT forum_id, reviewer_key, 'U-' || printf('%03d', row_number() OVER (PARTITION BY forum_id, reviewer_key ORDER BY unit_index, unit_pk)) made, unit_pk, CASE WHEN support_status = 'mixed' AND confidence = 'low' THEN 'memo_inferred' ELSE support_status END status FROM u) SELECT * FROM n")
def v19_payload_normalization(spark, d):
    u = base.units(spark, d, "forum_id", "reviewer_key", "unit_index", "support_status", "confidence")
    rn = F.row_number().over(Window.partitionBy("forum_id", "reviewer_key").orderBy("unit_index", "unit_pk"))
    made = F.concat(F.lit("U-"), T.padded(rn, 3))
    status = F.when((F.col("support_status") == "mixed") & (F.col("confidence") == "low"), "memo_inferred").otherwise(F.col("support_status"))
    return u.select("forum_id", "reviewer_key", made.alias("made"), "unit_pk", status.alias("status"))


@query(f"WITH {TOPIC}, p AS (SELECT forum_id, rk, count(*) n, count(*) FILTER (v = 'negative') / count(*) neg FROM t GROUP BY ALL HAVING count(*) >= 5), c AS (SELECT CASE WHEN neg >= 0.75 THEN 'harsh' WHEN neg >= 0.4 THEN 'mixed' ELSE 'mild' END cluster, n, neg FROM p), b AS (SELECT avg(neg) base FROM p) SELECT cluster, count(*) size, round(count(*) / sum(count(*)) OVER (), 6) share, round(avg(neg), 6) mean_neg, round(avg(neg) / any_value(base), 6) ratio FROM c, b GROUP BY 1")
def g25_cluster_summary(spark, d):
    p = topics(spark, d).groupBy("forum_id", "rk").agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("v") == "negative") / F.count(F.lit(1))).alias("neg")).where("n >= 5")
    average = p.agg(F.avg("neg")).first()[0]
    cluster = F.when(F.col("neg") >= 0.75, "harsh").when(F.col("neg") >= 0.4, "mixed").otherwise("mild")
    c = p.groupBy(cluster.alias("cluster")).agg(F.count(F.lit(1)).alias("size"), F.avg("neg").alias("m"))
    return S.shares(c, "size").select("cluster", "size", F.round("share", 6).alias("share"), F.round("m", 6).alias("mean_neg"), F.round(F.col("m") / F.lit(average), 6).alias("ratio"))


@query(f"WITH {TOPIC} SELECT count(*) n, count(DISTINCT unit_pk) keys, count(DISTINCT (forum_id, rk, unit_id)) ids, round(avg(unit_index), 6) mean_index, max(unit_index) most, min(unit_pk) first_pk FROM t")
def g1_g5_plain_aggregates(spark, d):
    return topics(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("unit_pk").alias("keys"), F.count_distinct("forum_id", "rk", "unit_id").alias("ids"), F.round(F.avg("unit_index"), 6).alias("mean_index"), F.max("unit_index").alias("most"), F.min("unit_pk").alias("first_pk"))


@query(f"WITH {UNITS} SELECT unit_pk, year, reviewer_role AS role_name FROM u WHERE valence IN ('negative','mixed') AND year BETWEEN 2020 AND 2023 AND update_trigger IS NOT NULL AND inspected_object LIKE '%of the%' AND length(reasoning) > 60 AND NOT starts_with(unit_id, 'U-99')")
def f_p1_p9_filters(spark, d):
    u = base.units(spark, d, "year", "reviewer_role", "valence", "update_trigger", "inspected_object", "reasoning", "unit_id")
    return u.where(F.col("valence").isin("negative", "mixed") & F.col("year").between(2020, 2023) & F.col("update_trigger").isNotNull() & F.col("inspected_object").like("%of the%") & (F.length("reasoning") > 60) & ~F.col("unit_id").startswith("U-99")).select("unit_pk", "year", F.col("reviewer_role").alias("role_name"))


@query("SELECT forum_id, json_extract_string(j, '$.content.title.value') boxed, coalesce(json_extract_string(j, '$.content.title.value'), json_extract_string(j, '$.content.title')) title FROM (SELECT DISTINCT forum_id, CASE WHEN json_valid(submission_json) AND json_type(submission_json) = 'OBJECT' THEN CAST(submission_json AS JSON) END j FROM forums)")
def f_json_paths(spark, d):
    # the paths below are read by schema, so only these leaves are parsed
    f = read(spark, d, "forums").select("forum_id", F.try_parse_json("submission_json").alias("j"), "submission_json")
    boxed = F.try_variant_get("j", "$.content.title.value", "string")
    plain = F.try_variant_get("j", "$.content.title", "string")
    return f.select("forum_id", boxed.alias("boxed"), F.coalesce(boxed, plain).alias("title"), "submission_json").distinct().drop("submission_json")


QUERIES = Q
