"""Data-quality and reconciliation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from delibera.functions import text as T
from delibera.functions.sql import CALLS, MEMOS, NOTES, UNITS, cascade
from delibera.operators import quality as C
from delibera.operators import relational as R
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


@query("SELECT unit_pk, count(*) n FROM units GROUP BY 1 HAVING count(*) > 1")
def v2_duplicate_keys(spark, d):
    return C.duplicates(read(spark, d, "units"), ["unit_pk"])


@query(f"WITH {NOTES}, {UNITS} SELECT unit_pk, forum_id FROM u WHERE forum_id IS NOT NULL AND forum_id NOT IN (SELECT forum_id FROM m)")
def v3_dangling_references(spark, d):
    return C.dangling(base.units(spark, d, "forum_id"), "forum_id", read(spark, d, "messages"), "forum_id").select("unit_pk", "forum_id")


ENUMS = "'negative','positive','mixed','conditional','uncertain'"


@query(f"""WITH {UNITS}, r AS (SELECT unit_pk, unnest(list_filter([CASE WHEN NOT coalesce(lower(trim(valence)) IN ({ENUMS}), false) THEN 'valence' END, CASE WHEN NOT coalesce(regexp_full_match(unit_id, 'U-[0-9]{{2,}}-[0-9]{{2,}}'), false) THEN 'unit_id' END, CASE WHEN NOT coalesce(length(trim(inspected_object, ' ')) >= 5, false) THEN 'object' END,
 CASE WHEN NOT coalesce(temporal_position <> 'initial_review' OR judgment_change = 'not_observed', false) THEN 'change' END, CASE WHEN NOT coalesce(update_trigger IS NULL OR temporal_position = 'post_author_response', false) THEN 'trigger' END, CASE WHEN NOT coalesce(unit_index >= 0, false) THEN 'index' END], lambda x: x IS NOT NULL)) rule FROM u) SELECT rule, unit_pk FROM r""")
def v1_v4_v7_v8_rules(spark, d):
    u = base.units(spark, d, "valence", "unit_id", "inspected_object", "temporal_position", "judgment_change", "update_trigger", "unit_index")
    return C.broken_rules(
        u,
        "unit_pk",
        {
            "valence": F.lower(F.trim("valence")).isin("negative", "positive", "mixed", "conditional", "uncertain"),
            "unit_id": F.col("unit_id").rlike("^U-[0-9]{2,}-[0-9]{2,}$"),
            "object": F.length(F.trim("inspected_object")) >= 5,
            "change": (F.col("temporal_position") != "initial_review") | (F.col("judgment_change") == "not_observed"),
            "trigger": F.col("update_trigger").isNull() | (F.col("temporal_position") == "post_author_response"),
            "index": F.col("unit_index") >= 0,
        },
    )


@query(f"WITH {UNITS}, t AS (SELECT {cascade('inspected_object', T.TOPIC_RULES, 'other')} topic FROM u), c AS (SELECT topic, count(*) n FROM t GROUP BY 1) SELECT * FROM (SELECT topic, n, round(n / sum(n) OVER (), 6) share FROM c) WHERE share > 0.05")
def v10_share_ceiling(spark, d):
    t = base.units(spark, d, "inspected_object").select(T.first_match(F.col("inspected_object"), T.TOPIC_RULES, "other").alias("topic"))
    return C.share_over(t, "topic", 0.05).withColumn("share", F.round("share", 6))


@query(f"WITH {UNITS}, g AS (SELECT custom_id, count(*) n, max(unit_index) + 1 most, count(DISTINCT reviewer_key) r FROM u GROUP BY 1) SELECT custom_id, n, r, n >= most ok FROM g")
def v5_v14_counts(spark, d):
    g = base.units(spark, d, "custom_id", "unit_index", "reviewer_key").groupBy("custom_id").agg(F.count(F.lit(1)).alias("n"), (F.max("unit_index") + 1).alias("most"), F.count_distinct("reviewer_key").alias("r"))
    return g.select("custom_id", "n", "r", (F.col("n") >= F.col("most")).alias("ok"))


@query(f"WITH {NOTES} SELECT note_id, list_sort(json_keys(content_json)) = ['decision'] OR list_sort(json_keys(content_json)) = ['comment','decision'] exact FROM m WHERE kind = 'decision' AND json_valid(content_json)")
def v6_exact_keys(spark, d):
    n = base.notes(spark, d, "kind", "content_json").where(F.col("kind") == "decision").where(F.expr("try_parse_json(content_json)").isNotNull())
    keys = F.array_join(F.sort_array(F.json_object_keys("content_json")), ",")
    return n.select("note_id", keys.isin("decision", "comment,decision").alias("exact"))


@query(f"WITH {MEMOS}, k AS (SELECT job_id, ['analysis|study|experiment', 'reviewer|author', 'section|table|appendix'] g, lower(coalesce(memo,'')) t FROM memo) SELECT job_id, regexp_matches(t, g[1]) AND regexp_matches(t, g[2]) AND regexp_matches(t, g[3]) complete FROM k")
def v9_keyword_gates(spark, d):
    t = F.lower(F.coalesce("memo", F.lit("")))
    return base.memos(spark, d).select("job_id", (t.rlike("analysis|study|experiment") & t.rlike("reviewer|author") & t.rlike("section|table|appendix")).alias("complete"))


PHRASES = ["in its present form", "as the other reviewers noted", "so i keep my score"]


@query(f"WITH {MEMOS}, p AS (SELECT unnest({PHRASES}) phrase) SELECT phrase, count(*) FILTER (contains(lower(coalesce(memo,'')), phrase)) memos FROM p, memo GROUP BY 1")
def v12_generic_phrases(spark, d):
    low = F.lower(F.coalesce("memo", F.lit("")))
    hits = F.explode(F.array(*[F.struct(F.lit(p).alias("phrase"), low.contains(p).cast("int").alias("h")) for p in PHRASES]))
    return base.memos(spark, d).select(hits.alias("x")).groupBy(F.col("x.phrase").alias("phrase")).agg(F.sum("x.h").cast("long").alias("memos"))


@query(f"WITH {UNITS}, {NOTES}, a AS (SELECT forum_id, count(DISTINCT reviewer_key) got FROM u WHERE reviewer_role = 'official_reviewer' GROUP BY 1), b AS (SELECT forum_id, count(*) ref FROM m WHERE kind = 'official_review' GROUP BY 1) SELECT forum_id, got, ref, round(got / ref, 6) ratio, got / ref < 0.7 warn FROM a JOIN b USING (forum_id)")
def v13_recall(spark, d):
    a = base.units(spark, d, "forum_id", "reviewer_role", "reviewer_key").where("reviewer_role = 'official_reviewer'").groupBy("forum_id").agg(F.count_distinct("reviewer_key").alias("got"))
    b = base.notes(spark, d, "kind", "forum_id").where("kind = 'official_review'").groupBy("forum_id").agg(F.count(F.lit(1)).alias("ref"))
    r = F.col("got") / F.col("ref")
    return a.join(b, "forum_id").select("forum_id", "got", "ref", F.round(r, 6).alias("ratio"), (r < 0.7).alias("warn"))


@query(f"WITH {NOTES}, {UNITS}, k AS (SELECT DISTINCT forum_id FROM m), p AS (SELECT DISTINCT forum_id, reviewer_role FROM u), c AS (SELECT forum_id, count(*) c FROM p GROUP BY 1) SELECT * FROM (SELECT coalesce(k.forum_id, c.forum_id) forum_id, CASE WHEN k.forum_id IS NULL THEN 'foreign' WHEN c IS NULL THEN 'missing' WHEN c > 1 THEN 'several' END fault FROM k FULL JOIN c ON c.forum_id = k.forum_id) WHERE fault IS NOT NULL")
def v15_v16_s5_partition(spark, d):
    return C.partition_faults(base.notes(spark, d, "forum_id"), base.units(spark, d, "forum_id", "reviewer_role"), "forum_id", "reviewer_role")


@query(f"WITH {UNITS}, p AS (SELECT CASE WHEN lower(trim(valence)) = 'negative' THEN 'neg' WHEN lower(trim(valence)) = 'positive' THEN 'pos' ELSE 'hedged' END expected, {cascade('judgment', [('not |lack|insuff|fail|unclear', 'neg'), ('accept|useful|sound|thorough', 'pos')], 'hedged')} predicted FROM u) SELECT expected, predicted, count(*) n, round(count(*) / sum(count(*)) OVER (), 6) share FROM p GROUP BY ALL")
def g50_confusion(spark, d):
    p = base.units(spark, d, "valence", "judgment").select(T.valence_group(F.lower(F.trim("valence"))).alias("expected"), T.first_match(F.col("judgment"), [("not |lack|insuff|fail|unclear", "neg"), ("accept|useful|sound|thorough", "pos")], "hedged").alias("predicted"))
    return C.confusion(p, "expected", "predicted").withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query(f"WITH {UNITS}, {MEMOS}, a AS (SELECT forum_id, count(*) x FROM u GROUP BY 1), b AS (SELECT split_part(paper_id, ':', 2) forum_id, count(*) y FROM memo GROUP BY 1), j AS (SELECT x, y FROM a JOIN b USING (forum_id)) SELECT count(*) n, count(*) FILTER (x < y) fewer, count(*) FILTER (x = y) equal, count(*) FILTER (x > y) more, CAST(list_sort(list(x - y))[count(*) // 2 + 1] AS BIGINT) upper_median FROM j")
def g51_s17_comparison(spark, d):
    a = base.units(spark, d, "forum_id").groupBy("forum_id").agg(F.count(F.lit(1)).alias("x"))
    b = base.memos(spark, d).groupBy(F.element_at(F.split("paper_id", ":"), 2).alias("forum_id")).agg(F.count(F.lit(1)).alias("y"))
    j = a.join(b, "forum_id").select("x", "y", (F.col("x") - F.col("y")).alias("df"))
    k, n = S.ranked(j, ["df", "x", "y"])
    return k.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") < F.col("y")).alias("fewer"), F.count_if(F.col("x") == F.col("y")).alias("equal"), F.count_if(F.col("x") > F.col("y")).alias("more"), F.max(F.when(F.col("rank0") == n // 2, F.col("df"))).alias("upper_median"))


SETS = f"{UNITS}, s AS (SELECT forum_id, {cascade('inspected_object', T.TOPIC_RULES, 'other')} topic, temporal_position tp FROM u), o AS (SELECT forum_id, list_sort(list(DISTINCT topic) FILTER (tp = 'initial_review')) a, list_sort(list(DISTINCT topic) FILTER (tp = 'post_author_response')) b FROM s GROUP BY 1)"


def _sets(spark, d):
    s = base.units(spark, d, "forum_id", "inspected_object", "temporal_position").select("forum_id", T.first_match(F.col("inspected_object"), T.TOPIC_RULES, "other").alias("topic"), F.col("temporal_position").alias("tp"))
    return s.groupBy("forum_id").agg(F.sort_array(F.collect_set(F.when(F.col("tp") == "initial_review", F.col("topic")))).alias("a"), F.sort_array(F.collect_set(F.when(F.col("tp") == "post_author_response", F.col("topic")))).alias("b"))


@query(f"WITH {SETS}, z AS (SELECT forum_id, coalesce(a, []) a, coalesce(b, []) b FROM o) SELECT CASE WHEN a = b THEN 'unchanged' WHEN len(b) = 0 THEN 'none_left' WHEN len(a) = 0 THEN 'newly_named' ELSE 'changed' END transition, count(*) n, CAST(sum(len(list_intersect(a, b))) AS BIGINT) retained, CAST(sum(len(a) - len(list_intersect(a, b))) AS BIGINT) removed, CAST(sum(len(b) - len(list_intersect(a, b))) AS BIGINT) added FROM z GROUP BY 1")
def g54_transitions(spark, d):
    kind = F.when(F.col("a") == F.col("b"), "unchanged").when(F.size("b") == 0, "none_left").when(F.size("a") == 0, "newly_named").otherwise("changed")
    return _sets(spark, d).groupBy(kind.alias("transition")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(F.array_intersect("a", "b"))).alias("retained"), F.sum(F.size(F.array_except("a", "b"))).alias("removed"), F.sum(F.size(F.array_except("b", "a"))).alias("added"))


@query(f"WITH {SETS}, z AS (SELECT CASE WHEN len(coalesce(a, [])) = 0 THEN ['NONE'] ELSE a END a, CASE WHEN len(coalesce(b, [])) = 0 THEN ['NONE'] ELSE b END b FROM o), e AS (SELECT unnest(a) x, b FROM z), g AS (SELECT x, unnest(b) y FROM e) SELECT x, y, count(*) n FROM g GROUP BY ALL")
def g55_transition_matrix(spark, d):
    none = lambda c: F.when(F.size(c) == 0, F.array(F.lit("NONE"))).otherwise(F.col(c))
    e = _sets(spark, d).select(F.explode(none("a")).alias("x"), F.col("b")).select("x", F.explode(none("b")).alias("y"))
    return e.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SETS}, p AS (SELECT unnest(coalesce(a, [])) x, a FROM o), q AS (SELECT x, unnest(a) y FROM p) SELECT x, y, count(*) n FROM q WHERE x < y GROUP BY ALL")
def j17_label_pairs(spark, d):
    q = _sets(spark, d).select(F.explode("a").alias("x"), "a").select("x", F.explode("a").alias("y")).where("x < y")
    return q.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {UNITS}, s AS (SELECT forum_id, reviewer_key, list(confidence) c FROM u GROUP BY ALL) SELECT forum_id, reviewer_key, CASE WHEN list_contains(c, 'low') THEN 'low' WHEN list_contains(c, 'medium') THEN 'medium' WHEN list_contains(c, 'high') THEN 'high' END least FROM s")
def g57_ordinal_least(spark, d):
    s = base.units(spark, d, "forum_id", "reviewer_key", "confidence").groupBy("forum_id", "reviewer_key").agg(F.collect_set("confidence").alias("c"))
    return s.select("forum_id", "reviewer_key", C.ordinal_least(F.col("c"), ["low", "medium", "high"]).alias("least"))


@query(f"WITH {UNITS}, s AS (SELECT forum_id, reviewer_key, count(DISTINCT {cascade('inspected_object', T.TOPIC_RULES, 'other')}) k FROM u GROUP BY ALL) SELECT k, count(*) n FROM s GROUP BY k")
def g58_topics_per_review(spark, d):
    s = base.units(spark, d, "forum_id", "reviewer_key", "inspected_object").select("forum_id", "reviewer_key", T.first_match(F.col("inspected_object"), T.TOPIC_RULES, "other").alias("topic"))
    return s.groupBy("forum_id", "reviewer_key").agg(F.count_distinct("topic").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {UNITS}, s AS (SELECT {cascade('inspected_object', T.TOPIC_RULES, 'other')} topic, * FROM u), c AS (SELECT topic, count(*) n, count(DISTINCT (forum_id, reviewer_key)) reviews, count(DISTINCT forum_id) forums, count(*) FILTER (lower(trim(valence)) = 'negative') neg, count(*) FILTER (support_status = 'reviewer_explicit') explicit FROM s GROUP BY 1) SELECT topic, n, reviews, forums, neg, explicit, round(n / sum(n) OVER (), 6) share FROM c")
def g56_d15_support(spark, d):
    s = base.units(spark, d, "inspected_object", "forum_id", "reviewer_key", "valence", "support_status").withColumn("topic", T.first_match(F.col("inspected_object"), T.TOPIC_RULES, "other"))
    c = s.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("forum_id", "reviewer_key").alias("reviews"), F.count_distinct("forum_id").alias("forums"), F.count_if(F.lower(F.trim("valence")) == "negative").alias("neg"), F.count_if(F.col("support_status") == "reviewer_explicit").alias("explicit"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query(f"WITH {CALLS}, {MEMOS} SELECT job_id, CASE WHEN m IS NULL THEN 'call only' WHEN c IS NULL THEN 'memo only' END state FROM (SELECT DISTINCT job_id, true c FROM c WHERE status = 'complete') FULL JOIN (SELECT DISTINCT job_id, true m FROM memo) USING (job_id) WHERE m IS NULL OR c IS NULL")
def v17_t11_artifacts(spark, d):
    r = R.reconcile(base.calls(spark, d).where("status = 'complete'"), base.memos(spark, d), ["job_id"])
    return r.select("job_id", F.when(F.col("state") == "missing", "call only").otherwise("memo only").alias("state"))


@query(f"WITH {MEMOS}, r AS (SELECT job_id, regexp_replace(regexp_replace(coalesce(memo,''), 'M-[a-z]+:L\\d+(-L\\d+)?', '[ref]', 'g'), '\\b[A-Z][a-z]+(ix|on|is|et|as)\\b', '[name]', 'g') t FROM memo) SELECT job_id, md5(t) clean, NOT regexp_matches(t, 'M-[a-z]+:L\\d+') verified FROM r")
def k18_a15_p25_redaction(spark, d):
    t = F.regexp_replace(F.regexp_replace(F.coalesce("memo", F.lit("")), r"M-[a-z]+:L\d+(-L\d+)?", "[ref]"), r"\b[A-Z][a-z]+(ix|on|is|et|as)\b", "[name]")
    return base.memos(spark, d).select("job_id", F.md5(t).alias("clean"), (~t.rlike(r"M-[a-z]+:L\d+")).alias("verified"))


@query(f"WITH {UNITS}, x AS (SELECT unit_pk, CASE WHEN forum_id = (SELECT min(forum_id) FROM u) THEN 'moved-' || forum_id ELSE forum_id END forum_id FROM u) SELECT forum_id, count(*) n FROM x GROUP BY 1")
def k16_k17_id_migration(spark, d):
    u = base.units(spark, d, "forum_id")
    lookup = u.agg(F.min("forum_id").alias("forum_id")).select("forum_id", F.concat(F.lit("moved-"), "forum_id").alias("new_id"))
    return u.join(F.broadcast(lookup), "forum_id", "left").groupBy(F.coalesce("new_id", "forum_id").alias("forum_id")).agg(F.count(F.lit(1)).alias("n"))  # one row


@query(f"WITH {UNITS} SELECT unit_pk, judgment_change, confidence FROM u EXCEPT SELECT unit_pk, judgment_change, confidence FROM u WHERE confidence = 'low'")
def s1_v11_difference(spark, d):
    cells = lambda: read(spark, d, "units").select("unit_pk", "judgment_change", "confidence")
    return cells().subtract(cells().where("confidence = 'low'"))


@query(f"WITH {UNITS}, s AS (SELECT forum_id, reviewer_key, string_agg(unit_id, ',' ORDER BY unit_index, unit_pk) a, string_agg(unit_id, ',' ORDER BY unit_id) b FROM u GROUP BY ALL) SELECT forum_id, reviewer_key, a = b in_order FROM s")
def s6_sequence_equality(spark, d):
    ids = lambda *k: F.sort_array(F.collect_list(F.struct(*k)))["unit_id"]
    s = base.units(spark, d, "forum_id", "reviewer_key", "unit_id", "unit_index").groupBy("forum_id", "reviewer_key").agg(ids("unit_index", "unit_pk", "unit_id").alias("a"), ids("unit_id").alias("b"))
    return s.select("forum_id", "reviewer_key", (F.col("a") == F.col("b")).alias("in_order"))


QUERIES = Q
