"""Normalization queries: documents to papers and notes, fields, calendars, keyed writes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from delibera.functions import text as T
from delibera.functions.sql import FORUMS, NOTES, UNITS, cascade, instant, section
from delibera.operators import hierarchy
from delibera.operators import relational as R
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


@query("SELECT count(*) n, count(*) FILTER (json_valid(submission_json)) valid, count(*) FILTER (submission_json IS NOT NULL AND NOT coalesce(json_valid(submission_json), false)) broken FROM forums")
def a6_a7_tolerant_json(spark, d):
    ok = F.try_parse_json("submission_json").isNotNull()
    return read(spark, d, "forums").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("valid"), F.count_if(F.col("submission_json").isNotNull() & ~ok).alias("broken"))


@query(f"WITH {NOTES}, k AS (SELECT kind, unnest(json_keys(content_json)) field FROM m WHERE json_valid(content_json) AND json_type(content_json) = 'OBJECT') SELECT kind, field, count(*) n FROM k GROUP BY ALL")
def a19_field_inventory(spark, d):
    n = base.notes(spark, d, "kind", fields=F.expr("json_object_keys(CASE WHEN try_parse_json(content_json) IS NOT NULL THEN content_json END)"))
    return n.select("kind", F.explode("fields").alias("field")).groupBy("kind", "field").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {NOTES} SELECT kind, {cascade('invitations_json', T.KIND_RULES, 'unknown')} derived, count(*) n FROM m GROUP BY ALL")
def f_p17_kind_cascade(spark, d):
    return base.notes(spark, d, "kind", derived=T.kind_of(F.col("invitations_json"))).groupBy("kind", "derived").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {NOTES}, s AS (SELECT kind, {cascade('signature', T.SIGNATURE_RULES, '')} s FROM m) SELECT CASE WHEN s <> '' THEN s WHEN kind = 'decision' THEN 'program_chair' WHEN kind = 'meta_review' THEN 'area_chair' ELSE 'unknown' END AS role, kind, count(*) n FROM s GROUP BY ALL")
def f_p18_role_cascade(spark, d):
    return base.notes(spark, d, "signature", "kind").groupBy(T.role_of(F.col("signature"), F.col("kind")).alias("role"), "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {NOTES} SELECT note_id, coalesce({section('content_text', 'title')}, {section('content_text', 'decision')}, {section('content_text', 'metareview')}) head FROM m")
def f_p23_first_present(spark, d):
    t = F.col("content_text")
    return base.notes(spark, d, head=F.coalesce(T.section(t, "title"), T.section(t, "decision"), T.section(t, "metareview")))


@query(f"""WITH {NOTES} SELECT year, count(*) n, count(*) FILTER (lower({section('content_text', 'decision')}) LIKE '%accept%') like_n, count(*) FILTER (regexp_matches(lower({section('content_text', 'decision')}), 'accept|oral|poster|spotlight')) broad_n, count(*) FILTER (contains(lower({section('content_text', 'decision')}), 'accept')) word_n FROM m WHERE kind = 'decision' GROUP BY 1""")
def f_p22_accept_modes(spark, d):
    n = base.notes(spark, d, "year", "kind", said=T.section(F.col("content_text"), "decision")).where("kind = 'decision'")
    return n.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count_if(T.accepted(F.col("said"), "like")).alias("like_n"), F.count_if(T.accepted(F.col("said"))).alias("broad_n"), F.count_if(T.accepted(F.col("said"), "word")).alias("word_n"))


def _rating_sql(c):
    return f"CAST(nullif(regexp_extract(coalesce({c},''), '^\\s*(\\d+)', 1), '') AS INT) lead_int, CAST(nullif(regexp_extract(coalesce({c},''), '(-?\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) any_decimal, CAST(nullif(regexp_extract(coalesce({c},''), '^\\s*(\\d+(?:\\.\\d+)?)\\s*(?::.*)?$', 1), '') AS DOUBLE) prefixed"


@query(f"WITH {NOTES}, r AS (SELECT note_id, coalesce({section('content_text', 'rating')}, {section('content_text', 'recommendation')}) x FROM m WHERE kind = 'official_review') SELECT note_id, {_rating_sql('x')} FROM r")
def s2_rating_parsers(spark, d):
    t = F.col("content_text")
    r = base.notes(spark, d, "kind", x=F.coalesce(T.section(t, "rating"), T.section(t, "recommendation"))).where("kind = 'official_review'")
    return r.select("note_id", T.leading_int(F.col("x")).alias("lead_int"), T.first_decimal(F.col("x")).alias("any_decimal"), T.prefix_number(F.col("x")).alias("prefixed"))


@query(f"""WITH {NOTES}, {FORUMS}, g AS (SELECT forum_id, count(*) FILTER (kind = 'official_review') reviews, count(*) FILTER (kind LIKE '%comment') comments, bool_or(kind = 'meta_review') has_meta, bool_or(kind = 'withdrawal') withdrawn, arg_max({section('content_text', 'decision')}, (coalesce(cdate,-1), note_id)) FILTER (kind = 'decision') decision FROM m GROUP BY 1)
 SELECT f.year, f.forum_id, coalesce(reviews, 0) reviews, coalesce(comments, 0) AS "comments", coalesce(has_meta, false) has_meta, coalesce(withdrawn, false) withdrawn, decision FROM f LEFT JOIN g USING (forum_id)""")
def g46_w7_s10_papers(spark, d):
    n = base.notes(spark, d, "forum_id", "kind", "cdate", decision=T.section(F.col("content_text"), "decision"))
    g = n.groupBy("forum_id").agg(
        F.count_if(F.col("kind") == "official_review").alias("reviews"), F.count_if(F.col("kind").like("%comment")).alias("comments"), F.max(F.col("kind") == "meta_review").alias("has_meta"), F.max(F.col("kind") == "withdrawal").alias("withdrawn"),
        F.max(F.when(F.col("kind") == "decision", F.struct(F.coalesce("cdate", F.lit(-1)).alias("c"), F.col("note_id").alias("n"), F.col("decision").alias("d"))))["d"].alias("decision"),
    )
    zero, no = F.lit(0).cast("long"), F.lit(False)
    return base.forums(spark, d).select("year", "forum_id").join(g, "forum_id", "left").select("year", "forum_id", F.coalesce("reviews", zero).alias("reviews"), F.coalesce("comments", zero).alias("comments"), F.coalesce("has_meta", no).alias("has_meta"), F.coalesce("withdrawn", no).alias("withdrawn"), "decision")


MS = "CASE WHEN abs(cdate) < 100000000000 THEN cdate * 1000 WHEN abs(cdate) < 100000000000000 THEN cdate ELSE cdate // 1000 END"


@query(f"""WITH {NOTES}, e AS (SELECT CAST(make_timestamp({MS} * 1000) AS DATE) AS day, kind FROM m WHERE cdate IS NOT NULL AND cdate <> 0 AND year = 2024), s AS (SELECT min(day) a, max(day) b FROM e), g AS (SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM s), k AS (SELECT DISTINCT kind FROM e)
 SELECT g.day, k.kind, count(e.day) n FROM g CROSS JOIN k LEFT JOIN e ON e.day = g.day AND e.kind = k.kind GROUP BY ALL""")
def g42_daily_series(spark, d):
    """The notes of 2024 alone, as the SQL has it; g42_season_series has all years."""
    c = F.col("cdate")
    ms = F.when(F.abs(c) < 10**11, c * 1000).when(F.abs(c) < 10**14, c).otherwise(F.floor(c / 1000))
    n = base.notes(spark, d, "cdate", "year", "kind").where("cdate IS NOT NULL AND cdate <> 0 AND year = 2024")
    return R.daily(n, F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int")), "kind")  # days in UTC, whatever the session's zone


def _day(c):
    """Day in UTC of seconds, milliseconds or microseconds, whatever the session's zone."""
    ms = F.when(F.abs(c) < 10**11, c * 1000).when(F.abs(c) < 10**14, c).otherwise(F.floor(c / 1000))
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int"))


STAMP = "coalesce(nullif(TRY_CAST(json_extract_string(doc, '$.cdate') AS BIGINT), 0), nullif(TRY_CAST(json_extract_string(doc, '$.tcdate') AS BIGINT), 0))"


@query(f"""WITH {NOTES}, j AS (SELECT year, forum_id, fetched_at, CASE WHEN json_valid(submission_json) THEN CASE WHEN json_type(submission_json) = 'VARCHAR' THEN json_extract_string(submission_json, '$') ELSE submission_json END END doc FROM forums),
 x AS (SELECT year, forum_id, coalesce({instant('fetched_at')}, -1) fetched, CASE WHEN json_valid(doc) THEN {STAMP} END ms FROM j), y AS (SELECT year, forum_id, arg_max(ms, (fetched, ms)) cdate FROM x WHERE ms IS NOT NULL GROUP BY ALL),
 e AS (SELECT year, CAST(make_timestamp({MS} * 1000) AS DATE) AS day, kind FROM m WHERE cdate IS NOT NULL AND cdate <> 0 UNION ALL SELECT year, CAST(make_timestamp({MS} * 1000) AS DATE), 'submission' FROM y),
 c AS (SELECT year, day, kind, count(*) n FROM e GROUP BY ALL), k AS (SELECT DISTINCT kind FROM c),
 s AS (SELECT year, min(day) a, max(day) b, min(day) FILTER (kind IN ('submission', 'official_review') AND n >= 5) first_day, max(day) FILTER (kind IN ('decision', 'withdrawal') AND n >= 5) + 3 last_day FROM c GROUP BY 1),
 g AS (SELECT year, first_day, last_day, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(greatest(b, last_day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM s)
 SELECT g.year, g.day, k.kind, coalesce(c.n, 0) n, coalesce(g.day BETWEEN first_day AND last_day, false) dense FROM g CROSS JOIN k LEFT JOIN c ON c.day = g.day AND c.year IS NOT DISTINCT FROM g.year AND c.kind IS NOT DISTINCT FROM k.kind""")
def g42_season_series(spark, d):
    """All notes and submissions per year, day and kind, and whether the day is in the year's dense window.

    Submissions are dated by ``cdate``, else ``tcdate``, of the latest fetch that has one.
    """
    n = base.notes(spark, d, "cdate", "year", "kind").where("cdate IS NOT NULL AND cdate <> 0").select("year", _day(F.col("cdate")).alias("day"), "kind")
    raw = F.col("submission_json")
    doc = F.when(F.ltrim(raw).startswith('"'), F.get_json_object(raw, "$")).otherwise(raw)  # some are encoded twice
    stamp = lambda name: F.nullif(F.get_json_object(doc, f"$.{name}").try_cast("bigint"), F.lit(0))
    f = read(spark, d, "forums").select("year", "forum_id", F.coalesce(T.instant_of(F.col("fetched_at")), F.lit(-1)).alias("at"), F.coalesce(stamp("cdate"), stamp("tcdate")).alias("ms"))
    s = f.where("ms IS NOT NULL").groupBy("year", "forum_id").agg(F.max(F.struct("at", "ms"))["ms"].alias("ms")).select("year", _day(F.col("ms")).alias("day"), F.lit("submission").alias("kind"))
    return R.season(n.unionByName(s), ["submission", "official_review"], ["decision", "withdrawal"])


@query(f"""WITH {NOTES}, {FORUMS}, w AS (SELECT year, forum_id, note_id, kind, CASE WHEN trim(regexp_replace(coalesce(content_text,''), '\\s+', ' ', 'g'), ' ') = '' THEN 0 ELSE len(string_split(trim(regexp_replace(content_text, '\\s+', ' ', 'g'), ' '), ' ')) END words FROM m)
 SELECT year, count(*) notes, count(DISTINCT forum_id) forums, count(*) FILTER (kind = 'official_review') reviews, round(avg(words), 6) mean_words, round(median(words), 6) median_words, round(quantile_cont(words, 0.9), 6) p90 FROM w GROUP BY 1""")
def g43_g9_g10_field_stats(spark, d):
    n = base.notes(spark, d, "year", "forum_id", "kind", words=T.word_count(F.col("content_text")))
    return n.groupBy("year").agg(
        F.count(F.lit(1)).alias("notes"), F.count_distinct("forum_id").alias("forums"), F.count_if(F.col("kind") == "official_review").alias("reviews"), F.round(F.avg("words"), 6).alias("mean_words"), F.round(F.median("words"), 6).alias("median_words"), F.round(F.percentile("words", 0.9), 6).alias("p90")
    )


@query(f"WITH {NOTES}, b AS (SELECT year, CASE WHEN length(coalesce(content_text,'')) = 0 THEN 'empty' WHEN length(content_text) <= 300 THEN 'short' WHEN length(content_text) <= 900 THEN 'middle' ELSE 'long' END band FROM m), c AS (SELECT year, band, count(*) n FROM b GROUP BY ALL) SELECT year, band, n, round(n / sum(n) OVER (PARTITION BY year), 6) share FROM c")
def g44_j21_bands(spark, d):
    size = F.length(F.coalesce("content_text", F.lit("")))
    band = F.when(size == 0, "empty").when(size <= 300, "short").when(size <= 900, "middle").otherwise("long")
    c = base.notes(spark, d, "year", band=band).groupBy("year", "band").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("year")), 6))


@query("SELECT note_id, CASE WHEN content_text IS NULL THEN 0 ELSE length(content_text) - length(replace(content_text, ' ', '')) + 1 END by_spaces, length(content_text) AS chars, strlen(content_text) AS bytes FROM (SELECT DISTINCT note_id, content_text FROM messages)")
def s5_s19_counts(spark, d):
    t = F.col("content_text")
    return read(spark, d, "messages").select("note_id", "content_text").distinct().select("note_id", T.space_count(t).cast("bigint").alias("by_spaces"), F.length(t).cast("bigint").alias("chars"), F.octet_length(t).cast("bigint").alias("bytes"))


@query(f"WITH {NOTES}, g AS (SELECT forum_id, string_agg('[' || coalesce(kind,'') || ' ' || note_id || ']' || chr(10) || coalesce(content_text,''), chr(10) || chr(10) ORDER BY coalesce(cdate,0), note_id) doc, count(*) n FROM m GROUP BY 1) SELECT forum_id, n, md5(doc) doc_md5, length(doc) chars FROM g")
def d3_w10_forum_document(spark, d):
    """One document per forum, as the SQL has it: its size is that of the forum's text, and beyond ``MOST_BYTES`` it can't be a row.

    That is an error before the texts are gathered; w18_note_lines has the same lines as a row for each note.
    """
    size = base.notes(spark, d, "forum_id", size=F.octet_length(F.coalesce("content_text", F.lit(""))) + 100).groupBy("forum_id").agg(F.sum("size").alias("s")).agg(F.max("s")).first()[0]
    if (size or 0) > MOST_BYTES:
        raise ValueError(f"a forum has {size} bytes of text; a document of more than {MOST_BYTES} can't be a row")
    part = F.struct(F.coalesce("cdate", F.lit(0)).alias("c"), F.col("note_id"), F.concat(F.lit("["), F.coalesce("kind", F.lit("")), F.lit(" "), F.col("note_id"), F.lit("]\n"), F.coalesce("content_text", F.lit(""))).alias("t"))
    g = base.notes(spark, d, "forum_id", "kind", "cdate", "content_text").groupBy("forum_id").agg(F.sort_array(F.collect_list(part)).alias("p"))
    doc = F.array_join(F.col("p.t"), "\n\n")
    return g.select("forum_id", F.size("p").cast("bigint").alias("n"), F.md5(doc).alias("doc_md5"), F.length(doc).cast("bigint").alias("chars"))


#: Sorted array and joined text together stay under the 2 GB that a row may have.
MOST_BYTES = 700_000_000

LINK = f"{NOTES}, l AS (SELECT note_id, forum_id, kind, CASE WHEN x IS NULL OR x = forum_id THEN NULL ELSE x END parent FROM (SELECT *, nullif(regexp_extract(trim(coalesce(replyto,''), E' \\n\\t\\r'), '([^=&?#/\\s]*)$', 1), '') x FROM m)), ok AS (SELECT l.*, p.note_id pid FROM l LEFT JOIN l p ON p.note_id = l.parent AND p.forum_id = l.forum_id)"


@query(f"WITH RECURSIVE {LINK}, t(root, note_id, d) AS (SELECT note_id, note_id, 0 FROM ok WHERE parent IS NULL AND kind = 'official_review' UNION ALL SELECT t.root, ok.note_id, t.d + 1 FROM t JOIN ok ON ok.pid = t.note_id WHERE t.d < 300) SELECT root review_id, count(*) - 1 descendants, CAST(max(d) AS INT) deepest FROM t GROUP BY 1")
def j23_d5_review_threads(spark, d):
    p = hierarchy.found_places(read(spark, d, "messages")).where("link_state = 'ok'")
    reviews = base.notes(spark, d, "kind").where("kind = 'official_review'").select(F.col("note_id").alias("root_id"))
    return p.join(reviews, "root_id", "left_semi").groupBy(F.col("root_id").alias("review_id")).agg((F.count(F.lit(1)) - 1).alias("descendants"), F.max("node_depth").alias("deepest"))


@query(f"WITH RECURSIVE {LINK}, t(note_id, d) AS (SELECT note_id, 0 FROM ok WHERE parent IS NULL AND kind = 'official_review' UNION ALL SELECT ok.note_id, t.d + 1 FROM t JOIN ok ON ok.pid = t.note_id WHERE t.d < 300) SELECT forum_id, count(*) outside FROM m WHERE note_id NOT IN (SELECT note_id FROM t) GROUP BY 1")
def d4_outside_reviews(spark, d):
    p = hierarchy.found_places(read(spark, d, "messages")).where("link_state = 'ok'")
    n = base.notes(spark, d, "forum_id", "kind")
    inside = p.join(n.where("kind = 'official_review'").select(F.col("note_id").alias("root_id")), "root_id", "left_semi").select("note_id")
    return n.join(inside, "note_id", "left_anti").groupBy("forum_id").agg(F.count(F.lit(1)).alias("outside"))


@query(f"WITH {NOTES}, {FORUMS} SELECT 'message without forum' problem, count(DISTINCT m.forum_id) n FROM m ANTI JOIN f USING (forum_id) UNION ALL SELECT 'forum without message', count(*) FROM (SELECT DISTINCT forum_id FROM f WHERE forum_id NOT IN (SELECT forum_id FROM m))")
def j25_coverage(spark, d):
    r = R.reconcile(base.forums(spark, d), base.notes(spark, d, "forum_id"), ["forum_id"])
    both = spark.createDataFrame([("missing", "forum without message"), ("unexpected", "message without forum")], "state string, problem string")
    return both.join(r.groupBy("state").agg(F.count(F.lit(1)).alias("n")), "state", "left").select("problem", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query(f"WITH {NOTES} SELECT count(*) n, count(*) FILTER (EXISTS (SELECT 1 FROM m r WHERE r.replyto = m.note_id)) answered, count(*) FILTER (NOT EXISTS (SELECT 1 FROM m r WHERE r.replyto = m.note_id)) unanswered FROM m WHERE kind = 'official_review'")
def j7_p10_p11_exists(spark, d):
    n = base.notes(spark, d, "kind", "replyto")
    r = n.where("kind = 'official_review'").select("note_id")
    to = n.select(F.col("replyto").alias("note_id")).where("note_id IS NOT NULL").distinct().withColumn("_a", F.lit(True))
    return r.join(to, "note_id", "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_a").isNotNull()).alias("answered"), F.count_if(F.col("_a").isNull()).alias("unanswered"))


@query(f"WITH {NOTES} SELECT f.year, f.forum_id, (SELECT count(*) FROM m WHERE m.forum_id = f.forum_id) stored, max(f.reply_count) declared FROM forums f GROUP BY f.year, f.forum_id")
def v5_p13_declared_counts(spark, d):
    stored = base.notes(spark, d, "forum_id").groupBy("forum_id").agg(F.count(F.lit(1)).alias("stored"))
    f = read(spark, d, "forums").groupBy("year", "forum_id").agg(F.max("reply_count").alias("declared"))
    return f.join(stored, "forum_id", "left").select("year", "forum_id", F.coalesce("stored", F.lit(0).cast("long")).alias("stored"), "declared")


@query(f"WITH {NOTES}, k AS (SELECT DISTINCT forum_id, regexp_extract(signature, '([^_/]+)$', 1) suffix FROM m WHERE kind = 'official_review' AND signature IS NOT NULL), {UNITS}, v AS (SELECT forum_id, reviewer_key, count(*) n FROM u GROUP BY ALL) SELECT v.forum_id, v.reviewer_key, n FROM k JOIN v ON v.forum_id = k.forum_id AND regexp_extract(v.reviewer_key, '(\\d+)$', 1) = k.suffix")
def j10_derived_key_join(spark, d):
    k = base.notes(spark, d, "kind", "signature", "forum_id").where("kind = 'official_review' AND signature IS NOT NULL").select("forum_id", F.regexp_extract("signature", r"([^_/]+)$", 1).alias("suffix")).distinct()
    v = base.units(spark, d, "forum_id", "reviewer_key").groupBy("forum_id", "reviewer_key").agg(F.count(F.lit(1)).alias("n")).withColumn("suffix", F.regexp_extract("reviewer_key", r"(\d+)$", 1))
    return v.join(k, ["forum_id", "suffix"]).select("forum_id", "reviewer_key", "n")


@query(f"WITH {NOTES}, {FORUMS} SELECT f.year, f.forum_id, count(*) reviews FROM f JOIN m ON m.year = f.year AND m.forum_id = f.forum_id WHERE m.kind = 'official_review' GROUP BY ALL")
def j2_composite_join(spark, d):
    n = base.notes(spark, d, "kind", "year", "forum_id").where("kind = 'official_review'").select("year", "forum_id")
    return base.forums(spark, d).select("year", "forum_id").join(n, ["year", "forum_id"]).groupBy("year", "forum_id").agg(F.count(F.lit(1)).alias("reviews"))


FETCH = instant("fetched_at")


@query(f"SELECT forum_id, max({FETCH}) AS fetched FROM forums GROUP BY 1")
def k1_k3_upsert_last(spark, d):
    f = read(spark, d, "forums").select("forum_id", T.instant_of(F.col("fetched_at")).alias("at"), "reply_count")
    half = F.xxhash64("forum_id", "at") % 2 == 0
    t = R.upsert_last(f.where(half), f.where(~half | half.isNull()), ["forum_id"], [F.col("at").desc_nulls_last(), F.col("reply_count").desc_nulls_last()])
    return t.select("forum_id", F.col("at").alias("fetched"))


@query("WITH o AS (SELECT job_id, max(completion_tokens) v FROM api_calls WHERE status = 'failed' GROUP BY 1), n AS (SELECT job_id, max(completion_tokens) v FROM api_calls WHERE status = 'complete' GROUP BY 1) SELECT coalesce(o.job_id, n.job_id) job_id, coalesce(n.v, o.v) v FROM o FULL JOIN n ON o.job_id = n.job_id")
def k2_upsert_keep_null(spark, d):
    c = read(spark, d, "api_calls")
    by = lambda s: c.where(F.col("status") == s).groupBy("job_id").agg(F.max("completion_tokens").alias("v"))
    return R.upsert_keep_null(by("failed"), by("complete"), ["job_id"])


@query("WITH o AS (SELECT DISTINCT job_id FROM jobs WHERE stage = 'trajectory'), n AS (SELECT DISTINCT job_id FROM jobs WHERE stage IN ('trajectory','forum_direct')) SELECT job_id FROM o UNION SELECT job_id FROM n")
def k4_insert_or_ignore(spark, d):
    j = read(spark, d, "jobs").select("job_id", "stage")
    old = j.where("stage = 'trajectory'").select("job_id").distinct()
    return R.insert_or_ignore(old, j.where("stage IN ('trajectory','forum_direct')").select("job_id"), ["job_id"])


@query("SELECT j.job_id, j.stage FROM (SELECT DISTINCT job_id, stage FROM jobs) j WHERE NOT EXISTS (SELECT 1 FROM memos m WHERE m.job_id = j.job_id)")
def j6_t2_unprocessed(spark, d):
    return R.unseen(read(spark, d, "jobs").select("job_id", "stage").distinct(), read(spark, d, "memos"), ["job_id"])


@query(f"WITH {NOTES} SELECT note_id, replace(string_agg('[M:L' || printf('%03d', i) || '] ' || line, chr(10) ORDER BY i), chr(10), chr(10)) numbered FROM (SELECT note_id, unnest(string_split(content_text, chr(10))) line, generate_subscripts(string_split(content_text, chr(10)), 1) i FROM m WHERE kind = 'decision' AND content_text IS NOT NULL) GROUP BY 1")
def w18_line_numbers(spark, d):
    """Decisions alone, as the SQL has it; w18_note_lines has every note."""
    return base.notes(spark, d, "kind", "content_text").where("kind = 'decision' AND content_text IS NOT NULL").select("note_id", T.numbered_lines(F.col("content_text"), "M").alias("numbered"))


@query(f"""WITH {NOTES}, s AS (SELECT note_id, forum_id, regexp_split_to_array(content_text, '{T.BREAKS}') l FROM m WHERE content_text IS NOT NULL), t AS (SELECT note_id, forum_id, CASE WHEN len(l) > 1 AND l[-1] = '' THEN list_slice(l, 1, len(l) - 1) ELSE l END l FROM s)
 SELECT note_id, forum_id, len(l) n, array_to_string(list_transform(l, lambda x, i: '[M-' || coalesce(note_id, '') || ':L' || printf('%03d', i) || '] ' || x), chr(10)) numbered FROM t""")
def w18_note_lines(spark, d):
    """The numbered lines of every note that has a text; ``M-`` and the note's id before the number."""
    t = F.col("content_text")
    n = base.notes(spark, d, "forum_id", "content_text").where("content_text IS NOT NULL")
    return n.select("note_id", "forum_id", F.size(T.lines(t)).cast("bigint").alias("n"), T.identified_lines(t, F.concat(F.lit("M-"), F.coalesce("note_id", F.lit("")))).alias("numbered"))


QUERIES = Q
