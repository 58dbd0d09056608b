"""Panel queries: raters of a forum, their topics, signs, ratings and the decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from delibera.functions import text as T
from delibera.functions.sql import NOTES, UNITS, cascade, section
from delibera.operators import panels as P
from delibera.operators import sequence as S
from delibera.plans import base

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


X = f"""{UNITS}, x AS (SELECT unit_pk, year, forum_id, reviewer_key rk, reviewer_role, unit_index, temporal_position tp, judgment_change jc, support_status, update_trigger,
 lower(trim(valence)) v, CASE lower(trim(valence)) WHEN 'negative' THEN -1 WHEN 'positive' THEN 1 ELSE 0 END sg, {cascade('inspected_object', T.TOPIC_RULES, 'other')} topic, {cascade('reasoning', T.MOVE_RULES, 'other')} move FROM u)"""
DEC = f"""{NOTES}, d AS (SELECT forum_id, arg_max({section('content_text', 'decision')}, (coalesce(cdate,-1), note_id)) FILTER (kind = 'decision') decision, bool_or(kind = 'withdrawal') withdrawn FROM m WHERE kind IN ('decision','withdrawal') GROUP BY 1),
 acc AS (SELECT forum_id, regexp_matches(lower(decision), 'accept|oral|poster|spotlight') acc FROM d WHERE decision IS NOT NULL AND NOT withdrawn)"""
RAT = f"""{NOTES}, r AS (SELECT year, forum_id, note_id, CAST(coalesce(nullif(regexp_extract({section('content_text', 'rating')}, '^\\s*(\\d+)', 1), ''), nullif(regexp_extract({section('content_text', 'recommendation')}, '^\\s*(\\d+)', 1), '')) AS INT) rating
 FROM m WHERE kind = 'official_review'), rt AS (SELECT * FROM r WHERE rating IS NOT NULL)"""
CHANGED = "('strengthened','weakened','reversed','clarified')"


def x(spark, d):
    u = base.units(spark, d, "year", "forum_id", "reviewer_key", "reviewer_role", "unit_index", "temporal_position", "judgment_change", "support_status", "update_trigger", "valence", "inspected_object", "reasoning")
    v = F.lower(F.trim("valence"))
    return u.select(
        "unit_pk", "year", "forum_id", F.col("reviewer_key").alias("rk"), "reviewer_role", "unit_index", F.col("temporal_position").alias("tp"), F.col("judgment_change").alias("jc"), "support_status", "update_trigger",
        v.alias("v"), T.sign_of(v).alias("sg"), T.first_match(F.col("inspected_object"), T.TOPIC_RULES, "other").alias("topic"), T.first_match(F.col("reasoning"), T.MOVE_RULES, "other").alias("move"),
    )


def acc(spark, d):
    return base.decisions(spark, d).where("decision IS NOT NULL AND NOT withdrawn").select("forum_id", T.accepted(F.col("decision")).alias("acc"))


@query(f"WITH {X}, c AS (SELECT topic, CASE WHEN jc IN ('weakened','reversed') THEN 'softened' WHEN jc = 'strengthened' THEN 'hardened' ELSE 'same' END mv, {cascade('update_trigger', T.TRIGGER_RULES, 'unstated')} trig FROM x WHERE tp = 'post_author_response') SELECT topic, trig, count(*) n, count(*) FILTER (mv = 'softened') softened, count(*) FILTER (mv = 'hardened') hardened FROM c GROUP BY ALL")
def g18_p19_rebuttal_changes(spark, d):
    c = x(spark, d).where("tp = 'post_author_response'").withColumn("trig", T.first_match(F.col("update_trigger"), T.TRIGGER_RULES, "unstated"))
    return c.groupBy("topic", "trig").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("jc").isin("weakened", "reversed")).alias("softened"), F.count_if(F.col("jc") == "strengthened").alias("hardened"))


@query(f"WITH {X}, c AS (SELECT reviewer_role, topic, count(*) n FROM x GROUP BY ALL) SELECT reviewer_role, topic, n, round(n / sum(n) OVER (PARTITION BY reviewer_role), 6) share FROM c")
def g19_role_mix(spark, d):
    return S.shares(x(spark, d).groupBy("reviewer_role", "topic").agg(F.count(F.lit(1)).alias("n")), "n", ["reviewer_role"]).withColumn("share", F.round("share", 6))


SIGNS = f"{X}, sg AS (SELECT forum_id, rk, topic, CAST(sign(sum(sg)) AS INT) s FROM x GROUP BY ALL), ct AS (SELECT forum_id, topic, count(*) raters, bool_or(s = 1) AND bool_or(s = -1) contested FROM sg GROUP BY ALL HAVING count(*) >= 2)"


@query(f"WITH {SIGNS} SELECT topic, count(*) base, count(*) FILTER (contested) contested, round(count(*) FILTER (contested) / count(*), 6) rate FROM ct GROUP BY 1")
def g20_dissent(spark, d):
    c = P.contested(P.rater_signs(x(spark, d), ["forum_id"], "rk", "topic", "sg"), ["forum_id"], "topic")
    return c.groupBy("topic").agg(F.count(F.lit(1)).alias("base"), F.count_if("contested").alias("contested"), F.round(F.count_if("contested") / F.count(F.lit(1)), 6).alias("rate"))


@query(f"WITH {X}, {DEC}, ng AS (SELECT DISTINCT forum_id, topic FROM x WHERE sg = -1), t AS (SELECT DISTINCT topic FROM x), fp AS (SELECT DISTINCT forum_id, acc FROM acc WHERE forum_id IN (SELECT forum_id FROM x)) SELECT t.topic, count(ng.forum_id) n_with, count(*) - count(ng.forum_id) n_without, round(count(*) FILTER (ng.forum_id IS NOT NULL AND acc) / nullif(count(ng.forum_id), 0), 6) rate_with, round(count(*) FILTER (ng.forum_id IS NULL AND acc) / nullif(count(*) - count(ng.forum_id), 0), 6) rate_without FROM t CROSS JOIN fp LEFT JOIN ng ON ng.forum_id = fp.forum_id AND ng.topic = t.topic GROUP BY 1")
def g21_tribunal(spark, d):
    u = x(spark, d)
    decided = acc(spark, d).join(u.select("forum_id").distinct(), "forum_id", "left_semi")
    neg = u.where("sg = -1").select("forum_id", "topic").distinct()
    # totals less the forums with a negative unit: no forum is paired with every topic
    all_ = decided.agg(F.count(F.lit(1)).alias("n"), F.count_if("acc").alias("a")).first()
    w = decided.join(neg, "forum_id").groupBy("topic").agg(F.count(F.lit(1)).alias("n_with"), F.count_if("acc").alias("_aw"))
    t = u.select("topic").distinct().join(w, "topic", "left").fillna(0, ["n_with", "_aw"])
    without, aw = F.lit(all_["n"]) - F.col("n_with"), F.lit(all_["a"]) - F.col("_aw")
    return t.select("topic", "n_with", without.alias("n_without"), F.round(F.try_divide("_aw", "n_with"), 6).alias("rate_with"), F.round(F.try_divide(aw, without), 6).alias("rate_without"))


@query(f"WITH {X}, {DEC}, b AS (SELECT forum_id, count(DISTINCT topic) b FROM x WHERE sg = -1 GROUP BY 1) SELECT least(coalesce(b, 0), 9) breadth, count(*) n, round(avg(CAST(acc AS INT)), 6) rate FROM acc LEFT JOIN b USING (forum_id) GROUP BY 1")
def g22_gauntlet(spark, d):
    b = x(spark, d).where("sg = -1").groupBy("forum_id").agg(F.count_distinct("topic").alias("b"))
    return acc(spark, d).join(b, "forum_id", "left").groupBy(F.least(F.coalesce("b", F.lit(0).cast("long")), F.lit(9).cast("long")).alias("breadth")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("acc").cast("int")), 6).alias("rate"))


@query(f"WITH {X}, y AS (SELECT DISTINCT year FROM x), t AS (SELECT DISTINCT topic FROM x) SELECT t.topic, y.year, count(x.unit_pk) n, coalesce(round(count(*) FILTER (x.support_status = 'memo_inferred') / nullif(count(x.unit_pk), 0), 6), 0.0) inferred FROM t CROSS JOIN y LEFT JOIN x ON x.topic = t.topic AND x.year = y.year GROUP BY ALL")
def g23_reliability_grid(spark, d):
    u = x(spark, d)
    c = u.groupBy("topic").pivot("year", [r[0] for r in u.select("year").distinct().orderBy("year").collect()]).agg(F.struct(F.count(F.lit(1)).alias("n"), F.count_if(F.col("support_status") == "memo_inferred").alias("i")))
    years = [k for k in c.columns if k != "topic"]
    rows = F.explode(F.array(*[F.struct(F.lit(int(y)).alias("year"), F.coalesce(F.col(f"`{y}`.n"), F.lit(0).cast("long")).alias("n"), F.coalesce(F.col(f"`{y}`.i"), F.lit(0).cast("long")).alias("i")) for y in years]))
    return c.select("topic", rows.alias("r")).select("topic", "r.year", "r.n", F.coalesce(F.round(F.try_divide("r.i", "r.n"), 6), F.lit(0.0)).alias("inferred"))


@query(f"WITH {X}, p AS (SELECT forum_id, rk, count(*) n, {', '.join(f'''count(*) FILTER (topic = '{t}') / count(*) s_{t}''' for _, t in T.TOPIC_RULES)} FROM x GROUP BY ALL HAVING count(*) >= 5) SELECT forum_id, rk, n, {', '.join(f'round(s_{t}, 6) s_{t}' for _, t in T.TOPIC_RULES)} FROM p")
def g24_profiles(spark, d):
    g = x(spark, d).groupBy("forum_id", "rk").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.count_if(F.col("topic") == t) / F.count(F.lit(1)), 6).alias(f"s_{t}") for _, t in T.TOPIC_RULES])
    return g.where("n >= 5")


@query(f"WITH {X} SELECT year, count(*) units, count(DISTINCT (forum_id, rk)) reviewers, round(count(*) / count(DISTINCT (forum_id, rk)), 6) per_reviewer, round(count(*) FILTER (tp = 'post_author_response') / count(*), 6) post_share, round(count(*) FILTER (jc = 'weakened') / count(*), 6) soft_all, round(count(*) FILTER (jc = 'weakened') / nullif(count(*) FILTER (jc IN {CHANGED}), 0), 6) soft_changed FROM x GROUP BY 1")
def g26_vitals(spark, d):
    soft = F.count_if(F.col("jc") == "weakened")
    return x(spark, d).groupBy("year").agg(
        F.count(F.lit(1)).alias("units"), F.count_distinct("forum_id", "rk").alias("reviewers"), F.round(F.count(F.lit(1)) / F.count_distinct("forum_id", "rk"), 6).alias("per_reviewer"),
        F.round(F.count_if(F.col("tp") == "post_author_response") / F.count(F.lit(1)), 6).alias("post_share"), F.round(soft / F.count(F.lit(1)), 6).alias("soft_all"),
        F.round(F.try_divide(soft, F.count_if(F.col("jc").isin("strengthened", "weakened", "reversed", "clarified"))), 6).alias("soft_changed"),
    )


@query(f"WITH {X} SELECT move, topic, v, year, count(*) n FROM x GROUP BY GROUPING SETS ((move), (move, topic), (move, v), (move, year))")
def g27_p20_moves(spark, d):
    return x(spark, d).groupingSets([("move",), ("move", "topic"), ("move", "v"), ("move", "year")], "move", "topic", "v", "year").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SIGNS}, {DEC}, pn AS (SELECT forum_id, count(DISTINCT rk) r, count(*) FILTER (tp = 'post_author_response') post, count(*) FILTER (jc = 'weakened') soft, count(*) FILTER (jc = 'strengthened') hard FROM x GROUP BY 1),
 cn AS (SELECT forum_id, bool_or(contested) c FROM ct GROUP BY 1), s AS (SELECT forum_id, CASE WHEN post = 0 THEN 'silence' WHEN soft > hard THEN 'softening' WHEN hard > soft THEN 'entrenchment' WHEN coalesce(c, false) THEN 'contested' ELSE 'procedural' END sig FROM pn LEFT JOIN cn USING (forum_id) WHERE r >= 3)
 SELECT sig, count(*) n, count(acc) decided, CASE WHEN count(acc) > 10 THEN round(avg(CAST(acc AS INT)), 6) END rate FROM s LEFT JOIN acc USING (forum_id) GROUP BY 1""")
def g28_j9_signatures(spark, d):
    u = x(spark, d)
    c = P.contested(P.rater_signs(u, ["forum_id"], "rk", "topic", "sg"), ["forum_id"], "topic").groupBy("forum_id").agg(F.max("contested").alias("c"))
    p = u.groupBy("forum_id").agg(F.count_distinct("rk").alias("r"), F.count_if(F.col("tp") == "post_author_response").alias("post"), F.count_if(F.col("jc") == "weakened").alias("soft"), F.count_if(F.col("jc") == "strengthened").alias("hard")).where("r >= 3")
    sig = F.when(F.col("post") == 0, "silence").when(F.col("soft") > F.col("hard"), "softening").when(F.col("hard") > F.col("soft"), "entrenchment").when(F.coalesce("c", F.lit(False)), "contested").otherwise("procedural")
    return p.join(c, "forum_id", "left").select("forum_id", sig.alias("sig")).join(acc(spark, d), "forum_id", "left").groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.count("acc").alias("decided"), F.when(F.count("acc") > 10, F.round(F.avg(F.col("acc").cast("int")), 6)).alias("rate"))


OVER = f"{X}, st AS (SELECT DISTINCT forum_id, rk, topic FROM x), sz AS (SELECT forum_id, rk, count(*) n FROM st GROUP BY ALL), j AS (SELECT a.forum_id, a.rk a, b.rk b, round((SELECT count(*) FROM st p JOIN st q USING (forum_id, topic) WHERE p.forum_id = a.forum_id AND p.rk = a.rk AND q.rk = b.rk) / (a.n + b.n - (SELECT count(*) FROM st p JOIN st q USING (forum_id, topic) WHERE p.forum_id = a.forum_id AND p.rk = a.rk AND q.rk = b.rk)), 6) jac FROM sz a JOIN sz b ON a.forum_id = b.forum_id AND a.rk < b.rk)"


@query(f"WITH {OVER} SELECT forum_id, count(*) pairs, round(avg(jac), 5) overlap FROM j GROUP BY 1")
def g29_j16_overlap(spark, d):
    j = P.set_overlap(x(spark, d), ["forum_id"], "rk", "topic").withColumn("jac", F.round("jaccard", 6))
    return j.groupBy("forum_id").agg(F.round(F.sum(F.round(F.col("jac") * 1_000_000).cast("long") * F.col("pairs")) / F.sum("pairs") / 1_000_000, 5).alias("overlap"), F.sum("pairs").alias("pairs"))


@query(f"WITH {OVER} SELECT CAST(least(9, floor(jac * 10)) AS INT) bin, count(*) n FROM j GROUP BY 1")
def g30_histogram(spark, d):
    j = P.set_overlap(x(spark, d), ["forum_id"], "rk", "topic").withColumn("jac", F.round("jaccard", 6))
    return j.groupBy(F.least(F.lit(9), F.floor(F.col("jac") * 10)).cast("int").alias("bin")).agg(F.sum("pairs").alias("n"))


@query(f"WITH {SIGNS}, rv AS (SELECT DISTINCT forum_id, topic FROM x WHERE tp = 'post_author_response') SELECT contested, count(*) n, count(rv.forum_id) revisited, round(count(rv.forum_id) / count(*), 6) rate FROM ct LEFT JOIN rv USING (forum_id, topic) GROUP BY 1")
def g31_revisits(spark, d):
    u = x(spark, d)
    c = P.contested(P.rater_signs(u, ["forum_id"], "rk", "topic", "sg"), ["forum_id"], "topic")
    rv = u.where("tp = 'post_author_response'").select("forum_id", "topic").distinct().withColumn("_r", F.lit(True))
    return c.join(rv, ["forum_id", "topic"], "left").groupBy("contested").agg(F.count(F.lit(1)).alias("n"), F.count("_r").alias("revisited"), F.round(F.count("_r") / F.count(F.lit(1)), 6).alias("rate"))


@query(f"""WITH {X}, ra AS (SELECT DISTINCT forum_id, rk, topic FROM x WHERE tp = 'initial_review' AND sg = -1), rv AS (SELECT forum_id, rk, topic, bool_or(jc IN ('weakened','reversed')) soft, bool_or(jc = 'strengthened') hard FROM x WHERE tp = 'post_author_response' GROUP BY ALL)
 SELECT topic, count(*) raised, count(rv.rk) revisited, count(*) FILTER (soft) softened, count(*) FILTER (hard) hardened, round(count(*) FILTER (soft) / nullif(count(rv.rk), 0), 6) soft_if, round(count(*) FILTER (soft) / count(*), 6) soft_all FROM ra LEFT JOIN rv USING (forum_id, rk, topic) GROUP BY 1""")
def g32_j11_fates(spark, d):
    u = x(spark, d)
    ra = u.where("tp = 'initial_review' AND sg = -1").select("forum_id", "rk", "topic").distinct()
    rv = u.where("tp = 'post_author_response'").groupBy("forum_id", "rk", "topic").agg(F.max(F.col("jc").isin("weakened", "reversed")).alias("soft"), F.max(F.col("jc") == "strengthened").alias("hard"), F.lit(1).alias("_v"))
    soft = F.count_if("soft")
    return ra.join(rv, ["forum_id", "rk", "topic"], "left").groupBy("topic").agg(F.count(F.lit(1)).alias("raised"), F.count("_v").alias("revisited"), soft.alias("softened"), F.count_if("hard").alias("hardened"), F.round(F.try_divide(soft, F.count("_v")), 6).alias("soft_if"), F.round(soft / F.count(F.lit(1)), 6).alias("soft_all"))


@query(f"""WITH {RAT}, g AS (SELECT forum_id, count(*) n, avg(rating) m, var_pop(rating) * count(*) ss FROM rt GROUP BY 1 HAVING count(*) >= 2), t AS (SELECT count(*) groups, CAST(sum(n) AS BIGINT) total, sum(ss) ssw, sum(n*n) n2, sum(n*m) s1, sum(n*m*m) s2 FROM g),
 k AS (SELECT groups, total, (s2 - s1*s1/total) / (groups - 1) msb, ssw / (total - groups) msw, (total - n2/total) / (groups - 1) n0 FROM t)
 SELECT groups, total, round(msb, 5) msb, round(msw, 5) msw, round(n0, 5) n0, round((msb - msw) / (msb + (n0 - 1) * msw), 5) icc, round(sqrt(msw), 5) sd_within, round(sqrt(greatest(0, (msb - msw) / n0)), 5) sd_between FROM k""")
def g33_icc(spark, d):
    r = P.one_way_icc(base.ratings(spark, d), ["forum_id"], "rating")
    return r.select("groups", "total", *[F.round(c, 5).alias(c) for c in ("msb", "msw", "n0", "icc", "sd_within", "sd_between")])


@query(f"WITH {RAT} SELECT round(avg(abs(a.rating - b.rating)), 6) mean_gap, count(*) pairs FROM rt a JOIN rt b ON a.forum_id = b.forum_id AND a.note_id < b.note_id")
def g34_mean_gap(spark, d):
    return P.mean_gap(base.ratings(spark, d), ["forum_id"], "rating").withColumn("mean_gap", F.round("mean_gap", 6))


@query(f"WITH {X}, c AS (SELECT year, topic, count(*) c FROM x GROUP BY ALL), p AS (SELECT *, c / sum(c) OVER (PARTITION BY year) p FROM c) SELECT year, CAST(sum(c) AS BIGINT) n, count(*) levels, round(CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END, 6) entropy FROM p GROUP BY 1")
def g35_entropy(spark, d):
    return P.normalized_entropy(x(spark, d), ["year"], "topic").withColumn("entropy", F.round("entropy", 6))


@query(f"""WITH {RAT}, w AS (SELECT rating, CAST(round_even((sum(rating) OVER (PARTITION BY forum_id) - rating) / (count(*) OVER (PARTITION BY forum_id) - 1), 0) AS INT) others, count(*) OVER (PARTITION BY forum_id) n FROM rt),
 c AS (SELECT others, rating, count(*) n FROM w WHERE n >= 3 GROUP BY ALL) SELECT * FROM (SELECT others, rating, n, round(n / sum(n) OVER (PARTITION BY others), 6) p, CAST(sum(n) OVER (PARTITION BY others) AS BIGINT) support FROM c) WHERE support >= 10""")
def g36_w8_leave_one_out(spark, d):
    c = S.leave_one_out(base.ratings(spark, d), ["forum_id"], "rating").groupBy("others", "rating").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("others")
    return c.withColumn("p", F.round(F.col("n") / F.sum("n").over(w), 6)).withColumn("support", F.sum("n").over(w)).where("support >= 10")


@query(f"WITH {DEC}, {RAT.replace(NOTES + ', ', '')}, g AS (SELECT forum_id, max(rating) - min(rating) gap FROM rt GROUP BY 1 HAVING count(*) >= 3) SELECT gap, count(*) n, CASE WHEN count(acc) > 5 THEN round(avg(CAST(acc AS INT)), 6) END rate FROM g LEFT JOIN acc USING (forum_id) GROUP BY 1")
def g37_gaps(spark, d):
    g = base.ratings(spark, d).groupBy("forum_id").agg((F.max("rating") - F.min("rating")).alias("gap"), F.count(F.lit(1)).alias("n")).where("n >= 3").drop("n")
    return g.join(acc(spark, d), "forum_id", "left").groupBy("gap").agg(F.count(F.lit(1)).alias("n"), F.when(F.count("acc") > 5, F.round(F.avg(F.col("acc").cast("int")), 6)).alias("rate"))


BAR = f"""{DEC}, {RAT.replace(NOTES + ', ', '')}, pm AS (SELECT year, forum_id, avg(rating) mean, count(*) n, acc FROM rt JOIN acc USING (forum_id) GROUP BY ALL), yr AS (SELECT year, count(*) k, avg(CAST(acc AS INT)) rate FROM pm GROUP BY 1),
 rk AS (SELECT pm.*, k, rate, row_number() OVER (PARTITION BY pm.year ORDER BY mean, forum_id) - 1 i FROM pm JOIN yr USING (year)), th AS (SELECT year, mean bar FROM rk WHERE i = least(k - 1, CAST(floor(k * (1 - rate) + 1e-9) AS BIGINT)))"""


def _bar(spark, d):
    m = base.ratings(spark, d).join(acc(spark, d), "forum_id").groupBy("year", "forum_id", "acc").agg(F.avg("rating").alias("mean"))
    years = m.groupBy("year").agg(F.avg(F.col("acc").cast("int")).alias("rate"))
    r = S.ranked_within(m, ["year"], ["mean", "forum_id"]).join(years, "year")
    k = F.col("_of")
    r = r.select("year", "mean", "rate", F.col("pos").alias("i"), F.col("n").alias("_of"))
    th = r.where(F.col("i") == F.least(k - 1, F.floor(k * (1 - F.col("rate")) + 1e-9))).select("year", F.col("mean").alias("bar"))
    return m, th


@query(f"WITH {BAR} SELECT year, round(bar, 6) bar FROM th")
def g38_quantile_bar(spark, d):
    return _bar(spark, d)[1].withColumn("bar", F.round("bar", 6))


@query(f"WITH {BAR}, ds AS (SELECT least(6, CAST(floor(abs(mean - bar) / 0.5 + 1e-9) AS INT)) band, (mean >= bar) = acc ag FROM pm JOIN th USING (year)) SELECT band, count(*) n, round(avg(CAST(ag AS INT)), 6) agree FROM ds GROUP BY 1 HAVING count(*) >= 2")
def g39_agreement_bands(spark, d):
    m, th = _bar(spark, d)
    band = F.least(F.lit(6), F.floor(F.abs(F.col("mean") - F.col("bar")) / 0.5 + 1e-9).cast("int"))
    return m.join(th, "year").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(((F.col("mean") >= F.col("bar")) == F.col("acc")).cast("int")), 6).alias("agree")).where("n >= 2")


@query(f"WITH {BAR}, ov AS (SELECT year, forum_id, acc, mean - bar delta FROM pm JOIN th USING (year) WHERE (acc AND mean - bar < -0.5) OR (NOT acc AND mean - bar > 0.5)) SELECT year, forum_id, acc, round(delta, 6) delta FROM (SELECT *, row_number() OVER (PARTITION BY acc ORDER BY abs(round(delta, 6)) DESC, forum_id) rn FROM ov) WHERE rn <= 8")
def g40_overruled(spark, d):
    m, th = _bar(spark, d)
    delta = F.col("mean") - F.col("bar")
    o = m.join(th, "year").where((F.col("acc") & (delta < -0.5)) | (~F.col("acc") & (delta > 0.5))).select("year", "forum_id", "acc", F.round(delta, 6).alias("delta"))
    return o.withColumn("rn", F.row_number().over(Window.partitionBy("acc").orderBy(F.abs("delta").desc(), "forum_id"))).where("rn <= 8").drop("rn")


@query(f"WITH {X}, ar AS (SELECT DISTINCT forum_id, year FROM x), ng AS (SELECT DISTINCT forum_id, year, topic FROM x WHERE sg = -1), t AS (SELECT DISTINCT topic FROM x), k AS (SELECT year, count(*) n FROM ar GROUP BY ROLLUP (year)) SELECT k.year, t.topic, k.n, round((SELECT count(*) FROM ng WHERE ng.topic = t.topic AND (k.year IS NULL OR ng.year = k.year)) / k.n, 6) share FROM k CROSS JOIN t")
def g41_area_profile(spark, d):
    u = x(spark, d)
    n = u.select("forum_id", "year").distinct().rollup("year").agg(F.count(F.lit(1)).alias("n"))
    neg = u.where("sg = -1").select("forum_id", "year", "topic").distinct().cube("year", "topic").agg(F.count(F.lit(1)).alias("c"), F.grouping("topic").alias("g")).where("g = 0").drop("g")
    grid = n.join(F.broadcast(u.select("topic").distinct()))  # years x topics: both are fixed lists
    return grid.join(neg, grid["year"].eqNullSafe(neg["year"]) & (grid["topic"] == neg["topic"]), "left").select(grid["year"], grid["topic"], "n", F.round(F.coalesce("c", F.lit(0)) / F.col("n"), 6).alias("share"))


@query(f"""WITH {X}, {RAT}, fr AS (SELECT forum_id, CAST(round_even(avg(rating), 0) AS INT) rb, avg(rating) mean FROM rt GROUP BY 1), ft AS (SELECT DISTINCT fr.forum_id, rb, mean, t.topic FROM fr CROSS JOIN (SELECT DISTINCT topic FROM x) t),
 fl AS (SELECT ft.*, ng.forum_id IS NOT NULL neg FROM ft LEFT JOIN (SELECT DISTINCT forum_id, topic FROM x WHERE sg = -1) ng USING (forum_id, topic)), cl AS (SELECT topic, rb, count(*) FILTER (neg) nn, avg(mean) FILTER (neg) - avg(mean) FILTER (NOT neg) delta FROM fl GROUP BY ALL HAVING count(*) FILTER (neg) >= 2 AND count(*) FILTER (NOT neg) >= 2)
 SELECT topic, CAST(sum(nn) AS BIGINT) n, round(sum(nn * delta) / sum(nn), 6) delta FROM cl GROUP BY 1""")
def g60_adjusted_delta(spark, d):
    u = x(spark, d)
    fr = base.ratings(spark, d).groupBy("forum_id").agg(F.avg("rating").alias("mean")).withColumn("rb", F.bround("mean", 0).cast("int"))
    neg = u.where("sg = -1").select("forum_id", "topic").distinct().join(fr, "forum_id").groupBy("topic", "rb").agg(F.count(F.lit(1)).alias("nn"), F.sum("mean").alias("sn"))
    cells = fr.groupBy("rb").agg(F.count(F.lit(1)).alias("all"), F.sum("mean").alias("sa")).join(neg, "rb").where("nn >= 2 AND all - nn >= 2")
    delta = F.col("sn") / F.col("nn") - (F.col("sa") - F.col("sn")) / (F.col("all") - F.col("nn"))
    return cells.groupBy("topic").agg(F.sum("nn").alias("n"), F.round(F.sum(F.col("nn") * delta) / F.sum("nn"), 6).alias("delta"))


QUERIES = Q
