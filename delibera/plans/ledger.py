"""Job and ledger queries: states, budgets, retries, costs, packing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from delibera.functions import text as T
from delibera.functions.sql import CALLS, MEMOS, NOTES, instant
from delibera.operators import relational as R
from delibera.operators import sequence
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


JOBS = "j AS (SELECT DISTINCT * FROM jobs)"


def jobs(spark, d):
    return read(spark, d, "jobs").dropDuplicates()


@query(f"WITH {JOBS} SELECT stage, status, count(*) n, CAST(coalesce(sum(max_tokens), 0) AS BIGINT) tokens FROM j GROUP BY ALL")
def g6_g3_d14_status(spark, d):
    return jobs(spark, d).groupBy("stage", "status").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("max_tokens"), F.lit(0)).cast("long").alias("tokens"))


@query(f"WITH {JOBS}, {CALLS}, {MEMOS} SELECT j.stage, count(*) n, count(DISTINCT j.job_id) jobs, CAST(sum(c.actual_microusd) AS BIGINT) cost, CAST(sum(length(memo.memo)) AS BIGINT) chars FROM j JOIN memo USING (job_id) JOIN c USING (job_id) GROUP BY 1")
def j3_job_join(spark, d):
    m = base.memos(spark, d).select("job_id", F.length("memo").cast("long").alias("l"))
    c = base.calls(spark, d).select("job_id", "actual_microusd")
    return jobs(spark, d).select("job_id", "stage").join(m, "job_id").join(c, "job_id").groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("job_id").alias("jobs"), F.sum("actual_microusd").alias("cost"), F.sum("l").alias("chars"))


@query(f"WITH {JOBS}, {CALLS}, s AS (SELECT j.stage, c.actual_microusd x FROM c JOIN j USING (job_id) WHERE c.actual_microusd IS NOT NULL) SELECT stage, count(*) n, round(avg(x), 6) mean, quantile_cont(x, 0.25) p25, quantile_cont(x, 0.5) p50, quantile_cont(x, 0.75) p75, round(CASE WHEN count(*) >= 2 THEN var_pop(x) ELSE 0 END, 4) var, CAST(ceil(avg(x) * 1000) AS BIGINT) projected FROM s GROUP BY 1")
def g10_g11_g52_costs(spark, d):
    s = base.calls(spark, d).join(jobs(spark, d).select("job_id", "stage"), "job_id").where("actual_microusd IS NOT NULL")
    x = F.col("actual_microusd")
    return s.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(x), 6).alias("mean"), F.percentile(x, 0.25).alias("p25"), F.percentile(x, 0.5).alias("p50"), F.percentile(x, 0.75).alias("p75"), F.round(F.when(F.count(F.lit(1)) >= 2, F.var_pop(x)).otherwise(0.0), 4).alias("var"), F.ceil(F.avg(x) * 1000).cast("long").alias("projected"))


@query(f"WITH {CALLS} SELECT job_id, started_at, prompt_tokens, CASE WHEN prompt_tokens <= 3000 THEN 1.0::DOUBLE WHEN prompt_tokens <= 8000 THEN 1.5::DOUBLE WHEN prompt_tokens <= 100000000 THEN 2.5::DOUBLE END price FROM c WHERE prompt_tokens IS NOT NULL")
def g53_j21_price_tiers(spark, d):
    c = base.calls(spark, d).where("prompt_tokens IS NOT NULL")
    return c.select("job_id", "started_at", "prompt_tokens", T.tier(F.col("prompt_tokens"), [(3000, 1.0), (8000, 1.5), (100_000_000, 2.5)]).alias("price"))


ST = f"coalesce({instant('started_at')}, -1)"


@query(f"WITH {CALLS}, o AS (SELECT model, job_id, {ST} AS st, coalesce(reserved_microusd, 0) r FROM c), s AS (SELECT *, CAST(sum(r) OVER (PARTITION BY lower(trim(model)) ORDER BY st, job_id, r ROWS UNBOUNDED PRECEDING) AS BIGINT) used FROM o), g AS (SELECT *, min(CASE WHEN used > 500000 THEN st END) OVER (PARTITION BY lower(trim(model))) gate FROM s) SELECT lower(trim(model)) model, count(*) calls, count(*) FILTER (used <= 500000) admitted, max(used) FILTER (used <= 500000) spent FROM g GROUP BY 1")
def t5_budget_gate(spark, d):
    c = base.calls(spark, d).select(F.lower(F.trim("model")).alias("model"), "job_id", F.coalesce(T.instant_of(F.col("started_at")), F.lit(-1)).alias("at"), F.coalesce("reserved_microusd", F.lit(0)).alias("r"))
    # amounts aren't negative: the running sum passes the cap once, and everything after is closed out
    s = sequence.running_sum(c, ["model"], ["at", "job_id", "r"], "r", "used")
    ok = F.col("used") <= 500000
    return s.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.count_if(ok).alias("admitted"), F.max(F.when(ok, F.col("used"))).alias("spent"))


@query(f"WITH {CALLS} SELECT job_id, count(*) attempts, count(*) FILTER (status = 'failed') failed, bool_or(status = 'complete') done, CASE WHEN bool_or(status = 'complete') THEN 'complete' WHEN count(*) FILTER (status = 'failed') >= 3 THEN 'exhausted' WHEN bool_or(status = 'running') THEN 'charge_and_retry' ELSE 'retry' END next FROM c GROUP BY 1")
def t4_t6_t9_retry_states(spark, d):
    done, failed = F.max(F.col("status") == "complete"), F.count_if(F.col("status") == "failed")
    nxt = F.when(done, "complete").when(failed >= 3, "exhausted").when(F.max(F.col("status") == "running"), "charge_and_retry").otherwise("retry")
    return base.calls(spark, d).groupBy("job_id").agg(F.count(F.lit(1)).alias("attempts"), failed.alias("failed"), done.alias("done"), nxt.alias("next"))


@query(f"WITH {CALLS}, {JOBS} SELECT j.job_id, least(max(j.max_tokens) + 128, 600) next_limit FROM j JOIN c USING (job_id) WHERE lower(c.finish_reason) IN ('length','max_tokens','incomplete') GROUP BY 1")
def t8_token_steps(spark, d):
    c = base.calls(spark, d).where(F.lower("finish_reason").isin("length", "max_tokens", "incomplete")).select("job_id")
    return jobs(spark, d).join(c, "job_id").groupBy("job_id").agg(F.least(F.max("max_tokens") + 128, F.lit(600)).alias("next_limit"))


@query(f"WITH {CALLS}, p AS (SELECT lower(trim(model)) model, status = 'failed' bad, row_number() OVER (PARTITION BY lower(trim(model)) ORDER BY {ST}, job_id, status, coalesce(finish_reason,'')) - 1 pos FROM c), r AS (SELECT *, pos - row_number() OVER (PARTITION BY model ORDER BY pos) i FROM p WHERE bad) SELECT model, CAST(min(pos) AS INT) AS start, count(*) length FROM r GROUP BY model, i HAVING count(*) >= 2")
def t7_failure_runs(spark, d):
    c = base.calls(spark, d).select(F.lower(F.trim("model")).alias("model"), F.coalesce(T.instant_of(F.col("started_at")), F.lit(-1)).alias("at"), "job_id", "status", F.coalesce("finish_reason", F.lit("")).alias("fr"), (F.col("status") == "failed").alias("bad"))
    return sequence.run_lengths(c, ["model"], ["at", "job_id", "status", "fr"], "bad", few=True).where("length >= 2")


@query(f"WITH {JOBS}, k AS (SELECT paper_id, count(*) FILTER (stage = 'initial_blind') i, count(*) FILTER (stage = 'initial_blind' AND status = 'complete') ic, count(*) FILTER (stage = 'trajectory') t FROM j GROUP BY 1) SELECT paper_id, i = ic AND i > 0 next_stage_open, t FROM k")
def t10_stage_gates(spark, d):
    k = jobs(spark, d).groupBy("paper_id").agg(F.count_if(F.col("stage") == "initial_blind").alias("i"), F.count_if((F.col("stage") == "initial_blind") & (F.col("status") == "complete")).alias("ic"), F.count_if(F.col("stage") == "trajectory").alias("t"))
    return k.select("paper_id", ((F.col("i") == F.col("ic")) & (F.col("i") > 0)).alias("next_stage_open"), "t")


@query(f"WITH {JOBS}, {CALLS} SELECT 'response without job' state, count(DISTINCT c.job_id) n FROM c ANTI JOIN j USING (job_id) UNION ALL SELECT 'job without response', count(DISTINCT j.job_id) FROM j ANTI JOIN c USING (job_id)")
def t13_responses(spark, d):
    r = R.reconcile(jobs(spark, d), base.calls(spark, d), ["job_id"]).groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    names = spark.createDataFrame([("missing", "job without response"), ("unexpected", "response without job")], "k string, state string")
    return names.join(r.withColumnRenamed("state", "k"), "k", "left").select("state", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query(f"WITH {CALLS}, x AS (SELECT *, CASE WHEN status = 'complete' THEN 'none' WHEN lower(coalesce(finish_reason,'')) = 'length' THEN 'truncated' WHEN error IS NULL THEN 'lost' WHEN regexp_matches(lower(error), 'time|timeout') THEN 'timeout' WHEN regexp_matches(lower(error), 'rate|429|limit') THEN 'rate_limit' ELSE 'other' END cat FROM c) SELECT status, cat, count(*) n FROM x GROUP BY ALL")
def t_p16_p24_triage(spark, d):
    err = F.lower("error")
    cat = F.when(F.col("status") == "complete", "none").when(F.lower(F.coalesce("finish_reason", F.lit(""))) == "length", "truncated").when(F.col("error").isNull(), "lost").when(err.rlike("time|timeout"), "timeout").when(err.rlike("rate|429|limit"), "rate_limit").otherwise("other")
    return base.calls(spark, d).withColumn("cat", cat).groupBy("status", "cat").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CALLS}, f AS (SELECT job_id, arg_min(prompt_tokens, {ST}) first_tokens, arg_max(status, ({ST}, status)) last_status, count(*) n FROM c GROUP BY 1) SELECT job_id, first_tokens, last_status, n FROM f WHERE n > 1")
def t12_retry_merge(spark, d):
    at = F.coalesce(T.instant_of(F.col("started_at")), F.lit(-1))
    g = base.calls(spark, d).withColumn("at", at).groupBy("job_id").agg(F.min_by("prompt_tokens", "at").alias("first_tokens"), F.max_by("status", F.struct("at", "status")).alias("last_status"), F.count(F.lit(1)).alias("n"))
    return g.where("n > 1")


@query(None)
def w12_packs(spark, d):
    m = base.memos(spark, d).select("stage", "job_id", F.length("memo").cast("long").alias("size"), "paper_id")
    # a forum's memos are one group: bounded by the forum
    return R.pack_with_reset(m.select("paper_id", "job_id", "size"), "paper_id", ["job_id"], "size", 3, 2000)


@query(None)
def w13_w14_least_loaded(spark, d):
    g = base.memos(spark, d).groupBy("stage", "model").agg(F.sum(F.length("memo")).cast("double").alias("chars")).select(F.concat_ws("/", "stage", F.lower("model")).alias("kind"), "chars")
    return R.least_loaded(g.groupBy("kind").agg(F.sum("chars").alias("chars")), "kind", "chars", 4)


@query(f"WITH {NOTES}, {MEMOS}, r AS (SELECT job_id, unnest(regexp_extract_all(coalesce(memo,''), '[A-Z]-[a-z]+:L\\d+(?:-L\\d+)?')) ref FROM memo), b AS (SELECT job_id, split_part(ref, ':', 1) src, CAST(regexp_extract(ref, ':L(\\d+)', 1) AS INT) lo, coalesce(CAST(nullif(regexp_extract(ref, '-L(\\d+)$', 1), '') AS INT), CAST(regexp_extract(ref, ':L(\\d+)', 1) AS INT)) hi FROM r) SELECT job_id, src, CAST(sum(greatest(lo, hi) - lo + 1) AS BIGINT) n FROM b GROUP BY ALL")
def f_reference_ranges(spark, d):
    m = base.memos(spark, d).select("job_id", F.explode(T.line_references(F.col("memo"))).alias("line"))
    return m.groupBy("job_id", F.substring_index("line", ":", 1).alias("src")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {MEMOS}, h AS (SELECT job_id, string_split(memo, chr(10)) l FROM memo WHERE memo IS NOT NULL), x AS (SELECT job_id, unnest(l) line, generate_subscripts(l, 1) i FROM h), s AS (SELECT *, count(*) FILTER (regexp_matches(line, '^#+ ')) OVER (PARTITION BY job_id ORDER BY i) sec FROM x) SELECT job_id, sec, max(CASE WHEN regexp_matches(line, '^#+ ') THEN regexp_replace(line, '^#+ ', '') END) heading, count(*) AS lines FROM s GROUP BY ALL")
def a14_sections(spark, d):
    head = F.col("line").rlike("^#+ ")
    x = base.memos(spark, d).where("memo IS NOT NULL").select("job_id", F.posexplode(F.split("memo", "\n")).alias("i", "line"))
    s = x.withColumn("sec", F.sum(head.cast("long")).over(Window.partitionBy("job_id").orderBy("i")))
    return s.groupBy("job_id", "sec").agg(F.max(F.when(head, F.regexp_replace("line", "^#+ ", ""))).alias("heading"), F.count(F.lit(1)).alias("lines"))


QUERIES = Q
