"""Queries of rendering, sections, rebuilt partitions, archives, cursors and job states."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from delibera.functions import text as T
from delibera.functions.sql import CALLS, MEMOS, NOTES, instant
from delibera.plans import base
from delibera.runtime import read

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


@query(f"""WITH {NOTES}, q AS (SELECT note_id, string_split(chr(10) || chr(10) || content_text, chr(10) || chr(10) || '[') ps FROM m WHERE content_text IS NOT NULL), p AS (SELECT note_id, unnest(ps) part, generate_subscripts(ps, 1) - 1 AS k FROM q)
 SELECT note_id, CAST(k AS INT) place, split_part(part, ']' || chr(10), 1) section, CASE WHEN contains(part, ']' || chr(10)) THEN regexp_replace(substr(part, strpos(part, ']' || chr(10)) + 2), '\\d+', '#', 'g') ELSE '' END body FROM p WHERE k > 0""")
def a15_sections(spark, d):
    """The sections ``[name]`` of every note's text, in order, with the numbers in their bodies masked."""
    parts = F.slice(F.split(F.concat(F.lit("\n\n"), "content_text"), "\n\n\\["), 2, 1_000_000_000)
    n = base.notes(spark, d, "content_text").where("content_text IS NOT NULL").select("note_id", F.posexplode(parts).alias("i", "part"))
    at = F.instr("part", "]\n")
    body = F.when(at > 0, F.regexp_replace(F.substring(F.col("part"), at + 2, F.length("part")), r"\d+", "#")).otherwise("")
    return n.select("note_id", (F.col("i") + 1).cast("int").alias("place"), F.substring_index("part", "]\n", 1).alias("section"), body.alias("body"))


_BOX = "CASE WHEN json_type(x) = 'OBJECT' THEN json_extract(x, '$.value') ELSE x END"


@query(f"""WITH {NOTES}, j AS (SELECT note_id, content_json::JSON c, json_keys(content_json) ks FROM m WHERE json_valid(content_json) AND json_type(content_json) = 'OBJECT'), e AS (SELECT note_id, c, unnest(ks) key, generate_subscripts(ks, 1) i FROM j),
 v AS (SELECT note_id, key, i, {_BOX} x FROM (SELECT note_id, key, i, json_extract(c, '$."' || key || '"') x FROM e)),
 t AS (SELECT note_id, key, i, CASE json_type(x) WHEN 'VARCHAR' THEN trim(x->>'$', E' \\n\\t\\r') WHEN 'BOOLEAN' THEN CASE WHEN x::VARCHAR = 'true' THEN 'True' ELSE 'False' END WHEN 'ARRAY' THEN array_to_string(list_filter(list_transform(CAST(x AS VARCHAR[]), lambda y: trim(y, E' \\n\\t\\r')), lambda y: y <> ''), chr(10)) WHEN 'NULL' THEN NULL WHEN 'OBJECT' THEN NULL ELSE x::VARCHAR END s FROM v)
 SELECT note_id, count(*) sections, string_agg('[' || key || ']' || chr(10) || s, chr(10) || chr(10) ORDER BY i) rendered FROM t WHERE s <> '' GROUP BY 1""")
def f4_rendered(spark, d):
    """Each note's content map as sectioned text: ``[name]`` and the value below it, lists as lines, in the order of the map; what holds no text has no section."""
    strip = lambda c: F.regexp_replace(c, r"^[ \n\t\r]+|[ \n\t\r]+$", "")
    whole = F.try_parse_json("content_json")
    n = base.notes(spark, d, "content_json").where(whole.isNotNull() & F.schema_of_variant(whole).startswith("OBJECT"))
    e = n.select("note_id", F.from_json(F.to_json(whole), "map<string,variant>").alias("v"), F.posexplode(F.map_keys(F.from_json("content_json", "map<string,string>"))).alias("i", "key"))
    raw = F.element_at("v", F.col("key"))
    x = F.when(F.schema_of_variant(raw).startswith("OBJECT"), F.try_variant_get(raw, "$.value", "variant")).otherwise(raw)
    lines = F.array_join(F.filter(F.transform(F.try_variant_get("x", "$", "array<string>"), strip), lambda y: y != ""), "\n")
    kind = F.schema_of_variant("x")
    text = F.when(kind.startswith("ARRAY"), lines).when(kind.startswith("OBJECT") | (kind == "VOID"), None).when(kind == "BOOLEAN", F.initcap(F.try_variant_get("x", "$", "string"))).otherwise(strip(F.try_variant_get("x", "$", "string")))
    t = e.select("note_id", "i", "key", x.alias("x")).select("note_id", "i", F.concat(F.lit("["), "key", F.lit("]\n")).alias("head"), text.alias("s")).where("s <> ''")
    parts = F.sort_array(F.collect_list(F.struct("i", F.concat("head", "s").alias("t"))))
    return t.groupBy("note_id").agg(F.count(F.lit(1)).alias("sections"), F.array_join(parts["t"], "\n\n").alias("rendered"))


_LAST = ", ".join(f"last_value(CASE WHEN level = {k} THEN title END IGNORE NULLS) OVER w t{k}, coalesce(last_value(CASE WHEN level = {k} THEN i END IGNORE NULLS) OVER w, 0) i{k}" for k in range(1, 6))
_PATH = " || ".join(f"CASE WHEN level > {k} AND i{k} > greatest({', '.join(['0', *[f'i{m}' for m in range(1, k)]])}) THEN t{k} || ' > ' ELSE '' END" for k in range(1, 6))


@query(f"""WITH {MEMOS}, l AS (SELECT DISTINCT job_id, md5(memo) k, memo FROM memo WHERE memo IS NOT NULL), x AS (SELECT job_id, k, unnest(string_split(memo, chr(10))) line, generate_subscripts(string_split(memo, chr(10)), 1) i FROM l),
 h AS (SELECT job_id, k, i, length(regexp_extract(line, '^(#+) ', 1)) level, trim(regexp_replace(line, '^#+ ', '')) title FROM x WHERE regexp_matches(line, '^#{{1,6}} ')),
 a AS (SELECT *, {_LAST} FROM h WINDOW w AS (PARTITION BY job_id, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT job_id, CAST(i AS INT) line, CAST(level AS INT) level, {_PATH} || title AS path FROM a""")
def a14_heading_paths(spark, d):
    """Every Markdown heading of the memos with the headings it stands under: those of lower level that none of a lower one came after."""
    m = base.memos(spark, d).where("memo IS NOT NULL").select("job_id", "memo").distinct()
    x = m.select("job_id", F.md5("memo").alias("k"), F.posexplode(F.split("memo", "\n")).alias("i", "line")).where(F.col("line").rlike("^#{1,6} "))
    h = x.select("job_id", "k", (F.col("i") + 1).alias("i"), F.length(F.regexp_extract("line", "^(#+) ", 1)).alias("level"), F.trim(F.regexp_replace("line", "^#+ ", "")).alias("title"))
    w = Window.partitionBy("job_id", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    of = lambda k, c: F.last(F.when(F.col("level") == k, F.col(c)), ignorenulls=True).over(w)
    a = h.select("*", *[of(k, "title").alias(f"t{k}") for k in range(1, 6)], *[F.coalesce(of(k, "i"), F.lit(0)).alias(f"i{k}") for k in range(1, 6)])
    under = [F.when((F.col("level") > k) & (F.col(f"i{k}") > F.greatest(F.lit(0), F.lit(0), *[F.col(f"i{m}") for m in range(1, k)])), F.concat(F.col(f"t{k}"), F.lit(" > "))).otherwise("") for k in range(1, 6)]
    return a.select("job_id", F.col("i").alias("line"), "level", F.concat(*under, F.col("title")).alias("path"))


S = f"coalesce({instant('started_at')}, -1)"
ORDERED = f"{CALLS}, o AS (SELECT job_id, status, coalesce(reserved_microusd, 0) r, actual_microusd a, row_number() OVER (PARTITION BY job_id ORDER BY {S}, status, coalesce(completion_tokens, -1), coalesce(actual_microusd, -1)) i, count(*) OVER (PARTITION BY job_id) n FROM c)"


def ordered_calls(spark, d):
    """The calls of each job in order: i from 1 to n. A job's tries are few, whatever the number of jobs."""
    c = base.calls(spark, d).select("job_id", "status", F.coalesce("reserved_microusd", F.lit(0)).alias("r"), F.col("actual_microusd").alias("a"), F.coalesce(T.instant_of(F.col("started_at")), F.lit(-1)).alias("_at"), F.coalesce("completion_tokens", F.lit(-1)).alias("_c"))
    w = Window.partitionBy("job_id")
    return c.withColumn("i", F.row_number().over(w.orderBy("_at", "status", "_c", F.coalesce("a", F.lit(-1))))).withColumn("n", F.count(F.lit(1)).over(w)).drop("_at", "_c")


@query(f"WITH {ORDERED} SELECT job_id, CAST(i AS INT) attempt, status, r AS reserved FROM o WHERE i < n")
def k6_archive(spark, d):
    """What goes to the archive when a job's row is used again: all its tries but the last."""
    return ordered_calls(spark, d).where("i < n").select("job_id", F.col("i").alias("attempt"), "status", F.col("r").alias("reserved"))


@query(f"WITH {ORDERED}, t AS (SELECT status AS \"to\", coalesce(lag(status) OVER (PARTITION BY job_id ORDER BY i), 'new') AS \"from\" FROM o) SELECT \"from\", \"to\", count(*) n, \"from\" <> 'complete' AND (\"from\" <> 'new' OR \"to\" IN ('running', 'complete', 'failed')) AS allowed FROM t GROUP BY ALL")
def t4_transitions(spark, d):
    """How often a job went from each state to each, and whether it may: nothing follows a completed try."""
    before = F.coalesce(F.lag("status").over(Window.partitionBy("job_id").orderBy("i")), F.lit("new"))
    g = ordered_calls(spark, d).select(before.alias("from"), F.col("status").alias("to")).groupBy("from", "to").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("allowed", (F.col("from") != "complete") & ((F.col("from") != "new") | F.col("to").isin("running", "complete", "failed")))


@query(f"WITH {CALLS}, x AS (SELECT lower(trim(model)) model, coalesce(reserved_microusd, 0) r, CASE WHEN status = 'complete' THEN coalesce(actual_microusd, reserved_microusd, 0) WHEN status = 'running' THEN coalesce(reserved_microusd, 0) ELSE coalesce(actual_microusd, 0) END charged, status FROM c) SELECT model, CAST(sum(r) AS BIGINT) reserved, CAST(sum(charged) AS BIGINT) charged, CAST(sum(r - charged) AS BIGINT) released, count(*) FILTER (status = 'running') interrupted, count(*) FILTER (charged > r) over_reserve FROM x GROUP BY 1")
def t5_t6_reconciled(spark, d):
    """Per model what was reserved, charged and released: a finished call costs what it took, an interrupted one its whole reserve."""
    r = F.coalesce("reserved_microusd", F.lit(0))
    charged = F.when(F.col("status") == "complete", F.coalesce("actual_microusd", "reserved_microusd", F.lit(0))).when(F.col("status") == "running", r).otherwise(F.coalesce("actual_microusd", F.lit(0)))
    x = base.calls(spark, d).select(F.lower(F.trim("model")).alias("model"), r.alias("r"), charged.alias("charged"), "status")
    return x.groupBy("model").agg(F.sum("r").alias("reserved"), F.sum("charged").alias("charged"), F.sum(F.col("r") - F.col("charged")).alias("released"), F.count_if(F.col("status") == "running").alias("interrupted"), F.count_if(F.col("charged") > F.col("r")).alias("over_reserve"))


@query(f"WITH {NOTES}, s AS (SELECT forum_id, count(*) stored FROM m GROUP BY 1), f AS (SELECT year, forum_id, max(reply_count) declared FROM forums WHERE forum_id <> '' GROUP BY 1, 2) SELECT year, max(f.forum_id) AS cursor, count(*) forums, count(*) FILTER (coalesce(stored, 0) < coalesce(declared, 0)) unfinished, bool_and(coalesce(stored, 0) >= coalesce(declared, 0)) completed FROM f LEFT JOIN s USING (forum_id) GROUP BY 1")
def t1_t3_cursors(spark, d):
    """Where collecting a year goes on: the last forum taken, how many still lack replies, and whether the year is complete."""
    stored = base.notes(spark, d, "forum_id").groupBy("forum_id").agg(F.count(F.lit(1)).alias("stored"))
    f = read(spark, d, "forums").where("forum_id <> ''").groupBy("year", "forum_id").agg(F.max("reply_count").alias("declared")).join(stored, "forum_id", "left")
    lacks = F.coalesce("stored", F.lit(0)) < F.coalesce("declared", F.lit(0))
    return f.groupBy("year").agg(F.max("forum_id").alias("cursor"), F.count(F.lit(1)).alias("forums"), F.count_if(lacks).alias("unfinished"), (~F.max(lacks)).alias("completed"))


@query(f"WITH {NOTES}, old AS (SELECT year, kind, count(*) n FROM messages GROUP BY ALL), new AS (SELECT year, kind, count(*) n FROM m WHERE year = (SELECT max(year) FROM m) GROUP BY ALL) SELECT * FROM old WHERE year NOT IN (SELECT year FROM new) UNION ALL SELECT * FROM new")
def k5_rebuilt_year(spark, d):
    """A table by year whose last year is rebuilt from deduplicated notes: its old rows go, the other years stay."""
    old = read(spark, d, "messages").groupBy("year", "kind").agg(F.count(F.lit(1)).alias("n"))
    new = base.notes(spark, d, "year", "kind").groupBy("year", "kind").agg(F.count(F.lit(1)).alias("n"))
    last = new.select(F.max("year").alias("year"))
    new = new.join(last, "year", "left_semi")
    return old.where("year IS NOT NULL").join(new.select("year").distinct(), "year", "left_anti").unionByName(new)


QUERIES = Q
