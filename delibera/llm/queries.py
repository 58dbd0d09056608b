"""Queries of the text operators."""

from __future__ import annotations

from delibera.llm import clusters, conversations, leakage, packing, reading, truncation
from delibera.plans.corpus import LINK
from delibera.runtime import read


def p2_found(spark, d):
    return conversations.conversations(read(spark, d, "messages")).drop("speaker")


def p2_transcripts(spark, d):
    return conversations.conversations(read(spark, d, "messages"))


def p2_likely_transcripts(spark, d):
    return conversations.conversations(read(spark, d, "messages"), likely=True)


def p2_likely_parents(spark, d):
    return conversations.likely_parents(read(spark, d, "messages"))


def _memos(spark, d):
    return read(spark, d, "memos"), read(spark, d, "api_calls"), read(spark, d, "jobs")


def p5_found(spark, d):
    return truncation.found_cuts(*_memos(spark, d))


def p5_rates(spark, d):
    return truncation.cut_rates(*_memos(spark, d))


def p6_found(spark, d):
    return clusters.found_matters(read(spark, d, "units"), read(spark, d, "clusters_inspected_object"))


def p6_clusters(spark, d):
    return clusters.described_clusters(read(spark, d, "units"))


def p7_containers(spark, d):
    return packing.containers(read(spark, d, "documents"))


def p7_report(spark, d):
    return packing.container_report(read(spark, d, "documents"))


def p8_found(spark, d):
    return leakage.found_leaks(read(spark, d, "documents"), read(spark, d, "test_items"))


def p8_removal(spark, d):
    return leakage.removal_spans(read(spark, d, "documents"), read(spark, d, "test_items"))


def p9_found(spark, d):
    return reading.found_easy(read(spark, d, "documents"), read(spark, d, "level_labels"))


def p9_levels(spark, d):
    return reading.levels(read(spark, d, "documents"), read(spark, d, "level_labels"))


def p9_profile(spark, d):
    return reading.level_profile(read(spark, d, "documents"), read(spark, d, "level_labels"))


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_transcripts, p2_likely_transcripts, p2_likely_parents, p5_found, p5_rates, p6_found, p6_clusters, p7_containers, p7_report, p8_found, p8_removal, p9_found, p9_levels, p9_profile)
}


def _ms(c: str) -> str:
    return f"nullif(CASE WHEN abs({c}) < 100000000000 THEN {c} * 1000 WHEN abs({c}) < 100000000000000 THEN {c} WHEN abs({c}) < 100000000000000000 THEN {c} // 1000 ELSE {c} // 1000000 END, 0)"


_WORDS = "trim(regexp_replace(lower(coalesce(role,'')), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' ')"
SQL: dict[str, str] = {
    "p2_found": f"""WITH RECURSIVE {LINK}, s AS (SELECT note_id, coalesce({_ms('cdate')}, {_ms('mdate')}) at_ms, regexp_replace(coalesce(content_text,''), '[\\s\\x{{00a0}}\\x{{200b}}-\\x{{200f}}\\x{{2060}}\\x{{feff}}\\x{{3000}}]+', '', 'g') <> '' says, {_WORDS} r1, regexp_replace({_WORDS}, 's$', '') r2 FROM m),
 k AS (SELECT note_id, at_ms, says, CASE WHEN r1 IN ('','unknown','n a','na','none','null') OR r2 IN ('','unknown','n a','na','none','null') THEN NULL WHEN r2 = 'ac' THEN 'area chair' WHEN r2 = 'pc' THEN 'program chair' ELSE r2 END who FROM s),
 w(root, note_id, d) AS (SELECT note_id, note_id, 0 FROM ok WHERE parent IS NULL UNION ALL SELECT w.root, ok.note_id, w.d + 1 FROM w JOIN ok ON ok.pid = w.note_id),
 x AS (SELECT w.root, w.note_id, w.d, k.at_ms, k.says, k.who, coalesce(k.at_ms < pk.at_ms, false) early FROM w JOIN k ON k.note_id = w.note_id JOIN ok ON ok.note_id = w.note_id LEFT JOIN k pk ON pk.note_id = ok.pid),
 g AS (SELECT root FROM x GROUP BY 1 HAVING NOT bool_or(at_ms IS NULL OR early OR (says AND who IS NULL)) AND bool_or(note_id = root AND says) AND count(*) FILTER (says) >= 2 AND count(DISTINCT who) FILTER (says) >= 2)
 SELECT root conv_id, CAST(row_number() OVER (PARTITION BY root ORDER BY at_ms, d, note_id) AS INT) turn, note_id FROM x WHERE says AND root IN (SELECT root FROM g)""",
}
