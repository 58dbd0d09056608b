"""Queries over nested records, drifting schemas and reply trees."""

from __future__ import annotations

from delibera.operators import drift, hierarchy, nested
from delibera.plans.corpus import LINK
from delibera.runtime import read


def p1_found(spark, d):
    return nested.found_links(read(spark, d, "forums"), read(spark, d, "messages"))


def p1_submission_tables(spark, d):
    return nested.flat_tables(read(spark, d, "forums"), "submission_json")


def p1_reply_tables(spark, d):
    return nested.flat_tables(read(spark, d, "forums"), "replies_json")


def p1_typed_replies(spark, d):
    """The replies themselves as a typed table: one of the related tables that p1_reply_tables holds in long form."""
    return nested.typed_table(nested.flat_tables(read(spark, d, "forums"), "replies_json"), "[]")


def p1_invitation_tables(spark, d):
    return nested.flat_tables(read(spark, d, "messages"), "invitations_json", ("forum_id", "note_id"))


def p3_found(spark, d):
    return drift.found_changes(read(spark, d, "forums"), read(spark, d, "messages"))


def p3_submissions(spark, d):
    source = drift.sources(read(spark, d, "forums"), read(spark, d, "messages"))[0]
    return drift.unified(spark, *source)


def p3_notes(spark, d):
    from pyspark.sql import functions as F

    notes = read(spark, d, "messages").select("year", "kind", F.col("note_id").alias("id"), F.col("content_json").alias("doc"))
    return drift.unified(spark, notes, "messages.content_json", None)


def p4_found(spark, d):
    return hierarchy.found_places(read(spark, d, "messages"))


def p4_described(spark, d):
    return hierarchy.described(read(spark, d, "messages"))


def p4_below(spark, d):
    return hierarchy.pairs_below(read(spark, d, "messages"))


QUERIES = {f.__name__: f for f in (p1_found, p1_submission_tables, p1_reply_tables, p1_typed_replies, p1_invitation_tables, p3_found, p3_submissions, p3_notes, p4_found, p4_described, p4_below)}
_UP = f"""WITH RECURSIVE {LINK}, w(note_id, at_id, d) AS (SELECT note_id, note_id, 0 FROM ok UNION ALL SELECT w.note_id, ok.pid, w.d + 1 FROM w JOIN ok ON ok.note_id = w.at_id WHERE ok.pid IS NOT NULL AND w.d < 400),
 e AS (SELECT w.note_id, w.at_id root_id, w.d node_depth, CASE WHEN ok.parent IS NULL THEN 'ok' ELSE 'orphan' END link_state FROM w JOIN ok ON ok.note_id = w.at_id WHERE ok.pid IS NULL),
 a AS (SELECT note_id, root_id, CAST(node_depth AS INT) node_depth, link_state FROM e UNION ALL SELECT note_id, min(at_id), -1, 'cycle' FROM w WHERE d >= 200 AND note_id NOT IN (SELECT note_id FROM e) GROUP BY 1)"""
#: Walks up from every note. Circles are walked 400 links: what is met after the 200th lies on the circle.
SQL: dict[str, str] = {
    "p4_found": f"{_UP} SELECT * FROM a",
    "p4_described": f"""{_UP}, up AS (SELECT w.* FROM w JOIN e USING (note_id)), p AS (SELECT note_id, string_agg(at_id, '/' ORDER BY d DESC) path FROM up GROUP BY 1), b AS (SELECT at_id note_id, count(*) - 1 notes_below FROM up GROUP BY 1)
 SELECT a.*, path, notes_below FROM a LEFT JOIN p USING (note_id) LEFT JOIN b USING (note_id)""",
    "p4_below": f"{_UP} SELECT at_id note_id, note_id below_id, CAST(d AS INT) links FROM w WHERE d > 0 AND note_id IN (SELECT note_id FROM e)",
}
