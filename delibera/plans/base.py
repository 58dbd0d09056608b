"""The tables as the queries use them: repeated rows once, the current row of each note and forum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delibera.functions import text as T
from delibera.runtime import read


def units(spark, d, *columns: str) -> DataFrame:
    """Distinct units. With ``columns`` only those besides the key are read."""
    df = read(spark, d, "units")
    return (df.select("unit_pk", *columns) if columns else df).dropDuplicates(["unit_pk"])


def notes(spark, d, *columns: str, **derived: Column) -> DataFrame:
    """(note_id, columns, derived) of the current row of each note: that with the latest mdate, of ties the greatest of what is asked for.

    Only the columns asked for are read. What is derived from a text is worked out before the shuffle, so that the text stays behind.
    """
    rest = [c for c in columns if c != "note_id"]
    asked = [*[F.col(c) for c in rest], *[c.alias(n) for n, c in derived.items()]]
    df = read(spark, d, "messages")
    if not asked:
        return df.select("note_id").distinct()
    g = df.select("note_id", F.struct(F.coalesce("mdate", F.lit(-1)).alias("_at"), *asked).alias("_r")).groupBy("note_id").agg(F.max("_r").alias("_r"))
    return g.select("note_id", *[F.col(f"_r.{c}").alias(c) for c in (*rest, *derived)])


def forums(spark, d) -> DataFrame:
    """(year, forum_id), each once."""
    return read(spark, d, "forums").select("year", "forum_id").distinct()


def memos(spark, d) -> DataFrame:
    return read(spark, d, "memos").dropDuplicates()


def calls(spark, d) -> DataFrame:
    return read(spark, d, "api_calls").dropDuplicates()


def decisions(spark, d) -> DataFrame:
    """(forum_id, decision, withdrawn): the last decision of each forum by date (ties: the greater note_id)."""
    n = notes(spark, d, "forum_id", "kind", "cdate", _d=T.section(F.col("content_text"), "decision")).where(F.col("kind").isin("decision", "withdrawal"))
    return n.groupBy("forum_id").agg(
        F.max(F.when(F.col("kind") == "decision", F.struct(F.coalesce("cdate", F.lit(-1)).alias("c"), F.col("note_id").alias("n"), F.col("_d").alias("d"))))["d"].alias("decision"),
        F.coalesce(F.max(F.col("kind") == "withdrawal"), F.lit(False)).alias("withdrawn"),
    )


def ratings(spark, d) -> DataFrame:
    """(year, forum_id, note_id, rating) of reviews with a rating or recommendation that starts with a number."""
    x = F.coalesce(T.leading_int(T.section(F.col("content_text"), "rating")), T.leading_int(T.section(F.col("content_text"), "recommendation")))
    n = notes(spark, d, "year", "forum_id", "kind", rating=x)
    return n.where("kind = 'official_review' AND rating IS NOT NULL").select("year", "forum_id", "note_id", "rating")
