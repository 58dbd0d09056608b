"""Texts cut off by field limits, by token limits or in transfer.

Length hazards: for the characters of each model's texts and for the tokens that the texts of each stage took, the
hazard of a length is the share of the texts at least that long that have exactly that length. Window functions give
each length its number at risk and the hazard of the lengths around it; an excess is tested with a Chernoff bound of
the Poisson tail, and the Benjamini-Hochberg rule over all lengths keeps false discoveries under ``fdr``.

What an ending is worth is fitted, not set. How a text ends if it is cut at a chance place is seen by cutting every
text at a place chosen by hash. How often each of four classes (whole, cut at a character limit, at a token limit, in
transfer) occurs, and how each shows in reasons, significant lengths and characters a token, is learned without labels
by expectation maximization over the counts of all texts; cuts of every class end as chance cuts do, a character cut
stands at a significant length. A text is cut if the classes of cuts are likelier together than whole; one that ends
with a sentence only if those of the limits are. Then definitions hold: a table row, a closed code fence, a quotation,
a reference and every closing line whose form (digits and names masked) so many texts share that it is a way of ending
are finished.

Defined results: null or blank texts and rows without a job aren't cases. Of several calls of a job the last
complete one counts; a null token count or reason is no evidence. Repeated rows count once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delibera.runtime import cut

#: The ways in which a call says that it ran out of tokens.
RAN_OUT = ["length", "max_tokens", "max_output_tokens", "incomplete", "token_limit"]


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s ​⁠﻿]+$", "")


def last_calls(calls: DataFrame) -> DataFrame:
    """(job_id, reason, tokens) of each job's last complete call; tokens are those of the text, without reasoning."""
    started = F.substring(F.regexp_replace(F.coalesce("started_at", F.lit("")), "T", " "), 1, 19)
    row = F.struct(
        (F.lower(F.trim("status")) == "complete").alias("whole"),
        started.alias("at"),
        F.lower(F.trim("finish_reason")).alias("reason"),
        (F.col("completion_tokens") - F.coalesce("reasoning_tokens", F.lit(0))).alias("tokens"),
    )
    return calls.where(F.col("job_id").isNotNull()).groupBy("job_id").agg(F.max(row).alias("_c")).select("job_id", F.col("_c.reason").alias("reason"), F.col("_c.tokens").alias("tokens"))


def last_line(text: Column) -> Column:
    return F.element_at(F.split(text, "\n"), -1)


def open_fences(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("```"), F.lit("")))) / 3


def endings(memos: DataFrame, calls: DataFrame, jobs: DataFrame) -> DataFrame:
    """One narrow row for each job with its length, tokens, the form of its last line, its shape, and that of a chance cut."""
    t = trimmed(F.col("memo"))
    last = last_line(t)
    form = F.regexp_replace(F.regexp_replace(F.regexp_replace(last, r"\d+", "9"), r"\b(\p{Lu})-\p{Ll}+", "$1-a"), r"(?<=[a-z,:;] )\p{Lu}\p{Ll}+", "N")
    part = trimmed(F.substring(t, F.lit(1), (F.pmod(F.xxhash64("job_id"), F.length(t)) + 1).cast("int")))
    shaped = memos.where(F.col("job_id").isNotNull() & (F.length(t) > 0)).select(
        "job_id",
        F.struct(
            F.coalesce(F.substring("created_at", 1, 10), F.lit("")).alias("made"),
            F.length("memo").alias("chars"),
            F.lower(F.trim(F.coalesce("model", F.lit("")))).alias("model"),
            F.coalesce("stage", F.lit("")).alias("stage"),
            F.xxhash64(form).alias("form"),
            last.rlike(r"^#{1,6}(\s|$)").alias("heads"),
            shape_of(last, open_fences(t)).alias("shape"),
            shape_of(last_line(part), open_fences(part)).alias("chance"),
        ).alias("m"),
    )
    once = shaped.groupBy("job_id").agg(F.max("m").alias("m")).select("job_id", "m.*")
    limits = jobs.where(F.col("job_id").isNotNull()).groupBy("job_id").agg(F.max("max_tokens").alias("max_tokens"))
    return once.join(last_calls(calls), "job_id", "left").join(limits, "job_id", "left")


def shape_of(last: Column, fences: Column) -> Column:
    """closed, sentence or open, from the last line alone."""
    number_end = last.rlike(r"\d\.$") & ~last.rlike(r"(?i)\b(section|table|appendix|figure|fig|page|line|round|chapter|eq|vol|step|part|point|no)\.? ?\d+\.$")
    return (
        F.when(fences % 2 == 1, "open")
        .when(last.rlike(r"^\s*```"), "closed")
        .when(last.rlike(r"^\s*#{1,6}(\s|$)"), "open")
        .when(last.rlike(r"^\s*\|.*\|$"), "closed")
        .when(last.rlike(r"^\s*\|"), "open")
        .when(last.rlike(r"(\.\.\.|…|[-–—])$"), "open")
        .when(last.rlike(r"[“\"«‘'][^“\"«‘]*[”\"»’']$"), "closed")
        .when(last.rlike(r":L(\d+)-L(\d+)$") & (F.length(F.regexp_extract(last, r":L(\d+)-L(\d+)$", 2)) < F.length(F.regexp_extract(last, r":L(\d+)-L(\d+)$", 1))), "open")
        .when(last.rlike(r":L\d+(-L\d+)?\)?$"), "closed")
        .when(last.rlike(r"^\([^()]*\)$"), "closed")
        .when(number_end, "number")
        .when(last.rlike(r"[.!?。？！](\*\*|[)\]_*”\"’'])?$"), "sentence")
        .otherwise("open")
    )


def hazards(lengths: DataFrame, near: int = 40, fdr: float = 0.01, excess: float = 3.0, least: int = 3) -> DataFrame:
    """Significant lengths of ``lengths`` (measure, stratum, length): those whose hazard stands out of that around them.

    The hazard around a length is the share that ended at the other lengths within ``near`` of all that were at risk
    there, length by length. The windows run over the histogram, whose rows are the lengths that occur, not the texts.
    """
    counts = lengths.where(F.col("length") > 0).groupBy("measure", "stratum", "length").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("measure", "stratum").orderBy(F.desc("length"))
    around = Window.partitionBy("measure", "stratum").orderBy("length").rangeBetween(-near, near)
    h = counts.withColumn("at_risk", F.sum("n").over(whole))
    # at risk between the first and the last length around: those of both ends, in the mean, at each of the lengths
    exposed = 2 * near * (F.max("at_risk").over(around) + F.min("at_risk").over(around)) / 2
    h = h.withColumn("near_hazard", (F.sum("n").over(around) - F.col("n")) / exposed).withColumn("hazard", F.col("n") / F.col("at_risk"))
    expected = F.greatest(F.col("near_hazard") * F.col("at_risk"), F.lit(0.02))
    p = F.exp(-(F.col("n") * F.log(F.col("n") / expected) - F.col("n") + expected))
    h = h.select("measure", "stratum", "length", "n", "hazard", (expected / F.col("at_risk")).alias("near_hazard"), F.when(F.col("n") > expected, p).otherwise(F.lit(1.0)).alias("p"))
    h = h.withColumn("_rank", F.row_number().over(Window.partitionBy("measure").orderBy("p", "stratum", "length"))).withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy("measure")))
    passed = F.max(F.when(F.col("p") <= F.col("_rank") / F.col("_m") * fdr, F.col("_rank"))).over(Window.partitionBy("measure"))
    h = h.withColumn("_last", passed)
    return h.where((F.col("_rank") <= F.coalesce("_last", F.lit(0))) & (F.col("n") >= least) & (F.col("hazard") >= excess * F.col("near_hazard"))).drop("_rank", "_m", "_last")


SHAPES = ["closed", "sentence", "number", "open"]
#: Levels of the features of a text, in the order of ``CELL``; the last level of tokens and of characters a token is "not known".
CELL = ["_shape", "_ran", "_tokens", "_chars", "_ratio"]
LEVELS, UNKNOWN = [4, 2, 3, 2, 17], [None, None, 2, None, 16]
WHOLE, BY_CHARS, IN_TRANSFER, BY_TOKENS = range(4)


def classes(cells: np.ndarray, n: np.ndarray, chance: np.ndarray, rounds: int = 200) -> np.ndarray:
    """The share of each class in each cell (a row of feature levels, ``n`` texts), by expectation maximization.

    ``chance``: how often each shape ends a text that is cut at a chance place.
    """
    total = max(1.0, n.sum())
    prior = np.array([0.88, 0.04, 0.04, 0.04])
    base = [np.bincount(cells[:, f], weights=n, minlength=k) / total for f, k in enumerate(LEVELS)]
    p = [np.tile((b * total + 1) / (total + k), (4, 1)) for b, k in zip(base, LEVELS)]
    p[0][1:] = (chance + 1) / (chance.sum() + len(SHAPES))
    p[0][WHOLE, 3] *= 0.02  # where the search begins: whole texts seldom end open
    p[1][BY_TOKENS], p[2][BY_TOKENS] = [0.1, 0.9], [0.02, 0.9, 0.08]
    limit = [1e-9, 1.0]
    share = np.zeros((len(n), 4))
    for _ in range(rounds):
        p[3][BY_CHARS] = limit
        log = np.log(prior) + sum(np.where((cells[:, f] == UNKNOWN[f])[:, None], 0.0, np.log(p[f][:, cells[:, f]]).T) for f in range(len(CELL)))
        share = np.exp(log - log.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        w = share * n[:, None]
        prior = (w.sum(0) + 0.01) / (total + 0.04)
        for f, k in enumerate(LEVELS):
            for c in range(4):
                if f or c == WHOLE:  # a cut of any class ends as one at a chance place
                    p[f][c] = (np.bincount(cells[:, f], weights=w[:, c], minlength=k) + base[f] + 1e-6) / (w[:, c].sum() + 1 + 1e-6 * k)
    return share


def judged(memos: DataFrame, calls: DataFrame, jobs: DataFrame, common: float = 0.002) -> DataFrame:
    """Every job's memo with ``cut`` and the evidence. ``common``: the share of texts that makes a last line a way of ending."""
    e = cut(endings(memos, calls, jobs), "endings")
    lengths = e.select(F.lit("chars").alias("measure"), F.col("model").alias("stratum"), F.col("chars").cast("long").alias("length")).unionByName(
        e.where(F.col("tokens").isNotNull()).select(F.lit("tokens"), F.col("stage"), F.col("tokens").cast("long")).toDF("measure", "stratum", "length")
    )
    peaks = cut(hazards(lengths), "peaks")
    chars = peaks.where("measure = 'chars'").select(F.col("stratum").alias("model"), F.col("length").alias("chars"), F.lit(True).alias("_at_chars"))
    tokens = peaks.where("measure = 'tokens'").select(F.col("stratum").alias("stage"), F.col("length").alias("tokens"), F.lit(True).alias("_at_tokens"))
    total = e.count()
    ways = e.groupBy("form").agg(F.count(F.lit(1)).alias("_f")).where(F.col("_f") >= max(3.0, common * total)).select("form", F.lit(True).alias("_way"))
    per = F.col("chars") / F.nullif(F.col("tokens"), F.lit(0))
    usual = e.groupBy("stage").agg(F.percentile_approx(per, 0.5, 1000).alias("_per"))
    j = e.join(chars, ["model", "chars"], "left").join(tokens, ["stage", "tokens"], "left").join(ways, "form", "left").join(usual, "stage", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    closed = (F.col("shape") == "closed") | (flag("_way") & ~F.col("heads"))
    at_limit = F.coalesce(F.col("tokens") >= F.col("max_tokens"), F.lit(False))
    levels = {
        "_shape": F.when(closed, 0).otherwise(F.array_position(F.array(*map(F.lit, SHAPES)), F.col("shape")) - 1),
        "_ran": F.coalesce(F.col("reason").isin(RAN_OUT), at_limit),  # a call at its limit that doesn't say why it ended ran out
        "_tokens": F.when(F.col("tokens").isNull(), 2).otherwise((flag("_at_tokens") | at_limit).cast("int")),
        "_chars": flag("_at_chars"),
        "_ratio": F.coalesce(F.greatest(F.lit(0), F.least(F.lit(15), F.floor(per / F.col("_per") * 10))), F.lit(16)),
    }
    j = cut(j.withColumns({c: x.cast("int") for c, x in levels.items()}), "evidence")
    found = j.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n")).collect()  # at most the product of LEVELS, 816 rows
    by_chance = {r["chance"]: r["n"] for r in e.groupBy("chance").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = classes(np.array([[r[c] for c in CELL] for r in found], dtype=int).reshape(-1, 5), np.array([float(r["n"]) for r in found]), np.array([float(by_chance.get(x, 0)) for x in SHAPES]))
    rows = [(*[r[c] for c in CELL], float(1 - w[WHOLE]), float(w[BY_CHARS] + w[BY_TOKENS])) for r, w in zip(found, share)]
    known = e.sparkSession.createDataFrame(rows, ", ".join(f"{c} int" for c in CELL) + ", p_cut double, p_limit double")
    j = j.join(F.broadcast(known), CELL)
    sure = F.when(F.col("_shape") == 1, F.col("p_limit")).otherwise(F.col("p_cut"))
    verdict = F.when((F.col("_shape") == 0) | (sure < 0.5), "whole").when(F.col("_shape") == 1, "between").otherwise("open")
    return j.select("job_id", "model", "stage", "chars", "tokens", "reason", flag("_at_chars").alias("at_char_limit"), flag("_at_tokens").alias("at_token_limit"), F.round(sure, 6).alias("sure"), verdict.alias("ending"), (verdict != "whole").alias("cut"))


def found_cuts(memos: DataFrame, calls: DataFrame, jobs: DataFrame) -> DataFrame:
    return judged(memos, calls, jobs).where("cut").select("job_id")


def cut_rates(memos: DataFrame, calls: DataFrame, jobs: DataFrame) -> DataFrame:
    """How often each model and stage cuts, and in which way."""
    return (
        judged(memos, calls, jobs)
        .groupBy("model", "stage")
        .agg(
            F.count(F.lit(1)).alias("memos"),
            F.count_if("cut").alias("cut"),
            F.count_if(F.col("ending") == "between").alias("cut_between_sentences"),
            F.count_if(F.col("cut") & F.col("at_char_limit")).alias("at_char_limit"),
            F.count_if(F.col("cut") & F.col("at_token_limit")).alias("at_token_limit"),
            (F.count_if("cut") / F.count(F.lit(1))).alias("share"),
        )
    )
