"""Full hierarchies from parent-child rows, by tree contraction.

A round rakes the leaves and splices out an independent set of nodes with one child (unary chains: of neighbours only
the one of the greatest rank by hash goes, so a third of a chain leaves at a time). What leaves is recorded with its
parent of that moment, the number of links between them and, where paths are asked for, the nodes spliced out between
them and the weight of what hung there. Rounds grow with the logarithm of the node count and the tables shrink from
round to round. In the end only circles are left: nodes that are their own parents.

The records are then undone in reverse: each node takes root, depth, state and path from its parent and adds its own;
descendants of a raked node are the weight it had, those of a spliced one its weight and what its child has. A record
whose parent answers the paper needs no look-up, its root is known when it leaves.

There is one way at every size. Nodes need no group that fits into a task: every step is an equi-join or aggregation on
a node id, and both sides of the joins of a round hold an id once, so that a note with very many answers skews nothing
but the first look-up of parents and the undoing, which adaptive execution splits.

Defined results: rows without a note_id are left out. Repeated rows of a node count once, the one with the
latest mdate (ties: the largest row). A node that names itself is a circle of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delibera.runtime import cut, cut_counted

#: White space and invisible characters that may pad an id.
BLANK = r"[\s   -‏ -  ⁠　﻿]"


def bare(text: Column) -> Column:
    """``text`` without padding; null where nothing is left."""
    return F.nullif(F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", ""), F.lit(""))


def named(replyto: Column) -> Column:
    """The id a reply link ends in: ``x``, ``?id=f&noteId=x`` and ``https://h/forum?id=x`` all name x."""
    return F.nullif(F.regexp_extract(bare(replyto), r"([^=&?#/\s]*)$", 1), F.lit(""))


def current(messages: DataFrame, *columns: str) -> DataFrame:
    """One row for each note_id, that with the latest mdate (ties: by a hash of the row); partly aggregated before the shuffle."""
    last = F.struct(F.coalesce(F.col("mdate"), F.lit(-1)), F.xxhash64(*columns))
    row = F.struct(*[F.col(c) for c in columns])
    return (
        messages.where(F.col("note_id").isNotNull())
        .groupBy("note_id")
        .agg(F.max_by(row, last).alias("_row"))
        .select("note_id", *[F.col(f"_row.{c}").alias(c) for c in columns])
    )


def linked(notes: DataFrame) -> DataFrame:
    """(node, parent, start, top) of notes with forum_id and replyto.

    ``start`` is ``ok`` or ``orphan`` where parent is null. ``top`` is ``ok`` where the parent answers the paper.
    """
    n = notes.select(
        F.col("note_id").alias("node"),
        F.col("forum_id").alias("_forum"),
        F.when(named("replyto") != F.coalesce(F.col("forum_id"), F.lit("")), named("replyto")).alias("_to"),
    )
    there = n.select(F.col("node").alias("_to"), F.col("_forum").alias("_in"), F.col("_to").isNull().alias("_first"))
    valid = F.col("_in").eqNullSafe(F.col("_forum")) & F.col("_in").isNotNull()
    none = F.lit(None).cast("string")
    asks = n.where(F.col("_to").isNotNull()).join(there, "_to", "left")  # without the rest: nulls would all meet in one task
    return n.where(F.col("_to").isNull()).select("node", none.alias("parent"), F.lit("ok").alias("start"), none.alias("top")).unionByName(
        asks.select("node", F.when(valid, F.col("_to")).alias("parent"), F.when(~valid, F.lit("orphan")).alias("start"), F.when(valid & F.col("_first"), F.lit("ok")).alias("top"))
    )


#: A round: all rows that are alive, with their fate; a spliced node tells its only child of its own parent. The parts in
#: braces are those that paths and sizes need besides. The seed is a text, as a number would make each round compile anew.
_ROUND = """
WITH kids AS (
  SELECT parent AS node, count_if(fate = 'stay') AS n, min(CASE WHEN fate = 'stay' THEN node END) AS kid {kids}
  FROM {table} WHERE node <> parent AND fate <> 'splice' GROUP BY parent
), alive AS (
  SELECT t.node, t.parent, t.top, t.links, t.low, k.kid, {alive}
    CASE WHEN t.node = t.parent THEN 'stay' WHEN coalesce(k.n, 0) = 0 THEN 'rake'
      WHEN k.n = 1 AND xxhash64('{seed}', t.node) > xxhash64('{seed}', t.parent) AND xxhash64('{seed}', t.node) > xxhash64('{seed}', k.kid) THEN 'splice'
      ELSE 'stay' END AS fate
  FROM {table} t LEFT JOIN kids k ON t.node = k.node WHERE t.fate = 'stay'
), over AS (SELECT * FROM alive WHERE fate = 'splice')
SELECT a.node, coalesce(o.parent, a.parent) AS parent, CASE WHEN o.node IS NULL THEN a.top ELSE o.top END AS top,
  a.links + coalesce(o.links, 0) AS links, CASE WHEN o.node IS NULL THEN a.low ELSE least(a.low, o.low, o.node) END AS low, a.kid {told}, a.fate
FROM alive a LEFT JOIN over o ON o.kid = a.node
"""
_PLAIN = {"kids": "", "alive": "", "told": ""}
#: weight: of a node with all that was raked into it; above: of what was spliced out on the link above it; below: the same on the link to its only child
_WHOLE = {
    "kids": ", sum(CASE WHEN fate = 'rake' THEN weight + above END) AS raked, max(CASE WHEN fate = 'stay' THEN above END) AS below",
    "alive": "t.weight + coalesce(k.raked, 0) AS weight, t.above, coalesce(k.below, 0) AS below, t.via,",
    "told": ", a.weight, a.above + coalesce(o.above + o.weight, 0) AS above, a.below, CASE WHEN o.node IS NULL THEN a.via ELSE concat(o.via, array(o.node), a.via) END AS via",
}


class Contraction:
    """The records of a contraction: ``ends``, what left in each round, and the circles left at the end."""

    def __init__(self, links: DataFrame, whole: bool):
        self.whole, self.spark, self.topped = whole, links.sparkSession, "top" in links.columns
        if not self.topped:
            links = links.withColumn("top", F.lit(None).cast("string"))
        links, seen = cut_counted(links, "links", left=F.col("parent").isNotNull())
        self.ends = links.where("parent IS NULL").select("node", "start")
        extra = "1L AS weight, 0L AS above, 0L AS below, CAST(array() AS array<string>) AS via," if whole else ""
        table = self._sql(f"SELECT node, parent, top, 1L AS links, CAST(NULL AS string) AS low, CAST(NULL AS string) AS kid, {extra} 'stay' AS fate FROM {{t}} WHERE parent IS NOT NULL", t=links)
        self.rounds: list[DataFrame] = []
        while seen["left"]:
            text = _ROUND.format(table="{t}", seed=len(self.rounds), **(_WHOLE if whole else _PLAIN))
            table, seen = cut_counted(self._sql(text, t=table), "round", left=(F.col("fate") == "stay") & (F.col("node") != F.col("parent")))
            self.rounds.append(table)
        self.circles = table.where("fate = 'stay'")

    def _sql(self, text: str, **tables: DataFrame) -> DataFrame:
        return self.spark.sql(text, **tables)

    def places(self) -> DataFrame:
        """(node, root, depth, state[, path]) of every node: the rounds undone, the last first."""
        path = lambda c: f", {c} AS path" if self.whole else ""
        ends = self._sql(f"SELECT node, node AS root, 0L AS depth, start AS state {path('array(node)')} FROM {{t}}", t=self.ends)
        circles = self._sql(f"SELECT node, least(node, low) AS root, -1L AS depth, 'cycle' AS state {path('CAST(NULL AS array<string>)')} FROM {{t}}", t=self.circles)
        # with ``top`` only orphans are looked up of the ends: what is below the others is known by it
        fixed, undone = (ends.where("state = 'orphan'") if self.topped else ends).unionByName(circles), None
        text = f"""
SELECT node, parent AS root, links AS depth, top AS state {path("concat(array(parent), via, array(node))")} FROM {{t}} WHERE fate <> 'stay' AND top IS NOT NULL
UNION ALL
SELECT t.node, k.root, CASE WHEN k.state = 'cycle' THEN -1L ELSE k.depth + t.links END, k.state {path("concat(k.path, t.via, array(t.node))")}
FROM {{t}} t JOIN {{known}} k ON t.parent = k.node WHERE t.fate <> 'stay' AND t.top IS NULL"""
        for k in range(len(self.rounds) - 1, 0, -1):
            piece = self._sql(text, t=self.rounds[k], known=fixed if undone is None else fixed.unionByName(undone))
            undone = cut(piece, "undone", undone)
        done = ends.unionByName(circles) if undone is None else ends.unionByName(circles).unionByName(undone)
        if not self.rounds:
            return done
        return done.unionByName(self._sql(text, t=self.rounds[0], known=fixed if undone is None else fixed.unionByName(undone)))

    def sizes(self) -> DataFrame:
        """(node, notes_below) of every node; without meaning on and below circles."""
        known = roots = None
        for k in range(len(self.rounds) - 1, -1, -1):
            gone = self.rounds[k]
            raked = gone.where("fate = 'rake'").selectExpr("node", "weight AS size")
            landed = gone.where("fate = 'rake'").selectExpr("parent AS node", "weight + above AS w")
            roots = landed if roots is None else roots.unionByName(landed)
            known = raked if known is None else known.unionByName(raked)
            spliced = self._sql("SELECT t.node, t.weight + t.below + k.size AS size FROM {t} t JOIN {known} k ON t.kid = k.node WHERE t.fate = 'splice'", t=gone, known=known)
            known = known.unionByName(cut(spliced, "sizes") if k else spliced)
        if known is None:
            return self.ends.selectExpr("node", "0L AS notes_below")
        ends = self._sql("SELECT e.node, coalesce(sum(r.w), 0L) AS notes_below FROM {e} e LEFT JOIN (SELECT node, sum(w) AS w FROM {r} GROUP BY node) r ON e.node = r.node GROUP BY e.node", e=self.ends, r=roots)
        return known.selectExpr("node", "size - 1 AS notes_below").unionByName(ends)


def resolve(links: DataFrame) -> DataFrame:
    """(node, root, depth, state) of every row of ``linked``, with or without ``top``; state is ok, orphan or cycle."""
    return Contraction(links, whole=False).places()


def found_places(messages: DataFrame) -> DataFrame:
    """Root, depth and link state of every note."""
    r = resolve(linked(current(messages, "forum_id", "replyto")))
    return r.select(
        F.col("node").alias("note_id"),
        F.col("root").alias("root_id"),
        F.col("depth").cast("int").alias("node_depth"),
        F.col("state").alias("link_state"),
    )


def described(messages: DataFrame) -> DataFrame:
    """For each note its path from the root (ids joined by ``/``), depth, root, state and number of notes below it.

    A note on or below a circle has no path and no count of notes below. Paths take as much room as the depths of all
    notes add up to, as their text does.
    """
    done = Contraction(linked(current(messages, "forum_id", "replyto")), whole=True)
    off = F.col("state") == "cycle"
    return (
        done.places()
        .join(done.sizes(), "node", "left")
        .select(
            F.col("node").alias("note_id"),
            F.col("root").alias("root_id"),
            F.col("depth").cast("int").alias("node_depth"),
            F.col("state").alias("link_state"),
            F.when(~off, F.array_join("path", "/")).alias("path"),
            F.when(~off, F.col("notes_below")).alias("notes_below"),
        )
    )


def pairs_below(messages: DataFrame) -> DataFrame:
    """(root side) note_id, (leaf side) below_id and the links between them, for every note and each note below it.

    Read off the paths; the rows are as many as the depths of all notes add up to, which is the size of the asked-for result.
    """
    places = Contraction(linked(current(messages, "forum_id", "replyto")), whole=True).places().where("state != 'cycle' AND depth > 0")
    above = places.select(F.col("node").alias("below_id"), "depth", F.posexplode("path").alias("_at", "note_id"))
    return above.where(F.col("_at") < F.col("depth")).select("note_id", "below_id", (F.col("depth") - F.col("_at")).cast("int").alias("links"))
