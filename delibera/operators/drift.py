"""Schemas that drift from year to year: profiles, matching of renamed fields, one unified table.

Every record is read once. A task adds up, for each (year, kind, field), how many records have the field,
the JSON types, and value sketches: counts over hashed words, hashed whole values and hashed forms, and the
moments of the text length. All of them add, so tasks send partial sums; what reaches the driver are the
sums of fields that at least ``share`` of a year's records have, of which there can be no more than
(fields of a record / share). Renames are the best bipartite matching between the fields that went and the
fields that came, on likeness of content, form, length and name.

Defined results: identical rows of a record count once; a record that isn't valid JSON has no fields but
counts as a record; a null year is left out of the report; an empty table gives an empty report.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delibera.operators.nested import _compact, parse, storable
from delibera.runtime import cut

WORDS, VALUES, FORMS = 512, 256, 64
PROFILE = "table_field string, kind string, year int, field string, what string, bin int, n double"
REPORT = "table_field string, kind string, year int, field string, change_type string, old_value string"
_BOX = {"value", "readers", "nonreaders", "writers", "signatures"}
_word = re.compile(r"\w+")
_mark = re.compile(r"[^\w\s]")


def unbox(value):
    """What is inside ``{"value": ...}``, however deep it is boxed."""
    while isinstance(value, dict) and "value" in value and value.keys() <= _BOX:
        value = value["value"]
    return value


def json_type(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return {str: "string", list: "array"}.get(type(value), "object")


def fields_of(text, inside: str | None) -> dict:
    value = parse(text)
    if inside is not None:
        value = unbox(value.get(inside)) if isinstance(value, dict) else None
        if isinstance(value, str):
            value = parse(value)
    return {k: u for k, v in value.items() if (u := unbox(v)) is not None} if isinstance(value, dict) else {}


@lru_cache(maxsize=200_000)
def _traits(word: str) -> tuple[int, str]:
    """The bin and the form of a word."""
    return _bin(word, WORDS), _form(word)


def _bin(text: str, bins: int) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) % bins


def _form(word: str) -> str:
    return re.sub(r"a+", "a", re.sub(r"9+", "9", re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", word))))


def _sketch(value, to: Counter) -> None:
    parts = value if isinstance(value, list) else [value]
    for part in parts:
        text = part if isinstance(part, str) else _compact(part)
        to["value", _bin(text, VALUES)] += 1
        words = _word.findall(text.lower())
        seen = Counter(words)
        kinds = Counter(_mark.findall(text))
        for w, n in seen.items():
            at, form = _traits(w)
            to["word", at] += n
            kinds[form] += n
        # the form of the whole value: the kinds of all its words and its punctuation, as shares, so that it has the weight of one value
        total = kinds.total()
        for k, n in kinds.items():
            to["form", _bin(k, FORMS)] += n / total
        size = math.log1p(len(text))
        to["len", 0] += 1
        to["len", 1] += size
        to["len", 2] += size * size


def _profiler(table_field: str, inside: str | None):
    def run(batches):
        sums: dict[tuple, Counter] = defaultdict(Counter)
        total: Counter = Counter()

        def flush():
            rows = [(table_field, kind, year, "", "records", 0, float(n)) for (year, kind), n in total.items()]
            rows += [(table_field, kind, year, storable(field), what, b, float(n)) for (year, kind, field), c in sums.items() for (what, b), n in c.items()]
            sums.clear()
            total.clear()
            return pd.DataFrame(rows, columns=[c.split()[0] for c in PROFILE.split(", ")])

        for pdf in batches:
            for year, kind, text in zip(pdf["year"], pdf["kind"], pdf["doc"]):
                total[int(year), kind] += 1
                for field, value in fields_of(text, inside).items():
                    to = sums[int(year), kind, field]
                    to[f"type:{json_type(value)}", 0] += 1
                    _sketch(value, to)
            if len(sums) > 5000:
                yield flush()
        yield flush()

    return run


def profile(records: DataFrame, table_field: str, inside: str | None) -> DataFrame:
    """Additive profile of ``records`` (year, kind, id, doc): one row for each field, statistic and bin."""
    once = records.where(F.col("year").isNotNull()).dropDuplicates(["year", "kind", "id", "doc"])
    parts = once.select("year", "kind", "doc").mapInPandas(_profiler(table_field, inside), PROFILE)
    keys = [c.split()[0] for c in PROFILE.split(", ")][:-1]
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"))


def assign(score: np.ndarray) -> list[tuple[int, int]]:
    """Maximum-weight bipartite matching (successive shortest paths with potentials)."""
    n, m = score.shape
    if n > m:
        return [(i, j) for j, i in assign(score.T)]
    cost = -score
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            reduced = cost[match[j0] - 1, free - 1] - u[match[j0]] - v[free]
            better = reduced < least[free]
            least[free[better]], way[free[better]] = reduced[better], j0
            j1 = free[np.argmin(least[free])]
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[free] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]


class Field:
    """The summed profile of one field in one year."""

    def __init__(self, name: str):
        self.name, self.types = name, Counter()
        self.vectors = {"word": np.zeros(WORDS), "value": np.zeros(VALUES), "form": np.zeros(FORMS)}
        self.moments = np.zeros(3)

    def add(self, what: str, at: int, n: float) -> None:
        if what.startswith("type:"):
            self.types[what[5:]] += n
        elif what == "len":
            self.moments[at] += n
        else:
            self.vectors[what][at] += n

    @property
    def type(self) -> str:
        return min(self.types, key=lambda t: (-self.types[t], t))

    def like(self, other: Field) -> float:
        """Likeness in 0..1: content (words, whole values), form, length, types, and a little the name."""

        def cosine(what):
            a, b = np.sqrt(self.vectors[what]), np.sqrt(other.vectors[what])
            return float(a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-9))

        (n, s, q), (n2, s2, q2) = self.moments, other.moments
        spread = math.sqrt(max(q / n - (s / n) ** 2, 0)) + math.sqrt(max(q2 / n2 - (s2 / n2) ** 2, 0)) + 0.25
        length = math.exp(-abs(s / n - s2 / n2) / spread)
        name = SequenceMatcher(None, self.name.lower(), other.name.lower()).ratio()
        every = sorted(self.types | other.types)
        a, b = (np.sqrt([x.types[t] / x.types.total() for t in every]) for x in (self, other))
        return 0.42 * max(cosine("word"), cosine("value")) + 0.28 * cosine("form") + 0.18 * length + 0.07 * float(a @ b) + 0.05 * name


def changes(fields: dict[tuple, Field], least: float = 0.8) -> list[tuple]:
    """Differences of each year from the year before; ``fields`` holds (table_field, kind, year, name) of that year's fields."""
    by: dict[tuple, dict[str, Field]] = defaultdict(dict)
    for (table, kind, year, name), f in fields.items():
        by[table, kind, year][name] = f
    out = []
    for (table, kind, year), now in by.items():
        before = by.get((table, kind, year - 1))
        if before is None:
            continue
        gone, come = sorted(before.keys() - now.keys()), sorted(now.keys() - before.keys())
        row = (table, kind, year)
        if gone and come:
            score = np.array([[before[a].like(now[b]) for b in come] for a in gone])
            pairs = [(gone[i], come[j]) for i, j in assign(np.where(score >= least, score, 0.0)) if score[i, j] >= least]
            out += [(*row, b, "renamed", a) for a, b in pairs]
            gone, come = [a for a in gone if a not in {p for p, _ in pairs}], [b for b in come if b not in {p for _, p in pairs}]
        out += [(*row, b, "added", "") for b in come] + [(*row, a, "removed", "") for a in gone]
        out += [(*row, k, "retyped", before[k].type) for k in sorted(before.keys() & now.keys()) if before[k].type != now[k].type]
    return out


def sources(forums: DataFrame, messages: DataFrame) -> list[tuple[DataFrame, str, str | None]]:
    subs = forums.select("year", F.lit("submission").alias("kind"), F.col("forum_id").alias("id"), F.col("submission_json").alias("doc"))
    notes = messages.where(F.col("kind").isin("official_review", "meta_review")).select("year", "kind", F.col("note_id").alias("id"), F.col("content_json").alias("doc"))
    return [(subs, "forums.submission_json", "content"), (notes, "messages.content_json", None)]


def member_fields(profiles: DataFrame, share: float = 0.1) -> dict[tuple, Field]:
    """Profiles of the fields that belong to a year, at least ``share`` of whose records have them."""
    p = cut(profiles, "profile")
    totals = p.where("what = 'records'").select("table_field", "kind", "year", F.col("n").alias("_of"))
    member = (
        p.where(F.col("what").startswith("type:"))
        .groupBy("table_field", "kind", "year", "field")
        .agg(F.sum("n").alias("_n"))
        .join(totals, ["table_field", "kind", "year"])
        .where(F.col("_n") >= F.lit(share) * F.col("_of"))
        .select("table_field", "kind", "year", "field")
    )
    fields: dict[tuple, Field] = {}
    for r in p.where("what <> 'records'").join(member, ["table_field", "kind", "year", "field"]).toLocalIterator():
        key = (r["table_field"], r["kind"], r["year"], r["field"])
        fields.setdefault(key, Field(r["field"])).add(r["what"], r["bin"], r["n"])
    return fields


def found_changes(forums: DataFrame, messages: DataFrame, share: float = 0.1) -> DataFrame:
    """Every field that came, went, changed its name or its type from one year to the next."""
    parts = [profile(*s) for s in sources(forums, messages)]
    fields = member_fields(parts[0].unionByName(parts[1]), share)
    return forums.sparkSession.createDataFrame(changes(fields), REPORT)


def canonical(fields: dict[tuple, Field]) -> dict[str, dict[tuple, str]]:
    """For each table: (kind, year, name) -> the name that the field came to have in the end."""
    moved = {(t, k, y - 1, old): new for t, k, y, new, what, old in changes(fields) if what == "renamed"}
    last = max((y for _, _, y, _ in fields), default=0)
    out: dict[str, dict[tuple, str]] = defaultdict(dict)
    for table, kind, year, name in fields:
        at, now = year, name
        while at < last:
            now = moved.get((table, kind, at, now), now)
            at += 1
        out[table][kind, year, name] = now
    return out


def unified(spark: SparkSession, records: DataFrame, table_field: str, inside: str | None, share: float = 0.1) -> DataFrame:
    """All records in one table: a text column for each field under its last name, the rest in ``other_fields``.

    Text stays text, anything else is written as JSON. A record that can't be read has nulls. Fields that
    belong to no year stay, as a JSON object, in ``other_fields``; nothing is lost. A record without a year has its
    fields under the last names they match, the rest in ``other_fields``.
    """
    names = canonical(member_fields(profile(records, table_field, inside), share))[table_field]
    taken: dict[str, str] = {}
    for name in sorted(set(names.values())):
        column = "f_" + (re.sub(r"\W+", "_", name.lower()).strip("_") or "field")
        while column in taken.values():
            column += "_"
        taken[name] = column
    columns = ["year", "kind", "id", *taken.values(), "other_fields"]
    text = lambda v: storable(v if isinstance(v, str) else _compact(v))

    def run(batches):
        for pdf in batches:
            rows = []
            for year, kind, key, doc in zip(pdf["year"], pdf["kind"], pdf["id"], pdf["doc"]):
                row, other = dict.fromkeys(columns), {}
                year = None if pd.isna(year) else int(year)
                row |= {"year": year, "kind": kind, "id": key}
                for field, value in fields_of(doc, inside).items():
                    column = taken.get(names.get((kind, year, field), field))
                    if column is None or row[column] is not None:
                        other[field] = value
                    else:
                        row[column] = text(value)
                row["other_fields"] = text(other) if other else None
                rows.append(row)
            yield pd.DataFrame(rows, columns=columns, dtype=object).astype({"year": "Int32"})

    schema = ", ".join(f"`{c}` {'int' if c == 'year' else 'string'}" for c in columns)
    once = records.dropDuplicates(["year", "kind", "id", "doc"])
    return once.mapInPandas(run, schema)
