"""Columnar shredding of nested JSON records, and the flat tables that come back from the levels.

Each record is striped into one column for each leaf path. A column is a sequence of
(repetition level, definition level, value): the repetition level says at which array of the
path the entry starts a new element (0: a new record), the definition level how many steps of
the path exist. Every flat table is rebuilt from the level sequences of its own columns alone;
the position of a row within all arrays around it is counted off the repetition levels and is
the link from child to parent.

Steps of a path are the names of fields and the marker ``ITEM``, which is no text and so equals no name; a path is a
tuple, so that a name with a dot in it stays one step. All walks keep their own stack: depth has no bound but that of
the JSON parser, and a record nested deeper than that one can read counts as not valid.

Records whose value is null, empty or not valid JSON have no rows. A JSON string that holds JSON
text counts as what it holds. Repeated records give repeated rows until ``found_links`` makes
them distinct.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



class _Item:
    """The step into an array's elements."""

    __slots__ = ()

    def __repr__(self) -> str:
        return "[]"

    def __reduce__(self):
        return "ITEM"  # one and the same in every process


ITEM = _Item()


def _no_constant(text: str):
    raise ValueError(text)


_decode = json.JSONDecoder(parse_constant=_no_constant).decode
_compact = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


def parse(text):
    """The value of a JSON column, or None. JSON text within a JSON string is opened, however often it was encoded."""
    if not isinstance(text, str) or not text.strip():
        return None
    try:
        value = _decode(text)
    except (ValueError, RecursionError):
        return None
    while isinstance(value, str):
        try:
            value = _decode(value)
        except (ValueError, RecursionError):
            break
    return value


class Stripe:
    """One leaf column of a record."""

    __slots__ = ("steps", "reps", "defs", "values", "depth")

    def __init__(self, steps: tuple):
        self.steps, self.depth = steps, steps.count(ITEM)
        self.reps: list[int] = []
        self.defs: list[int] = []
        self.values: list = []

    def positions(self) -> Iterator[tuple[int, tuple, object]]:
        """(definition level, index in each array around, value) of every entry, from the levels alone."""
        at = [0] * (self.depth + 1)
        first = True
        for r, d, v in zip(self.reps, self.defs, self.values):
            if first:
                first = False
            else:
                at[r] += 1
                for k in range(r + 1, self.depth + 1):
                    at[k] = 0
            yield d, tuple(at[1:]), v


class _Node:
    __slots__ = ("fields", "item", "leaf", "all")

    def __init__(self):
        self.fields: dict[str, _Node] = {}
        self.item: _Node | None = None
        self.leaf: Stripe | None = None
        self.all: list[Stripe] = []


def _schema(value, wanted, opened: frozenset) -> _Node:
    """The record's own schema. JSON text in ``opened`` fields is opened in place."""
    root = _Node()
    todo = [(value, root, ())]
    while todo:
        value, node, steps = todo.pop()
        if isinstance(value, dict) and value:
            for name, below in value.items():
                if name in opened and isinstance(below, str):
                    inside = parse(below)
                    if inside is not None:
                        value[name] = below = inside
                if wanted is not None and name not in wanted and not (isinstance(below, (dict, list)) and below):
                    continue
                child = node.fields.get(name)
                if child is None:
                    child = node.fields[name] = _Node()
                todo.append((below, child, (*steps, name)))
        elif isinstance(value, list) and value:
            if node.item is None:
                node.item = _Node()
            inner = (*steps, ITEM)
            todo += [(below, node.item, inner) for below in value]
        elif node.leaf is None and (wanted is None or (steps and steps[-1] in wanted)):
            node.leaf = Stripe(steps)
    return root


def _gather(root: _Node) -> list[Stripe]:
    """The stripes below each node, the lowest nodes first; what has none below is cut off."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += node.fields.values()
        if node.item is not None:
            todo.append(node.item)
    for node in reversed(order):
        node.fields = {name: child for name, child in node.fields.items() if child.all}
        if node.item is not None and not node.item.all:
            node.item = None
        node.all = [node.leaf] if node.leaf else []
        for child in node.fields.values():
            node.all += child.all
        if node.item is not None:
            node.all += node.item.all
    return root.all


def _absent(stripes: list[Stripe], r: int, d: int) -> None:
    for s in stripes:
        s.reps.append(r)
        s.defs.append(d)
        s.values.append(None)


def _dissect(value, root: _Node) -> None:
    """Write the record's entries: for each node reached, its repetition and definition level."""
    todo = [(value, root, 0, 0, 0)]
    while todo:
        value, node, r, d, k = todo.pop()
        is_dict, is_list = isinstance(value, dict) and bool(value), isinstance(value, list) and bool(value)
        leaf = node.leaf
        if leaf is not None:
            leaf.reps.append(r)
            # an object or array where others have a value: the last step doesn't exist as a value
            leaf.defs.append((d - 1 if d else 0) if is_dict or is_list else d)
            leaf.values.append(None if is_dict or is_list else value)
        if node.fields:
            if is_dict:
                for name, child in node.fields.items():
                    if name in value:
                        todo.append((value[name], child, r, d + 1, k))
                    else:
                        _absent(child.all, r, d)
            else:
                for child in node.fields.values():
                    _absent(child.all, r, d)
        if node.item is not None:
            if is_list:
                # the stack gives the last one first
                todo += [(value[i], node.item, k + 1 if i else r, d + 1, k + 1) for i in range(len(value) - 1, -1, -1)]
            else:
                _absent(node.item.all, r, d)


def shred(value, wanted: frozenset | None = None, opened: frozenset = frozenset({"details"})) -> list[Stripe]:
    """The leaf columns of one record. ``wanted``: only leaves of these names; ``opened``: fields whose strings may hold JSON."""
    root = _schema(value, wanted, opened)
    stripes = _gather(root)
    if stripes:
        _dissect(value, root)
    return stripes


def tables(stripes: list[Stripe]) -> dict[tuple, dict[tuple, dict[tuple, object]]]:
    """Flat tables: repeated ancestor -> position -> path below it -> value. The table () holds what lies in no array."""
    out: dict[tuple, dict[tuple, dict[tuple, object]]] = {}
    for s in stripes:
        last = max((i + 1 for i, x in enumerate(s.steps) if x is ITEM), default=0)
        table, name = s.steps[:last], s.steps[last:]
        rows = out.setdefault(table, {})
        for d, at, v in s.positions():
            if d >= last:
                row = rows.setdefault(at, {})
                if d == len(s.steps):
                    row[name] = v
    return out


def spelled(steps: tuple) -> str:
    """A path as text: steps joined by dots, ``[]`` for elements; within names dots, brackets and backslashes are escaped."""
    return ".".join("[]" if x is ITEM else re.sub(r"([\\.\[\]])", r"\\\1", x) for x in steps)


def storable(text: str) -> str:
    """Lone surrogates, which JSON can spell but UTF-8 cannot hold, become question marks."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-8", "replace").decode()


def _as_text(value) -> str | None:
    if value is None or value == "" or value == [] or value == {}:
        return None
    return storable(value if isinstance(value, str) else _compact(value))


def id_links(value, top: str) -> Iterator[tuple[str, str]]:
    """(parent id, child id) of every object that is an array element and has an ``id``; ``top`` where no object around has one."""
    ids: dict[tuple, dict[tuple, str]] = {}
    for s in shred(value, frozenset({"id"})):
        n = len(s.steps)
        found = {at: t for d, at, v in s.positions() if d == n and (t := _as_text(v)) is not None}
        if found:
            ids[s.steps[:-1]] = found
    for owner, found in ids.items():
        if not owner or owner[-1] is not ITEM:
            continue
        around = [(ids[owner[:i]], owner[:i].count(ITEM)) for i in range(len(owner) - 1, -1, -1) if owner[:i] in ids]
        for at, child in found.items():
            for held, k in around:
                if at[:k] in held:
                    yield held[at[:k]], child
                    break
            else:
                yield top, child


def strings(value) -> set[str]:
    """Every distinct non-empty string of a record, at any depth: the text values of its leaf columns."""
    return {storable(v) for s in shred(value) for d, _, v in s.positions() if d == len(s.steps) and isinstance(v, str) and v}


LINKS = "forum_id string, parent_id string, child_id string"


def _links_of_documents(batches):
    for pdf in batches:
        rows = set()
        for forum, submission, replies in zip(pdf["forum_id"], pdf["submission_json"], pdf["replies_json"]):
            forum = forum if isinstance(forum, str) else None
            value = parse(submission)
            if isinstance(value, (dict, list)):
                rows.update((forum, a, b) for a, b in id_links(value, forum))
            value = parse(replies)
            if isinstance(value, dict):
                value = [value]
            if isinstance(value, list):
                rows.update((forum, a, b) for a, b in id_links(value, forum))
        yield pd.DataFrame(list(rows), columns=["forum_id", "parent_id", "child_id"], dtype=object)


def _links_of_lists(batches):
    for pdf in batches:
        rows = set()
        for forum, note, text in zip(pdf["forum_id"], pdf["note_id"], pdf["invitations_json"]):
            value = parse(text)
            if value is not None:
                key = (forum if isinstance(forum, str) else None, note if isinstance(note, str) else None)
                rows.update((*key, s) for s in strings(value))
        yield pd.DataFrame(list(rows), columns=["forum_id", "parent_id", "child_id"], dtype=object)


def found_links(forums: DataFrame, messages: DataFrame) -> DataFrame:
    """Parent-child links of all nested pieces: objects with ids in the documents, strings in the invitation lists.

    A null forum_id or note_id stays null. Shredding and reassembly need no shuffle, as a record is
    never split; the only exchange makes the narrow link rows distinct, partly done before it.
    """
    # a document costs much more than a list: few files of documents would leave cores idle
    docs = forums.select("forum_id", "submission_json", "replies_json")
    nested = docs.mapInPandas(_links_of_documents, LINKS)
    lists = messages.select("forum_id", "note_id", "invitations_json").where(
        F.col("invitations_json").isNotNull() & (F.length("invitations_json") > 2)
    )
    return nested.unionByName(lists.mapInPandas(_links_of_lists, LINKS)).distinct()


TABLES = "record string, source string, table_path string, row_at string, parent_path string, parent_at string, fields string"


def flat_tables(records: DataFrame, column: str, keys: tuple[str, ...] = ("forum_id",)) -> DataFrame:
    """All flat tables of one JSON column in long form: a row for each element of each repeated ancestor.

    ``row_at`` is the element's index in each array around it; ``parent_path`` and ``parent_at`` name the
    row it was nested in. ``fields`` is a JSON object of the row's own leaves. ``record`` is a digest of the
    document: one forum is fetched several times, and ``keys``, ``record``, ``table_path`` and ``row_at`` are
    unique together. Repeated records count once.
    """
    schema = ", ".join([f"{k} string" for k in keys] + [TABLES])

    def run(batches):
        for pdf in batches:
            rows = []
            for *key, record, text in zip(*[pdf[k] for k in keys], pdf["record"], pdf[column]):
                value = parse(text)
                if not isinstance(value, (dict, list)):
                    continue
                for table, found in tables(shred(value)).items():
                    above = max((i + 1 for i, x in enumerate(table[:-1]) if x is ITEM), default=0)
                    for at, fields in found.items():
                        rows.append(
                            (
                                *key,
                                record,
                                column,
                                storable(spelled(table)),
                                ".".join(map(str, at)),
                                storable(spelled(table[:above])) if table else None,
                                ".".join(map(str, at[:-1])) if table else None,
                                storable(_compact({spelled(k): v for k, v in fields.items()})),
                            )
                        )
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")], dtype=object)

    once = records.select(*keys, F.sha2(column, 256).alias("record"), column).where(F.col(column).isNotNull()).dropDuplicates([*keys, "record"])
    return once.mapInPandas(run, schema)


def typed_table(flat: DataFrame, path: str, keys: tuple[str, ...] = ("forum_id",), most: int = 2000) -> DataFrame:
    """One related table with typed columns from ``flat_tables``: the rows of a repeated ancestor, keyed and linked for joins.

    Key columns are ``keys``, ``record`` and ``row_at``; the row it was nested in has the same keys and ``parent_at`` as its
    ``row_at`` in the table ``parent_path``. A leaf is a column ``v_<path>`` of the one type that all its values have (text,
    bigint, double, boolean), of text where they differ. An error beyond ``most`` leaves; null leaves alone make a text column.
    """
    rows = flat.where(F.col("table_path") == path)
    pair = F.explode(F.map_entries(F.from_json("fields", "map<string,string>"))).alias("e")
    raw = F.try_variant_get(F.try_parse_json("fields"), "$", "map<string,variant>")
    kind = F.schema_of_variant(F.element_at("_raw", F.col("e.key")))
    found = rows.select(raw.alias("_raw"), pair).groupBy(F.col("e.key").alias("leaf"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).limit(most * 4 + 1).collect()
    kinds: dict[str, set[str]] = {}
    for r in found:
        kinds.setdefault(r["leaf"], set()).update({r["kind"].lower()} - {"void"})
    if len(kinds) > most or len(found) > most * 4:
        raise ValueError(f"more than {most} leaves in {path}")

    def column(leaf: str):
        k = {"double" if x.startswith(("decimal", "double")) else x for x in kinds[leaf]}
        k = {"double"} if k == {"bigint", "double"} else k
        text = F.element_at("_fields", F.lit(leaf))
        return text.cast(next(iter(k))) if len(k) == 1 and k <= {"bigint", "double", "boolean"} else text

    names: dict[str, str] = {}
    for leaf in sorted(kinds):
        name = "v_" + (re.sub(r"\W+", "_", leaf.lower()).strip("_") or "value")
        while name in names.values():
            name += "_"
        names[leaf] = name
    typed = rows.withColumn("_fields", F.from_json("fields", "map<string,string>"))
    return typed.select(*keys, "record", "row_at", "parent_path", "parent_at", *[column(leaf).alias(name) for leaf, name in names.items()])
