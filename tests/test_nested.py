import json

from hypothesis import given, settings
from hypothesis import strategies as st

from delibera.operators import nested as N

scalar = st.one_of(st.none(), st.booleans(), st.integers(-5, 5), st.text("ab", max_size=3))
name = st.sampled_from(["id", "a", "b"])
value = st.recursive(scalar, lambda v: st.one_of(st.lists(v, max_size=3), st.dictionaries(name, v, max_size=3)), max_leaves=14)


def brute_links(v, top, parent=None, element=False):
    out = []
    if isinstance(v, dict):
        own = N._as_text(v.get("id")) if not isinstance(v.get("id"), (dict, list)) else None
        if own is not None:
            if element:
                out.append((parent or top, own))
            parent = own
        for x in v.values():
            out += brute_links(x, top, parent)
    elif isinstance(v, list):
        for x in v:
            out += brute_links(x, top, parent, True)
    return out


def rebuild(stripes):
    """The record again, from the level sequences alone."""
    cells = {}
    for s in stripes:
        for d, at, v in s.positions():
            if d == len(s.steps):
                k, path = 0, []
                for step in s.steps:
                    if step is N.ITEM:
                        path.append(at[k])
                        k += 1
                    else:
                        path.append(step)
                cells[tuple(path)] = v
    if list(cells) == [()]:
        return cells[()]
    root = None
    for path, v in sorted(cells.items(), key=lambda c: [(isinstance(x, str), x) for x in c[0]]):
        if root is None:
            root = [] if isinstance(path[0], int) else {}
        at = root
        for step, nxt in zip(path, [*path[1:], None]):
            new = v if nxt is None else [] if isinstance(nxt, int) else {}
            if isinstance(at, list):
                while len(at) <= step:
                    at.append(new)
            else:
                at.setdefault(step, new)
            at = at[step]
    return root


@settings(max_examples=300, deadline=None)
@given(value)
def test_levels_give_the_record_back(v):
    v = json.loads(json.dumps(v))
    assert rebuild(N.shred(v, opened=frozenset())) == v


@settings(max_examples=300, deadline=None)
@given(value)
def test_links_as_by_walking(v):
    v = json.loads(json.dumps(v))
    assert sorted(set(N.id_links(v, "F"))) == sorted(set(brute_links(v, "F")))


def test_json_text_is_opened():
    assert N.parse(json.dumps(json.dumps([1]))) == [1]
    assert N.parse('"plain"') == "plain"
    assert N.parse("[1, NaN]") is None and N.parse("[1,") is None and N.parse("") is None and N.parse(None) is None
    inner = json.dumps({"edits": [{"id": "e"}]})
    assert list(N.id_links([{"id": "a", "details": inner}], "F")) == [("F", "a"), ("a", "e")]


def test_found_links(spark):
    forums = [
        ("f", json.dumps({"id": "f", "h": [[{"id": "x", "n": {"id": "m", "q": [{"id": 7}, {"id": ""}]}}]]}), json.dumps({"id": "r", "details": {"e": [{"id": None}, {"id": "y"}]}}), 1),
        ("g", None, '[{"id": "cut', 2),
        (None, "[]", '[{"id":"\\ud800z"}]', 3),
    ]
    f = spark.createDataFrame(forums, "forum_id string, submission_json string, replies_json string, parent_id int")
    messages = [("f", "n1", '["a","a",""]'), ("f", "n1", '[{"k":"b"}]'), ("f", "n2", None), ("f", "n3", '"c"'), (None, "n4", '[["d"]]'), ("f", "n5", '["cut')]
    m = spark.createDataFrame(messages, "forum_id string, note_id string, invitations_json string")
    got = {tuple(r) for r in N.found_links(f, m).collect()}
    assert got == {("f", "f", "x"), ("f", "m", "7"), ("f", "f", "r"), ("f", "r", "y"), (None, None, "?z"), ("f", "n1", "a"), ("f", "n1", "b"), ("f", "n3", "c"), (None, "n4", "d")}
    assert N.found_links(f.limit(0), m.limit(0)).count() == 0


def test_flat_tables_keep_links(spark):
    f = spark.createDataFrame([("f", json.dumps({"t": 1, "a": [{"b": [2, 3]}, {"c": "x"}]}))], "forum_id string, submission_json string")
    rows = {(r.table_path, r.row_at): (r.parent_path, r.parent_at, json.loads(r.fields)) for r in N.flat_tables(f, "submission_json").collect()}
    assert rows[("", "")] == (None, None, {"t": 1})
    assert rows[("a.[]", "1")] == ("", "", {"c": "x"})
    assert rows[("a.[].b.[]", "0.1")] == ("a.[]", "0", {"": 3})


def test_names_are_no_steps_and_depth_is_no_bound(spark):
    """Dots and brackets in names are part of the name; a record may be as deep as the parser reads."""
    assert N.tables(N.shred({"a.b": 1, "a": {"b": 2}})) == {(): {(): {("a.b",): 1, ("a", "b"): 2}}}
    assert list(N.id_links({"[]": {"id": "x"}}, "F")) == []
    assert N.spelled(("a.b", N.ITEM, "[]")) == "a\\.b.[].\\[\\]"
    deep = "[" * 700 + '{"id":"x"}' + "]" * 700
    over = "[" * 100_000 + '{"id":"x"}' + "]" * 100_000
    value = {"id": "far"}
    for _ in range(20_000):
        value = [value]
    assert list(N.id_links(value, "F")) == [("F", "far")]
    f = spark.createDataFrame([("f", deep, None), ("g", over, None)], "forum_id string, submission_json string, replies_json string")
    m = spark.createDataFrame([], "forum_id string, note_id string, invitations_json string")
    assert [tuple(r) for r in N.found_links(f, m).collect()] == [("f", "f", "x")]


def test_plain_lists_meet_the_level_sequences(monkeypatch):
    seen = []
    real = N.shred
    monkeypatch.setattr(N, "shred", lambda *a, **k: seen.append(1) or real(*a, **k))
    assert N.strings(["a", "b", ""]) == {"a", "b"} and N.strings("c") == {"c"} and N.strings([]) == set() and len(seen) == 3


def test_typed_table(spark):
    f = spark.createDataFrame([("f", json.dumps([{"id": "a", "n": 1, "x": 1.5, "m": 1, "s": {"t": True}, "z": None}, {"id": "b", "n": 2, "x": 2, "m": "q"}]))], "forum_id string, replies_json string")
    t = N.typed_table(N.flat_tables(f, "replies_json"), "[]")
    assert dict(t.dtypes) == {"forum_id": "string", "record": "string", "row_at": "string", "parent_path": "string", "parent_at": "string", "v_id": "string", "v_m": "string", "v_n": "bigint", "v_s_t": "boolean", "v_x": "double", "v_z": "string"}
    assert {(r.row_at, r.v_id, r.v_n, r.v_x, r.v_m, r.v_s_t) for r in t.collect()} == {("0", "a", 1, 1.5, "1", True), ("1", "b", 2, 2.0, "q", None)}
    assert N.typed_table(N.flat_tables(f.limit(0), "replies_json"), "[]").count() == 0
