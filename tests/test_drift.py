import itertools
import json
import random

import numpy as np
import pytest

from delibera.operators import drift as D


@pytest.mark.parametrize("shape", [(1, 1), (2, 4), (4, 3), (5, 5)])
def test_matching_is_the_best(shape):
    rng = np.random.default_rng(shape[0] * 10 + shape[1])
    for _ in range(20):
        s = rng.random(shape)
        small, large = min(shape), max(shape)
        t = s if shape[0] <= shape[1] else s.T
        best = max(sum(t[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
        assert abs(sum(s[i, j] for i, j in D.assign(s)) - best) < 1e-9


def forums(rng, n=60):
    rows = []
    word = lambda: rng.choice(["graph", "speech", "vision", "theory", "control"])
    for year in (2020, 2021, 2022):
        for k in range(n):
            c = {"title": f"On {word()} {word()}", "size": k if year > 2020 else str(k)}
            c["subject" if year < 2022 else "area"] = [word(), word()]
            if year == 2021:
                c["flag"] = True
            if k == 0:
                c["odd"] = 1
            if year == 2022:
                c = {f: {"value": v} for f, v in c.items()}
            text = json.dumps({"content": c})
            rows.append((year, f"{year}-{k}", json.dumps(text) if k % 7 == 0 else text))
        rows += [(year, f"{year}-bad", '{"content": {"ti'), (year, f"{year}-null", None), (year, f"{year}-0", rows[-60][2])]
    rows.append((None, "x", "{}"))
    return rows


def test_changes_and_unified_table(spark):
    f = spark.createDataFrame(forums(random.Random(1)), "year int, forum_id string, submission_json string")
    m = spark.createDataFrame([], "year int, note_id string, kind string, content_json string")
    got = {tuple(r[2:]) for r in D.found_changes(f, m).collect()}
    assert got == {(2021, "size", "retyped", "string"), (2021, "flag", "added", ""), (2022, "flag", "removed", ""), (2022, "area", "renamed", "subject")}
    u = D.unified(spark, *D.sources(f, m)[0])
    assert {"f_area", "f_title", "f_size", "f_flag", "other_fields"} < set(u.columns)
    rows = {r["id"]: r for r in u.collect()}
    assert json.loads(rows["2020-3"]["f_area"]) and rows["2022-3"]["f_size"] == "3" and json.loads(rows["2021-0"]["other_fields"]) == {"odd": 1}
    assert rows["2020-bad"]["f_title"] is None
    assert D.found_changes(f.limit(0), m).count() == 0


def test_boxes():
    assert D.unbox({"value": {"value": 3}}) == 3 and D.unbox({"value": 1, "name": "x"}) == {"value": 1, "name": "x"}
    assert [D.json_type(v) for v in ("a", 1, 1.5, True, [], {})] == ["string", "number", "number", "boolean", "array", "object"]
