import random

import pytest

from delibera.operators import hierarchy as H

SCHEMA = "note_id string, forum_id string, replyto string, mdate long, node string"


def brute(parent, forum):
    out = {}
    for n in parent:
        seen, x = [n], n
        while True:
            p = parent[x]
            if p is None:
                out[n] = (x, len(seen) - 1, "ok")
            elif forum.get(p) != forum[x]:
                out[n] = (x, len(seen) - 1, "orphan")
            elif p in seen:
                out[n] = (min(seen[seen.index(p) :]), -1, "cycle")
            else:
                seen.append(p)
                x = p
                continue
            break
    return out


def random_forest(seed, n=120):
    rng = random.Random(seed)
    ids = [f"n{i:03d}" for i in range(n)]
    forum = {i: rng.choice("fg") if rng.random() < 0.1 else "f" for i in ids}
    parent = {}
    for k, i in enumerate(ids):
        r = rng.random()
        if r < 0.1:
            parent[i] = None
        elif r < 0.15:
            parent[i] = "nowhere"
        elif r < 0.6 and k:
            parent[i] = ids[k - 1]
        else:
            parent[i] = rng.choice(ids)
    return parent, forum


@pytest.mark.parametrize("seed", [3])
def test_as_by_walking(spark, seed):
    parent, forum = random_forest(seed)
    rows = [(n, forum[n], forum[n] if p is None else f"?id={forum[n]}&noteId={p}", 1, "x") for n, p in parent.items()]
    got = {r[0]: tuple(r[1:]) for r in H.found_places(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(parent, forum)


def test_link_forms_repeats_and_nulls(spark):
    rows = [
        ("a", "f", None, 1, ""), ("b", "f", " a\n", 1, ""), ("b", "f", " a\n", 5, ""), ("c", "f", "https://x/forum?id=f&noteId=b", None, ""), ("d", "f", " ​", 1, ""),
        ("e", "f", "?id=f", 1, ""), ("s", "f", "s", 1, ""), ("t", "f", "s", 1, ""), (None, "f", "a", 1, ""), ("o", None, "a", 1, ""), ("q", None, None, 1, ""),
    ]
    got = {r[0]: tuple(r[1:]) for r in H.found_places(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {
        "a": ("a", 0, "ok"), "b": ("a", 1, "ok"), "c": ("a", 2, "ok"), "d": ("d", 0, "ok"), "e": ("e", 0, "ok"),
        "s": ("s", -1, "cycle"), "t": ("s", -1, "cycle"), "o": ("o", 0, "orphan"), "q": ("q", 0, "ok"),
    }
    assert H.found_places(spark.createDataFrame([], SCHEMA)).count() == 0


def test_paths_and_sizes_as_by_walking(spark):
    """Chains, branches, orphans and circles: paths and descendants come back from the records as a walk finds them."""
    parent, forum = random_forest(5, 90)
    rows = [(n, forum[n], p, 1, "x") for n, p in parent.items()]
    truth = brute(parent, forum)
    below = dict.fromkeys(parent, 0)
    paths = {}
    for n in parent:
        if truth[n][2] == "cycle":
            continue
        path, x = [n], n
        while x != truth[n][0]:
            x = parent[x]
            path.insert(0, x)
            below[x] += 1
        paths[n] = "/".join(path)
    got = {r.note_id: (r.path, r.notes_below) for r in H.described(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {n: (paths.get(n), below[n] if n in paths else None) for n in parent}


def test_long_chain_and_circle(spark):
    """Rounds grow with the logarithm, and the circle's least id is its root; sizes along a spliced chain add up."""
    ids = [f"n{i:04d}" for i in range(200)]
    rows = [(n, "f", ids[i - 1] if i else None, 1, "") for i, n in enumerate(ids)]
    rows += [(f"c{i:03d}", "f", f"c{(i + 1) % 60:03d}", 1, "") for i in range(60)]
    done = H.Contraction(H.linked(spark.createDataFrame(rows, SCHEMA)), whole=True)
    assert len(done.rounds) <= 18
    got = {r.node: (r.root, r.depth, r.state) for r in done.places().collect()}
    assert all(got[n] == (ids[0], i, "ok") for i, n in enumerate(ids))
    assert all(got[f"c{i:03d}"] == ("c000", -1, "cycle") for i in range(60))
    below = {r.node: r.notes_below for r in done.sizes().collect()}
    assert all(below[n] == 199 - i for i, n in enumerate(ids))


def test_paths_and_descendants(spark):
    rows = [(n, "f", p, 1, "") for n, p in [("a", None), ("b", "a"), ("c", "b"), ("d", "b"), ("e", "d"), ("x", "y"), ("y", "x")]]
    m = spark.createDataFrame(rows, SCHEMA)
    got = {r.note_id: (r.path, r.notes_below) for r in H.described(m).collect()}
    assert got == {"a": ("a", 4), "b": ("a/b", 3), "c": ("a/b/c", 0), "d": ("a/b/d", 1), "e": ("a/b/d/e", 0), "x": (None, None), "y": (None, None)}
    below = {(r.note_id, r.below_id, r.links) for r in H.pairs_below(m).collect()}
    assert below == {("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("a", "e", 3), ("b", "c", 1), ("b", "d", 1), ("b", "e", 2), ("d", "e", 1)}
