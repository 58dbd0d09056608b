"""Similarity clusters of records with two text fields, by mergeable cluster-feature trees.

Each field becomes a vector of its weighted words and their letter groups (so that a misspelling stays near), in its
own half of the space; an empty field is a zero half and the other decides. Tasks build cluster-feature trees over
their rows; an entry holds count, sum and square sum of what it took in, so trees merge by taking in each other's
entries. The leaf summaries are reduced in a tree of tasks, each with a bounded number of entries, down to one
summary; Ward's method agglomerates it on the driver (``entries`` rows at most); a full pass assigns every row to
the nearest centroid and keeps the rows nearest to each centroid, first within each batch.

``found_matters`` then names clusters by listed exemplars: a cluster takes the row whose exemplars its centroid is
nearest to, and an exact check keeps a unit if it is near enough to what that row's clusters are about.

Defined results: repeated rows (same unit_pk) count once; a unit without words in either field has no cluster.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delibera.runtime import cut, cut_counted, spread

HALF = 512
DIM = 2 * HALF
_word = re.compile(r"[^\W\d_]+")
#: Words that only connect.
CONNECT = frozenset("a an and are as at be but by for from has have here in is it its no not of on one or particular section such than that the their them there these this to under was were when which with without".split())


@lru_cache(maxsize=200_000)
def _places(word: str) -> tuple[np.ndarray, np.ndarray]:
    """Signed places of a word: three for the word itself, one for each of its letter groups."""
    at, sign = [], []
    for k in range(3):
        h = xxhash.xxh64_intdigest(word, seed=k)
        at.append(h % HALF)
        sign.append(0.58 if h >> 40 & 1 else -0.58)
    padded = f"<{word}>"
    groups = [padded[i : i + 4] for i in range(len(padded) - 3)]
    for g in groups:
        h = xxhash.xxh64_intdigest(g, seed=9)
        at.append(h % HALF)
        sign.append((0.7 if h >> 40 & 1 else -0.7) / len(groups) ** 0.5)
    return np.array(at), np.array(sign, dtype=np.float32)


_UPPER, _LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])


def _loud(text: str) -> bool:
    """Whether much of a text is in capitals."""
    if text.isascii():
        raw = text.encode()
        n = len(raw)
        return n - len(raw.translate(None, _UPPER)) > 0.4 * max(1, n - len(raw.translate(None, _LETTERS)))
    return sum(c.isupper() for c in text) > 0.4 * max(1, sum(c.isalpha() for c in text))


_starts = re.compile(r"[.;:!?/(]")


def words_of(text) -> list[str]:
    """Content words: lower case, without numbers, names (capitals within a sentence) and plural s."""
    if not isinstance(text, str):
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    out, loud, last = [], _loud(text), None
    for m in _word.finditer(text):
        w, at = m.group(), last
        last = m.end()
        if len(w) < 3:
            continue
        low = w.lower()
        if low in CONNECT:
            continue
        if not loud and len(w) > 3 and low != w and w[0].isupper() and w[1:].islower() and at is not None and not _starts.search(text, at, m.start()):
            continue
        out.append(low[:-1] if low[-1] == "s" and len(low) > 4 and not low.endswith(("ss", "us", "is")) else low)
    return out


class Weights:
    """Weight of words by inverse document frequency. Words that much of the corpus shares count little; words in
    fewer than ``floor`` documents (misspellings, chance) count like words of that many."""

    def __init__(self, counts: dict[str, int], total: int):
        total = max(1, total)
        floor = max(3.0, 1e-3 * total)
        rate = lambda n: max(0.3, np.log(total / max(n, floor)) - 1.5) ** 1.5
        self.of = {w: float(rate(n)) for w, n in counts.items() if n > floor}
        self.rare = float(rate(floor))

    def __call__(self, word: str) -> float:
        return self.of.get(word, self.rare)


def half(texts: list[str], weight) -> np.ndarray:
    """A unit vector for each text, given as its content words with spaces between them (zero where there are none)."""
    sizes = np.fromiter((t.count(" ") + 1 if t else 0 for t in texts), dtype=np.int64, count=len(texts))
    if not sizes.sum():
        return np.zeros((len(texts), HALF), np.float32)
    code, words = pd.factorize(np.array(" ".join(t for t in texts if t).split(" "), dtype=object))
    key, n = np.unique(np.repeat(np.arange(len(texts)), sizes) * len(words) + code, return_counts=True)
    row, word = key // len(words), key % len(words)
    places = [_places(w) for w in words]
    count = np.fromiter((len(a) for a, _ in places), dtype=np.int64, count=len(places))
    begin = np.cumsum(count) - count
    take = count[word]
    at = np.repeat(begin[word] - (np.cumsum(take) - take), take) + np.arange(take.sum())
    value = np.array([weight(w) for w in words], np.float32)[word] * np.where(n > 1, np.float32(1.5), np.float32(1))
    flat = np.repeat(row * HALF, take) + np.concatenate([a for a, _ in places])[at]
    v = np.bincount(flat, weights=np.concatenate([s for _, s in places])[at] * np.repeat(value, take), minlength=len(texts) * HALF).astype(np.float32).reshape(len(texts), HALF)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-6)


def vectors(first: pd.Series, second: pd.Series, weight) -> np.ndarray:
    """Both halves side by side; what repeats within the batch is worked out once."""
    out = []
    for texts, scale in ((first, 1.0), (second, 0.8)):
        code, once = pd.factorize(texts)
        out.append((np.float32(scale) * half(list(once), weight))[code])
    return np.hstack(out)


def joined_words(texts: pd.Series) -> np.ndarray:
    """The content words of each text with spaces between them; what repeats within the batch is read once."""
    code, once = pd.factorize(texts)
    found = np.array([*(" ".join(words_of(x)) for x in once), ""], dtype=object)
    return found[code]  # code -1, a null, takes the last


class FeatureTree:
    """A height-two tree of cluster features: inner nodes lead to leaf entries (count, sum, square sum).

    An entry takes in what lies within an angle of its center, whose cosine is ``near``; when there are more than
    ``entries``, the angle is widened and the entries are taken in anew.
    """

    def __init__(self, entries: int = 1024, near: float = 0.7, fan: int = 48):
        self.limit, self.near, self.fan = entries, near, fan
        self._clear()

    def _clear(self) -> None:
        self.n, self.square, self.node = np.zeros(0), np.zeros(0), np.zeros(0, dtype=int)
        self.sum, self.tops = np.zeros((0, DIM), np.float32), np.zeros((0, DIM), np.float32)

    def add(self, n: np.ndarray, total: np.ndarray, square: np.ndarray, block: int = 1024) -> None:
        """Take in cluster features: single rows have count 1."""
        for a in range(0, len(n), block):
            self._add(n[a : a + block], total[a : a + block], square[a : a + block])
            while len(self.n) > self.limit:
                n0, total0, square0 = self.n, self.sum, self.square
                order = np.argsort(-n0, kind="stable")
                self.near *= 0.94
                self._clear()
                for b in range(0, len(order), block):
                    part = order[b : b + block]
                    self._add(n0[part], total0[part], square0[part])

    def _add(self, n, total, square) -> None:
        x = _unit(total)
        left = np.arange(len(n))
        if len(self.n):
            down = np.argmax(x @ self.tops.T, axis=1)
            centers, taken = _unit(self.sum), np.zeros(len(n), bool)
            for k in np.unique(down):
                rows, entry = np.flatnonzero(down == k), np.flatnonzero(self.node == k)
                if len(entry):
                    like = x[rows] @ centers[entry].T
                    best = like.argmax(1)
                    ok = like[np.arange(len(rows)), best] >= self.near
                    self._absorb(entry[best[ok]], n[rows[ok]], total[rows[ok]], square[rows[ok]])
                    taken[rows[ok]] = True
            left = np.flatnonzero(~taken)
        fresh: list[np.ndarray] = []
        while len(left):
            # what is near to no entry opens one and takes in what is near to it, the first of a part before the later
            part, left = left[:256], left[256:]
            near = x[part] @ x[part].T >= self.near
            np.fill_diagonal(near, True)
            free, heads, groups = np.ones(len(part), bool), [], []
            for k in range(len(part)):
                if free[k]:
                    group = near[k] & free
                    free &= ~group
                    heads.append(part[k])
                    groups.append(part[group])
            if len(left):
                like = x[left] @ x[heads].T
                best = like.argmax(1)
                ok = like[np.arange(len(left)), best] >= self.near
                order = np.argsort(best[ok], kind="stable")
                rows, at = left[ok][order], best[ok][order]
                edges = np.searchsorted(at, np.arange(len(heads) + 1))
                groups = [np.concatenate([g, rows[edges[i] : edges[i + 1]]]) for i, g in enumerate(groups)]
                left = left[~ok]
            fresh += groups
        if fresh:
            opened = np.vstack([total[rows].sum(0) for rows in fresh])
            self.n = np.concatenate([self.n, [n[rows].sum() for rows in fresh]])
            self.square = np.concatenate([self.square, [square[rows].sum() for rows in fresh]])
            self.sum = np.vstack([self.sum, opened]).astype(np.float32)
            under = np.argmax(_unit(opened) @ self.tops.T, axis=1) if len(self.tops) else np.zeros(len(fresh), dtype=int)
            self.node = np.concatenate([self.node, under])
            self._grow_tops()

    def _absorb(self, entry, n, total, square) -> None:
        for held, more in ((self.n, n), (self.sum, total), (self.square, square)):
            _add_at(held, entry, more)

    def _grow_tops(self) -> None:
        """Split nodes that hold more than ``fan`` entries at two far entries, and renew the nodes' directions."""
        centers, count = _unit(self.sum), int(self.node.max()) + 1
        queue = [k for k in range(count) if (self.node == k).sum() > self.fan]
        while queue:
            k = queue.pop()
            rows = np.flatnonzero(self.node == k)
            c = centers[rows]
            a = int(np.argmin(c @ c[0]))
            b = int(np.argmin(c @ c[a]))
            far = c @ c[b] > c @ c[a]
            if far.any() and not far.all():
                self.node[rows[far]] = count
                queue += [x for x in (k, count) if (self.node == x).sum() > self.fan]
                count += 1
        tops = np.zeros((count, DIM), np.float32)
        _add_at(tops, self.node, self.sum)
        self.tops = _unit(tops)


def _add_at(held: np.ndarray, at: np.ndarray, more: np.ndarray) -> None:
    """Add each row of ``more`` to its row ``at`` of ``held``; places may repeat."""
    if len(at):
        order = np.argsort(at, kind="stable")
        places, begin = np.unique(at[order], return_index=True)
        held[places] += np.add.reduceat(more[order], begin, axis=0)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def ward(n: np.ndarray, center: np.ndarray, clusters: int) -> np.ndarray:
    """Labels of Ward's agglomeration of weighted centers down to ``clusters``."""
    size = n.astype(float).copy()
    c = center.astype(float).copy()
    alive = np.ones(len(n), bool)
    label = np.arange(len(n))
    sq = (c**2).sum(1)
    d = np.maximum(sq[:, None] - 2 * c @ c.T + sq, 0) * (size[:, None] * size / (size[:, None] + size))
    np.fill_diagonal(d, np.inf)
    for _ in range(max(0, len(n) - clusters)):
        i, j = np.unravel_index(np.argmin(d), d.shape)
        c[i] = (size[i] * c[i] + size[j] * c[j]) / (size[i] + size[j])
        size[i] += size[j]
        alive[j] = False
        label[label == j] = i
        new = np.maximum(((c - c[i]) ** 2).sum(1), 0) * (size * size[i] / (size + size[i]))
        new[~alive] = np.inf
        new[i] = np.inf
        d[i, :], d[:, i] = new, new
        d[j, :], d[:, j] = np.inf, np.inf
    return np.unique(label, return_inverse=True)[1]


def distinct_units(units: DataFrame, first: str = "inspected_object", second: str = "reasoning") -> DataFrame:
    """(unit_pk, a, b), one row for each key; of different rows of one key the largest counts."""
    row = F.struct(F.col(first).alias("a"), F.col(second).alias("b"))
    return units.where(F.col("unit_pk").isNotNull()).groupBy("unit_pk").agg(F.max(row).alias("r")).select("unit_pk", "r.a", "r.b")


def word_weights(rows: DataFrame, total: int) -> Weights:
    """Document frequencies of all rows. Only words above the rarity floor reach the driver, a bounded number."""
    words = rows.select(F.explode(F.array_distinct(F.split(F.concat_ws(" ", F.nullif("a", F.lit("")), F.nullif("b", F.lit(""))), " "))).alias("word")).where("word <> ''")
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(3.0, 1e-3 * total))
    return Weights({r["word"]: r["n"] for r in counts.toLocalIterator()}, total)


FEATURES = "part int, n double, total binary, square double"


def _emit(tree: FeatureTree, part: int) -> pd.DataFrame:
    return pd.DataFrame({"part": np.full(len(tree.n), part, dtype=np.int32), "n": tree.n, "total": [v.astype(np.float32).tobytes() for v in tree.sum], "square": tree.square})


def leaf_summary(rows: DataFrame, weights, parts: int, entries: int = 1024, fan_in: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Counts and centers of the leaf entries of all rows' trees, merged by a tree of tasks; ``parts``: partitions of ``rows``."""
    from pyspark import TaskContext

    def build(batches):
        tree, seen = FeatureTree(entries), False
        for pdf in batches:
            both = vectors(pdf["a"], pdf["b"], weights.value)
            for a in range(0, len(pdf), 2048):
                v = both[a : a + 2048]
                v = v[(v**2).sum(1) > 0]
                if len(v):
                    seen = True
                    tree.add(np.ones(len(v)), v, (v**2).sum(1))
        if seen:
            yield _emit(tree, TaskContext.get().partitionId())

    def merge(pdf):
        tree = FeatureTree(entries)
        pdf = pdf.sort_values(["part", "n"], ascending=[True, False], kind="stable")
        tree.add(pdf["n"].to_numpy(), np.vstack([np.frombuffer(x, np.float32) for x in pdf["total"]]), pdf["square"].to_numpy())
        return _emit(tree, int(pdf["part"].min()) // fan_in)

    level = cut(rows.select("a", "b").mapInPandas(build, FEATURES), "features")
    while parts > 1:
        level = cut(level.groupBy(F.expr(f"part div {fan_in}")).applyInPandas(merge, FEATURES), "features")
        parts = -(-parts // fan_in)
    found = level.orderBy(F.desc("n")).collect()  # at most ``entries`` rows
    if not found:
        return np.zeros(0), np.zeros((0, DIM))
    n = np.array([r["n"] for r in found])
    return n, np.vstack([np.frombuffer(r["total"], np.float32) for r in found]) / n[:, None]


def cluster_centers(rows: DataFrame, weights, parts: int, clusters: int, entries: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Directions and sizes of Ward's clusters of the leaf entries, largest first."""
    n, centers = leaf_summary(rows, weights, parts, entries)
    if not len(n):
        return np.zeros((0, DIM), np.float32), n
    label = ward(n, centers, clusters)
    total, size = np.zeros((label.max() + 1, DIM)), np.bincount(label, weights=n)
    _add_at(total, label, centers * n[:, None])
    order = np.argsort(-size, kind="stable")
    return (total / size[:, None])[order].astype(np.float32), size[order]


def likeness(v: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Cosines over the halves that a row has: a missing field takes no part on either side."""
    dots, norm = np.zeros((len(v), len(centers)), np.float32), np.zeros((len(v), len(centers)), np.float32)
    own = np.zeros((len(v), 1), np.float32)
    for h in (slice(0, HALF), slice(HALF, DIM)):
        part = (v[:, h] ** 2).sum(1, keepdims=True)
        dots += v[:, h] @ centers[:, h].T
        norm += np.where(part > 0, (centers[:, h] ** 2).sum(1), 0)
        own += part
    return dots / np.sqrt(np.maximum(norm * own, 1e-9))


def _prepared(units: DataFrame, texts: bool = False):
    """(unit_pk, content words of both fields[, first field]) of each unit, in files that a task each reads; their number; word weights.

    Texts are read once; what follows reads the words.
    """
    spark = units.sparkSession
    kept = ", text string" if texts else ""

    def run(batches):
        for pdf in batches:
            out = {"unit_pk": pdf["unit_pk"], "a": joined_words(pdf["a"]), "b": joined_words(pdf["b"])}
            yield pd.DataFrame(out | ({"text": pdf["a"]} if texts else {}))

    rows = spread(distinct_units(units), "unit_pk").mapInPandas(run, f"unit_pk long, a string, b string{kept}")
    rows, seen = cut_counted(rows, "words", rows=F.lit(True))
    return rows, rows.rdd.getNumPartitions(), spark.sparkContext.broadcast(word_weights(rows, seen["rows"]))


def described_clusters(units: DataFrame, clusters: int = 60, members: int = 12) -> DataFrame:
    """(cluster, size, share, exemplars): the members nearest to the centroid, distinct, nearest first."""
    rows, parts, weights = _prepared(units, texts=True)
    centers, _ = cluster_centers(rows, weights, parts, clusters)
    known = units.sparkSession.sparkContext.broadcast(centers)

    def run(batches):
        for pdf in batches:
            v = vectors(pdf["a"], pdf["b"], weights.value)
            has = (v**2).sum(1) > 0
            if not len(known.value) or not has.any():
                continue
            like = likeness(v[has], known.value)
            best = like.argmax(1)
            out = pd.DataFrame({"cluster": best.astype(np.int32), "near": like[np.arange(len(best)), best].astype(float), "text": [x.strip() if w else "" for x, w in zip(pdf["text"][has], pdf["a"][has])]})
            size = out.groupby("cluster").size()
            # of the members only the nearest texts of the batch can be among the nearest of all
            near = out[out["text"] != ""].sort_values(["near", "text"], ascending=[False, True]).drop_duplicates(["cluster", "text"]).groupby("cluster").head(members)
            yield pd.concat([near.assign(n=0), pd.DataFrame({"cluster": size.index.astype(np.int32), "near": 0.0, "text": None, "n": size.to_numpy()})]).astype({"n": "int64"})

    part = cut(rows.select("a", "b", "text").mapInPandas(run, "cluster int, near double, text string, n long"), "nearest")
    sizes = part.groupBy("cluster").agg(F.sum("n").alias("size"))
    order = F.struct((-F.round("near", 6)).alias("far"), F.col("text").alias("text"))
    texts = part.where(F.col("text").isNotNull()).groupBy("cluster", "text").agg(F.max("near").alias("near")).groupBy("cluster").agg(F.slice(F.sort_array(F.collect_list(order)), 1, members)["text"].alias("exemplars"))
    total = part.agg(F.sum("n")).first()[0] or 1
    return sizes.join(texts, "cluster", "left").select("cluster", "size", (F.col("size") / total).alias("share"), "exemplars")


def name_clusters(centers: np.ndarray, sizes: np.ndarray, listed: np.ndarray, sure: float = 0.3, near: float = 0.3, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(row of each cluster or -1, what each row's clusters are about). ``listed``: exemplar directions of the rows, first half.

    Clusters near to a row's exemplars are taken first; then those near, in both fields, to what is taken already.
    """
    first = centers[:, :HALF] / np.maximum(np.linalg.norm(centers[:, :HALF], axis=1, keepdims=True), 1e-9)
    like = first @ listed.T
    best = like.argmax(1)
    second = np.sort(like, axis=1)[:, -2] if like.shape[1] > 1 else np.zeros(len(like))
    top = like.max(1)
    row = np.where((top >= sure) & (top >= second + 0.08), best, -1)
    about = np.zeros((len(listed), DIM), np.float32)
    for _ in range(rounds):
        for j in range(len(listed)):
            taken = row == j
            about[j] = (centers[taken] * sizes[taken, None]).sum(0) / max(1e-9, sizes[taken].sum())
            if not taken.any():
                about[j, :HALF] = listed[j]
        again = likeness(centers, about)
        rest = np.flatnonzero(row < 0)
        pick = rest[again[rest].max(1) >= near]
        row[pick] = again[pick].argmax(1)
        if not len(pick):
            break
    return row, about


def found_matters(units: DataFrame, exemplars: DataFrame, clusters: int = 240, least: float = 0.2, alone: float = 0.45) -> DataFrame:
    """(unit_pk, cluster_id) of units about the matter of a listed row. The list is small: a row for each matter.

    The check asks for a likeness of ``least`` to what the row's clusters are about, and of ``alone`` where the unit's
    own cluster is named by no row.
    """
    rows, parts, weights = _prepared(units)
    listed = [(r["cluster_id"], r["exemplars"] or []) for r in exemplars.where(F.col("cluster_id").isNotNull()).orderBy("cluster_id").collect()]
    schema = "unit_pk long, cluster_id int"
    centers, sizes = cluster_centers(rows, weights, parts, clusters)
    if not listed or not len(centers):
        return units.sparkSession.createDataFrame([], schema)
    directions = np.array([half([" ".join(words_of(x)) for x in texts], weights.value).mean(0) if texts else np.zeros(HALF) for _, texts in listed])
    directions = _unit(directions).astype(np.float32)
    row, about = name_clusters(centers, sizes, directions)
    ids = np.array([i for i, _ in listed])
    known = units.sparkSession.sparkContext.broadcast((centers, row, about))

    def run(batches):
        centers, row, about = known.value
        for pdf in batches:
            v = vectors(pdf["a"], pdf["b"], weights.value)
            has = np.flatnonzero((v**2).sum(1) > 0)
            if not len(has):
                continue
            v = v[has]
            named = row[likeness(v, centers).argmax(1)]
            close = likeness(v, about)
            close[np.arange(len(v)), np.maximum(named, 0)] += 0.1 * (named >= 0)
            best = close.argmax(1)
            keep = close[np.arange(len(v)), best] >= np.where(named >= 0, least, alone)
            yield pd.DataFrame({"unit_pk": pdf["unit_pk"].to_numpy()[has[keep]], "cluster_id": ids[best[keep]].astype(np.int32)})

    return rows.mapInPandas(run, schema)
