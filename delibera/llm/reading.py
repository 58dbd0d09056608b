"""Reading level of documents: a linear pairwise ranker, calibrated into levels by isotonic regression.

Prose is taken out of each whole text (headings, list marks, references, code, tables and markup are not prose; a
line break ends a sentence where the next line starts one). Syntax and vocabulary features are ranked by a linear
model learned from pairs of graded documents, and its scores become levels by isotonic regression on the grades of
documents that the scoring model hasn't seen.
The model is learned on a bounded sample: of the graded documents the ``sample`` with the least hash of the id, and
``pairs`` pairs of them. Everything else covers all documents.

Defined results: a document without ``least_words`` words of English prose has no level (null or blank texts too).
Several grades of one document count with their mean; repeated grade rows count once. Without grades, or with one
grade only, there is no model and no document has a level.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delibera.runtime import spread

#: Frequent function words of English, and of languages that a wrong label may hide.
ENGLISH = frozenset("a an and are as at be but by for from had has have he i if in is it its no not of on or she so that the they this to was we were when which who will with would you".split())
OTHER = frozenset("au aux ce ces dans des du elle est et la le les mais ne pas pour que qui sur un une das dem den der die ein eine es fehlt für gilt ist mit nicht noch nur und von weil wird wurde zu con del el en las lo los no porque según su una y".split()) - ENGLISH
SUBORDINATE = frozenset("that which who whom whose whether although though because since unless until while whereas whereby insofar notwithstanding irrespective if as particularly considering thereby".split())

_fence = re.compile(r"^\s*(```|~~~)")
_heading = re.compile(r"^\s*(#{1,6}\s|\*\*[^*]{1,60}\*\*:?\s*$|__[^_]{1,60}__:?\s*$|=+\s*$|-{3,}\s*$)")
_label = re.compile(r"^\s*[A-Z][\w ,/&'-]{0,50}:\s*$")
_mark = re.compile(r"^\s*(?:>+\s*)*(?:[-*•+‣–]\s+|\(?\d{1,3}[.)]\s+|\(?[a-z][.)]\s+)?")
_reference = re.compile(r"^\s*(\[\d+\]|cf\.|see also\b|\(?https?://|doi:|arxiv:|\|)|\bet al\b[^.]*\bvol\b|\bcf\. Fig\b", re.I)
_tag = re.compile(r"</?[A-Za-z][^<>\n]{0,80}>|&[A-Za-z#0-9]{2,8};|`[^`\n]*`|https?://\S+|\$[^$\n]{1,200}\$")
_ends = re.compile(r"[.!?:;][\"'”’)\]*_]*$")
_split = re.compile(r"(?<=[.!?])[\"'”’)\]]*\s+(?=[\"'“‘(\[]?[A-Z0-9])")
_word = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_vowels = re.compile(r"[aeiouy]+")
_invisible = re.compile(r"[­​-‏⁠﻿]")


_REFERS = ("[", "cf.", "see also", "http", "(http", "doi:", "arxiv:", "|")  # how the lines begin that ``_reference`` can find


def _refers(line: str) -> bool:
    low = line.lower()
    return (low.lstrip().startswith(_REFERS) or "et al" in low or "cf. fig" in low) and _reference.search(line) is not None


def sentences(text: str) -> list[str]:
    """The sentences of the prose of a text."""
    if not text.isascii():
        text = _invisible.sub("", unicodedata.normalize("NFKC", text))
    text = re.sub(r"(?<=\w)-\n(?:>\s*)?(?=[a-z])", "", text)
    blocks, now, code = [], [], False
    for line in text.split("\n"):
        if _fence.match(line):
            code = not code
            continue
        if code:
            continue
        if not line.strip() or _heading.match(line) or _label.match(line) or _refers(line):
            blocks.append(now)
            now = []
            continue
        marked = _mark.match(line).end()
        body = _tag.sub(" ", line[marked:]).replace("**", "").replace("__", "").strip()
        if not body:
            continue
        is_item = bool(line[:marked].strip(" >\t"))
        if now and (is_item or _ends.search(now[-1]) or body[0].isupper() and not _wrapped(now[-1])):
            blocks.append(now)
            now = []
        now.append(body)
    blocks.append(now)
    return [s for b in blocks if b for s in _split.split(" ".join(b)) if _word.search(s)]


def _wrapped(line: str) -> bool:
    """Whether a line looks broken off by its width rather than ended: its last word can end no sentence."""
    last = line.rsplit(None, 1)[-1].lower().strip(",")
    return line.endswith(",") or last in ENGLISH - {"it", "so", "no", "not", "is", "was", "we", "you", "they"}


NAMES = ["words_per_sentence", "long_sentences", "letters_per_word", "long_words", "very_long_words", "syllables", "hard_words", "subordinate", "commas", "plain_share", "grade_of_words"]


@lru_cache(maxsize=200_000)
def _traits(word: str) -> tuple[int, int, int, int, int, int]:
    """Letters, whether long, very long or short, syllables, and whether these are many."""
    n = len(word)
    beats = max(1, len(_vowels.findall(word)) - (word.endswith("e") and not word.endswith("le")))
    return n, n >= 7, n >= 11, n <= 4, beats, beats >= 3


class Prose:
    __slots__ = ("words", "english", "features", "bag")

    def __init__(self, text: str):
        found = sentences(text)
        sizes, everything, names, raised = [], [], [], 0
        for s in found:
            tokens = _word.findall(s)
            low = [w.lower() for w in tokens]
            sizes.append(len(low))
            everything += low
            if s.islower():
                continue
            for k, (w, plain) in enumerate(zip(tokens, low)):
                if w != plain and w[0].isupper():
                    raised += 1
                    if k and plain != "i":
                        names.append(plain)
        self.words, self.bag = len(everything), Counter(everything)
        n = max(1, self.words)
        here = self.bag.keys()
        known, other, subordinate = (sum(self.bag[w] for w in words & here) for words in (ENGLISH, OTHER, SUBORDINATE))
        self.english = known >= 0.1 * n and known > 1.5 * other
        if not everything:
            self.features = np.zeros(len(NAMES))
            return
        # names are as hard as the reader finds them anywhere: a capital within a sentence is no vocabulary
        if raised <= 0.5 * n and names:
            self.bag.subtract(names)
            self.bag = Counter({w: c for w, c in self.bag.items() if c})
        m = max(1, self.bag.total())
        letters, long, very_long, short, beats, hard = np.fromiter(self.bag.values(), float, len(self.bag)) @ np.fromiter(chain.from_iterable(map(_traits, self.bag)), float, 6 * len(self.bag)).reshape(-1, 6) / m
        lengths = np.array([k for k in sizes if k], dtype=float)
        self.features = np.array(
            [
                math.log(lengths.mean()),
                math.log(np.sort(lengths)[int(0.8 * (len(lengths) - 1))]),
                letters,
                long,
                very_long,
                beats,
                hard,
                math.log1p(subordinate / len(lengths)),
                math.log1p(sum(s.count(",") + s.count(";") for s in found) / len(lengths)),
                short,
                0.0,
            ]
        )


def word_grades(prose: list[Prose], grades: np.ndarray, least: int = 3) -> dict[str, float]:
    """The mean grade of the documents that use a word, drawn to the mean of all for rare words."""
    total: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for p, g in zip(prose, grades):
        for w in p.bag:
            total[w][0] += g
            total[w][1] += 1
    middle = float(np.mean(grades))
    return {w: (s + 4 * middle) / (n + 4) for w, (s, n) in total.items() if n >= least}


def rank_model(x: np.ndarray, grade: np.ndarray, pairs: int, rounds: int = 300, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a linear ranker: logistic loss on differences of graded pairs."""
    rng = np.random.default_rng(7)
    n = len(grade)
    a, b = np.triu_indices(n, 1) if n * (n - 1) // 2 <= pairs else (rng.integers(0, n, pairs), rng.integers(0, n, pairs))
    apart = grade[a] - grade[b]
    keep = np.abs(apart) >= 0.5
    d = (x[a] - x[b])[keep] * np.sign(apart[keep])[:, None]
    weight = np.abs(apart[keep])
    w = np.zeros(x.shape[1])
    for step in range(rounds):
        miss = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        w += 2.0 / (1 + step / 100) * (d.T @ (miss * weight) / max(1e-9, weight.sum()) - ridge * w)
    return w


def isotonic(score: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps of grade over score (pool adjacent violators): both edges of each pool, with its mean grade."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []
    for s, g in zip(score[order], grade[order]):
        pools.append([s, s, g, 1.0])
        while len(pools) > 1 and pools[-2][2] >= pools[-1][2]:
            _, high, g2, n2 = pools.pop()
            low, _, g1, n1 = pools.pop()
            pools.append([low, high, (g1 * n1 + g2 * n2) / (n1 + n2), n1 + n2])
    return np.array([x for p in pools for x in p[:2]]), np.array([p[2] for p in pools for _ in range(2)])


def ordered_share(score: np.ndarray, grade: np.ndarray, fold: np.ndarray) -> float:
    """The share of pairs of one fold with grades apart that the scores put in order; nan without such pairs."""
    right = pairs = 0
    for k in np.unique(fold):
        s, g = score[fold == k], grade[fold == k]
        a, b = np.triu_indices(len(g), 1)
        apart = np.abs(g[a] - g[b]) >= 0.5
        right += (np.sign(s[a] - s[b]) == np.sign(g[a] - g[b]))[apart].sum()
        pairs += apart.sum()
    return float(right / pairs) if pairs else float("nan")


class Model:
    """Ranker and calibration. No graded document is judged by what was learned from itself: the words of a fold are graded
    by the other folds, its scores come from a ranker of the other folds, and levels are fitted on these scores."""

    def __init__(self, prose: list[Prose], grades: np.ndarray, pairs: int, folds: int = 5):
        self.middle = float(np.mean(grades))
        fold = np.arange(len(prose)) % min(folds, len(prose))
        x = np.zeros((len(prose), len(NAMES)))
        for k in np.unique(fold):
            rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            self.words = word_grades([prose[i] for i in rest], grades[rest])
            x[own] = [self.vector(prose[i]) for i in own]
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.mean) / self.scale
        held = np.zeros(len(prose))
        for k in np.unique(fold):
            held[fold == k] = z[fold == k] @ rank_model(z[fold != k], grades[fold != k], pairs)
        self.accuracy = ordered_share(held, grades, fold)
        self.at, self.level = isotonic(held, grades)
        self.w = rank_model(z, grades, pairs)
        self.words = word_grades(prose, grades)

    def vector(self, p: Prose) -> np.ndarray:
        v = p.features.copy()
        total = count = 0.0
        for w, c in p.bag.items():
            g = self.words.get(w)
            if g is not None:
                total += g * c
                count += c
        v[-1] = (total + 5 * self.middle) / (count + 5)
        return v

    def scores(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w

    def levels(self, scores: np.ndarray) -> np.ndarray:
        return np.interp(scores, self.at, self.level)


def learn(documents: DataFrame, labels: DataFrame, sample: int = 3000, pairs: int = 60_000, least_words: int = 30) -> Model | None:
    graded = (
        labels.where(F.col("doc_id").isNotNull() & F.col("grade_level").isNotNull())
        .select("doc_id", "rater", "grade_level")
        .distinct()
        .groupBy("doc_id")
        .agg(F.avg("grade_level").alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    rows = documents.select("doc_id", "text").where(F.col("text").isNotNull()).join(graded, "doc_id").collect()  # at most ``sample`` rows
    kept = [(p, r["grade"]) for r in sorted(rows, key=lambda r: r["doc_id"]) if (p := Prose(r["text"])).words >= least_words]
    if len({g for _, g in kept}) < 2:
        return None
    return Model([p for p, _ in kept], np.array([g for _, g in kept]), pairs)


LEVELS = "doc_id long, words int, english boolean, score double, level double"


def levels(documents: DataFrame, labels: DataFrame, sample: int = 3000, least_words: int = 50, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep, words of prose, english, score, level) of every document; level is null where there is none."""
    schema = ", ".join(["doc_id long", *[f"{c} {dict(documents.dtypes)[c]}" for c in keep], *LEVELS.split(", ")[1:]])
    model = documents.sparkSession.sparkContext.broadcast(learn(documents, labels, sample))

    def run(batches):
        known = model.value
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                p = Prose(text) if isinstance(text, str) else None
                if p is None or known is None or not p.english or p.words < least_words:
                    rows.append((doc_id, p.words if p else 0, bool(p and p.english), None, None))
                else:
                    s = known.scores(known.vector(p)[None])
                    rows.append((doc_id, p.words, True, float(s[0]), float(known.levels(s)[0])))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in LEVELS.split(", ")])
            yield out.assign(**{c: pdf[c].to_numpy() for c in keep})

    return spread(documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text", *keep), "doc_id").mapInPandas(run, schema)


def found_easy(documents: DataFrame, labels: DataFrame, below: float = 1.5) -> DataFrame:
    """Documents that the easiest level of readers can follow."""
    return levels(documents, labels).where(F.col("level") < below).select("doc_id").distinct()


def level_profile(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents and words at each level, by kind."""
    by = levels(documents, labels, keep=("kind",))
    return by.groupBy("kind", F.round("level").cast("int").alias("level")).agg(F.count(F.lit(1)).alias("documents"), F.sum("words").alias("words"))
