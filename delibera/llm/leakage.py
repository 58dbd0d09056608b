"""Evaluation texts that leak into a corpus, found with an FM-index of each shard of documents.

Texts are squeezed to their letters and digits (case, accents, width, punctuation, markup, spacing and invisible
characters vanish), so that a line break within a word can't hide it. A task gathers the documents of a shard,
sorts their suffixes by prefix doubling, and keeps the Burrows-Wheeler transform as a wavelet matrix with sampled
suffix positions. All phrases of ``seed_words`` successive words of the test texts are searched backwards at once;
occurrences are located by walking to sampled positions, extended word by word against the item, and judged.

A passage of 24 words with at most one word in eight replaced holds 6 words in a row unchanged (21 kept words in at
most 4 runs; longer passages hold longer runs), and 12 unchanged words hold 6: no passage can be without a seed.
Words of a sentence that stands in ``shared_by`` or more items give no seeds and don't count.

The items are the stated query set; ``items_limit`` bounds their text, as every task gets it. Phrases are searched
in blocks. A document longer than a shard is indexed in pieces, an index for each, that overlap by more than the longest item.

Defined results: null or blank texts and null ids have no rows; an item is a case of each document once.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from delibera.runtime import spread

END, GAP, FIRST = 0, 1, 2  # end of the shard, end of a document, first letter
BITS = 6


@lru_cache(maxsize=20_000)
def _codes_of(ch: str) -> bytes:
    """The codes of one character: 0-9a-z, and 26 classes of other letters; nothing for the rest."""
    out = []
    for c in unicodedata.normalize("NFKD", ch).casefold():
        if "0" <= c <= "9":
            out.append(FIRST + ord(c) - 48)
        elif "a" <= c <= "z":
            out.append(FIRST + 10 + ord(c) - 97)
        elif c.isalnum():
            out.append(FIRST + 36 + ord(c) % 26)
    return bytes(out)


_TABLE = np.array([(_codes_of(chr(i)) or b"\0")[0] for i in range(128)], dtype=np.uint8)
_SPACE = np.array([chr(i).isspace() for i in range(128)])
_MARKUP = re.compile(r"</?[A-Za-z][^<>\n]{0,80}>|&(?:[A-Za-z]{2,8}|#\d{2,6});")


class Squeezed:
    """Codes of a text's letters and digits, and where words begin; the place of each in the text where it is asked for."""

    __slots__ = ("codes", "starts", "bytes", "_keep", "_place")

    def __init__(self, text: str):
        if text.isascii():
            raw = np.frombuffer(text.encode("ascii"), dtype=np.uint8)
            codes, place, space = _TABLE[raw], None, _SPACE[raw]
        else:
            once, at = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), return_inverse=True)
            parts = [_codes_of(chr(c)) or b"\0" for c in once]
            sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
            joined, begin = np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum(sizes) - sizes
            space = np.fromiter((chr(c).isspace() for c in once), dtype=bool, count=len(once))[at]
            if sizes.max() == 1:
                codes, place = joined[at], None
            else:
                take = sizes[at]
                place = np.repeat(np.arange(len(at)), take)
                codes = joined[np.repeat(begin[at] - (np.cumsum(take) - take), take) + np.arange(take.sum())]
                space = space[place]
        if "<" in text or "&" in text:
            drop = np.zeros(len(text), dtype=bool)
            for m in _MARKUP.finditer(text):
                drop[m.start() : m.end()] = True
            codes = np.where(drop if place is None else drop[place], 0, codes)
        keep = codes > 0
        word = np.cumsum(space, dtype=np.int32)[keep]
        self.codes, self._keep, self._place = codes[keep], keep, place
        self.starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
        self.bytes = self.codes.tobytes()

    @property
    def place(self) -> np.ndarray:
        at = np.flatnonzero(self._keep)
        return at if self._place is None else self._place[at]

    def words(self) -> list[bytes]:
        edges = [*self.starts.tolist(), len(self.codes)]
        return [self.bytes[a:b] for a, b in zip(edges, edges[1:])]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by prefix doubling over the groups that are still tied; ``text`` ends with END.

    Ties may be sorted in any order: those that are left are told apart by the next doubling.
    """
    n, k = len(text), 60 // BITS
    padded = np.concatenate([text, np.zeros(k, np.uint8)]).astype(np.uint64)
    two = padded[:-1] << np.uint64(BITS) | padded[1:]
    four = two[:-2] << np.uint64(2 * BITS) | two[2:]
    eight = four[:-4] << np.uint64(4 * BITS) | four[4:]
    key = eight[:n] << np.uint64(2 * BITS) | two[8 : 8 + n]
    order = np.argsort(key).astype(np.int32)  # a shard has far fewer letters than 2 ** 31
    found = key[order]
    edge = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])).astype(np.int32)
    sizes = np.diff(np.append(edge, n))
    group = np.repeat(edge, sizes)
    rank = np.empty(n, np.int32)
    rank[order] = group
    tied = np.flatnonzero(np.repeat(sizes > 1, sizes))
    while len(tied):
        at = order[tied]
        ahead = at + k
        later = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = group[tied].astype(np.uint64) << np.uint64(32) | later.astype(np.uint64)
        by = np.argsort(key)
        order[tied], key = at[by], key[by]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(edge, len(tied)))
        group[tied] = np.repeat(tied[edge], sizes)
        rank[order[tied]] = group[tied]
        tied = tied[np.repeat(sizes > 1, sizes)]
        k *= 2
    return order


class FMIndex:
    def __init__(self, text: np.ndarray, every: int = 16):
        order = suffix_array(text)
        self.n = len(text)
        self.bwt = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.bwt, minlength=1 << BITS))]).astype(np.int64)
        self.ones, self.zeros, row = [], [], self.bwt
        for b in range(BITS - 1, -1, -1):
            bit = (row >> b) & 1
            self.ones.append(np.zeros(len(row) + 1, np.int32))
            np.cumsum(bit, out=self.ones[-1][1:])
            self.zeros.append(int(len(row) - self.ones[-1][-1]))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        sampled = order % every == 0
        self.mark = sampled
        self.sample_at = np.cumsum(sampled, dtype=np.int32) - 1
        self.samples = order[sampled].astype(np.int64)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each code ``c`` before row ``i``, level by level of the wavelet matrix."""
        s, e = np.zeros_like(i), i
        for level, b in enumerate(range(BITS - 1, -1, -1)):
            ones, z, bit = self.ones[level], self.zeros[level], ((c >> b) & 1).astype(bool)
            s1, e1 = ones[s], ones[e]
            s, e = np.where(bit, z + s1, s - s1), np.where(bit, z + e1, e - e1)
        return e - s

    def search(self, padded: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of many phrases; row j of ``padded`` holds phrase j reversed."""
        low, high = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.n, np.int64)
        live = np.arange(len(sizes))
        for step in range(padded.shape[1]):
            live = live[(sizes[live] > step) & (high[live] > low[live])]
            if not len(live):
                break
            c = padded[live, step].astype(np.int64)
            base = self.first[c]
            low[live], high[live] = base + self.rank(c, low[live]), base + self.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by steps of the last-to-first map until a sampled one."""
        rows, out, steps = rows.copy(), np.zeros(len(rows), np.int64), 0
        live = np.arange(len(rows))
        while len(live):
            done = self.mark[rows[live]]
            out[live[done]] = self.samples[self.sample_at[rows[live[done]]]] + steps
            live = live[~done]
            c = self.bwt[rows[live]].astype(np.int64)
            rows[live] = self.first[c] + self.rank(c, rows[live])
            steps += 1
        return out % self.n


_SENTENCE = re.compile(r"(?<=[.?!])[\"'”’)\]]*\s+|\n{2,}")


class Items:
    """The test texts as words, which of them count, and all their seed phrases."""

    def __init__(self, rows: list[tuple[int, str]], seed_words: int = 6, shared_by: int = 3):
        texts: dict[int, list[str]] = defaultdict(list)
        for item, text in rows:
            if text not in texts[item]:
                texts[item].append(text)
        seen: dict[bytes, set[int]] = defaultdict(set)
        split = {(item, k): [Squeezed(s).words() for s in _SENTENCE.split(t)] for item, ts in texts.items() for k, t in enumerate(ts)}
        for (item, _), sentences in split.items():
            for s in sentences:
                seen[b"".join(s)].add(item)
        self.words: list[list[bytes]] = []
        self.counts: list[np.ndarray] = []
        self.item: list[int] = []
        seeds: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for (item, _), sentences in split.items():
            words = [w for s in sentences for w in s]
            counts = np.array([len(seen[b"".join(s)]) < shared_by for s in sentences for _ in s], dtype=bool)
            at = len(self.words)
            self.words.append(words)
            self.counts.append(counts)
            self.item.append(item)
            for k in range(len(words) - seed_words + 1):
                if counts[k : k + seed_words].all():
                    seeds[b"".join(words[k : k + seed_words])].append((at, k))
        self.seed_words, self._blocks = seed_words, None
        self.phrases = list(seeds)
        self.places = list(seeds.values())
        self.longest = max((sum(map(len, w)) for w in self.words), default=0)

    def blocks(self, size: int = 20_000):
        """(number of the first, phrases reversed and padded, their sizes) of each block; made once."""
        if self._blocks is None:
            self._blocks = []
            for a in range(0, len(self.phrases), size):
                part = self.phrases[a : a + size]
                sizes = np.array([len(p) for p in part])
                wide = int(sizes.max())
                self._blocks.append((a, np.frombuffer(b"".join(p[::-1].ljust(wide, b"\0") for p in part), np.uint8).reshape(len(part), wide), sizes))
        return self._blocks


def aligned(doc: Squeezed, words: list[bytes], at: int, k: int, n: int, one_in: int = 8) -> tuple[int, list[int], list[bool]]:
    """Extend a seed (words k..k+n at place ``at``) both ways, replaced words one for one: first word, places, kept or not."""
    text, starts = doc.bytes, doc.starts
    places, kept, cur = [], [], at
    for w in words[k : k + n]:
        places.append(cur)
        kept.append(True)
        cur += len(w)
    most = len(words) // one_in  # more replaced words in a row no passage of the item can have
    missed, j = 0, k + n
    is_start = lambda p: p >= len(text) or starts[min(np.searchsorted(starts, p), len(starts) - 1)] == p
    while j < len(words) and cur < len(text) and missed <= most:
        w = words[j]
        fits = text.startswith(w, cur)
        if fits and not is_start(cur + len(w)):
            # a longer word that begins alike, unless the next word goes on right here (a word broken in two)
            fits = j + 1 < len(words) and text.startswith(words[j + 1], cur + len(w)) or j + 1 == len(words)
        places.append(cur)
        kept.append(fits)
        if fits:
            cur, missed = cur + len(w), 0
        else:
            nxt = np.searchsorted(starts, cur, side="right")
            cur, missed = int(starts[nxt]) if nxt < len(starts) else len(text), missed + 1
        j += 1
    cur, missed, i = at, 0, k
    while i > 0 and cur > 0 and missed <= most:
        w = words[i - 1]
        fits = text.endswith(w, 0, cur)
        if fits and not is_start(cur - len(w)):
            fits = i > 1 and text.endswith(words[i - 2], 0, cur - len(w)) or i == 1
        if fits:
            cur, missed = cur - len(w), 0
        else:
            prev = np.searchsorted(starts, cur) - 1
            cur, missed = int(starts[prev]) if prev >= 0 else 0, missed + 1
        places.insert(0, cur)
        kept.insert(0, fits)
        i -= 1
    return i, places, kept


def passage(kept: list[bool], counts: np.ndarray, exact: int = 12, loose: int = 24, one_in: int = 8) -> tuple[int, int] | None:
    """The longest stretch (first, last word) that is a leaked passage: ``exact`` counted words in a row, or ``loose`` with few replaced."""
    kept_a, best, n = np.array(kept), None, len(kept)
    run = 0
    held = np.concatenate([[0], np.cumsum(counts)])
    lost = np.concatenate([[0], np.cumsum(counts & ~kept_a)])
    start = 0
    for e in range(n + 1):
        if e == n or not kept_a[e]:
            if held[e] - held[start] >= exact and e - start > run:
                run, best = e - start, (start, e - 1)
            start = e + 1
    good = np.flatnonzero(kept_a)
    for a in good:
        ends = good[good >= a + loose - 1]
        if not len(ends):
            break
        size, miss = held[ends + 1] - held[a], lost[ends + 1] - lost[a]
        ok = ends[(size >= loose) & (miss * one_in <= size)]
        if len(ok) and ok[-1] - a + 1 > run:
            run, best = int(ok[-1] - a + 1), (int(a), int(ok[-1]))
    return best


SPANS = "doc_id long, item_id long, first_char int, last_char int, words int, replaced int"


def _pieces(doc: Squeezed, piece: int, overlap: int):
    """(where it begins, codes) of the pieces a document is indexed in; each reaches ``overlap`` into the next."""
    for a in range(0, max(1, len(doc.codes)), piece):
        yield a, doc.codes[a : a + piece + overlap]


def _shard(parts: list[tuple[int, Squeezed, int, np.ndarray]], items: Items) -> list[tuple]:
    """The passages in the parts (doc_id, document, where the part begins, its codes) of one shard, by one index of all of them."""
    text, begins, size = [], [], 0
    for _, _, _, codes in parts:
        text += [codes, np.array([GAP], np.uint8)]
        begins.append(size)
        size += len(codes) + 1
    index = FMIndex(np.concatenate([*text, np.array([END], np.uint8)]))
    begins_a = np.array(begins)
    hits: dict[tuple[int, int], set[tuple[int, int]]] = defaultdict(set)
    for base, padded, sizes in items.blocks():
        low, high = index.search(padded, sizes)
        found = np.flatnonzero(high > low)
        if not len(found):
            continue
        width = high[found] - low[found]
        rows = np.repeat(low[found], width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        where = index.locate(rows)
        part = np.searchsorted(begins_a, where, side="right") - 1
        for seed, p, at in zip(np.repeat(found, width).tolist(), part.tolist(), (where - begins_a[part]).tolist()):
            for text_no, k in items.places[base + seed]:
                hits[p, text_no].add((at + parts[p][2], k))
    out = []
    for (p, text_no), seeds in hits.items():
        doc_id, doc = parts[p][:2]
        words, counts = items.words[text_no], items.counts[text_no]
        done: set[tuple[int, int]] = set()
        spot = None
        for at, k in sorted(seeds):
            if (at, k) in done:
                continue
            i, places, kept = aligned(doc, words, at, k, items.seed_words)
            done.update((q, i + j) for j, q in enumerate(places) if kept[j])
            if span := passage(kept, counts[i : i + len(kept)]):
                a, b = span
                spot = doc.place if spot is None else spot
                last = min(places[b] + len(words[i + b]), len(spot)) - 1
                out.append((doc_id, items.item[text_no], int(spot[places[a]]), int(spot[last]), b - a + 1, b - a + 1 - sum(kept[a : b + 1])))
    return out


def leaked_spans(documents: DataFrame, test_items: DataFrame, shard_chars: int = 500_000, items_limit: int = 32_000_000) -> DataFrame:
    """(doc_id, item_id, first_char, last_char, words, replaced) of each leaked passage."""
    rows = [(r[0], r[1]) for r in test_items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct().toLocalIterator()]
    if sum(len(t) for _, t in rows) > items_limit:
        raise ValueError(f"the test texts exceed {items_limit} characters; search them in parts")
    # built once; a task gets it as it is
    items = documents.sparkSession.sparkContext.broadcast(Items(sorted(rows)))

    def run(batches):
        known = items.value
        overlap = 2 * known.longest + 64
        shard: list[tuple[int, Squeezed, int, np.ndarray]] = []
        size = 0
        frame = lambda found: pd.DataFrame(found, columns=[c.split()[0] for c in SPANS.split(", ")])
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                doc = Squeezed(text)
                if len(doc.starts) < known.seed_words or not known.phrases:
                    continue
                for begin, codes in _pieces(doc, shard_chars, overlap):
                    shard.append((doc_id, doc, begin, codes))
                    size += len(codes)
                    if size >= shard_chars:
                        yield frame(_shard(shard, known))
                        shard, size = [], 0
        if shard:
            yield frame(_shard(shard, known))

    texts = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    return spread(texts, "doc_id").mapInPandas(run, SPANS)


def found_leaks(documents: DataFrame, test_items: DataFrame) -> DataFrame:
    return leaked_spans(documents, test_items).select("doc_id", "item_id").distinct()


def removal_spans(documents: DataFrame, test_items: DataFrame) -> DataFrame:
    """The parts of each document to remove: overlapping passages merged, with the number of items they come from."""
    spans = leaked_spans(documents, test_items).select("doc_id", "item_id", "first_char", "last_char").distinct()
    order = Window.partitionBy("doc_id").orderBy("first_char", "last_char", "item_id")
    before = F.max("last_char").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = spans.withColumn("_new", (before.isNull() | (F.col("first_char") > before + 1)).cast("int"))
    return (
        apart.withColumn("_span", F.sum("_new").over(order))
        .groupBy("doc_id", "_span")
        .agg(F.min("first_char").alias("first_char"), F.max("last_char").alias("last_char"), F.count_distinct("item_id").alias("items"))
        .drop("_span")
    )
