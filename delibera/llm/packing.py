"""Documents packed into containers of a fixed number of tokens.

A document that alone exceeds the capacity is split into full containers and a rest; no other is. Documents above
one third of the capacity (never more than two of them fit) are matched greedily: the largest with the largest that
still fits beside it. Smaller ones, in falling size, go where they leave the least gap, or open a container.

Documents are packed in groups of about ``group_docs`` by the hash of their id. Only the last containers of a group
stay unfilled, so the groups cost next to nothing, and no task ever holds more than a group. With one group
(``group_docs`` beyond the number of documents) all are packed together.

Defined results: a null or blank text has no tokens and gets no container (container_id null, one row); a null id has
no row. Every other token of every text is in exactly one container.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delibera.runtime import cut, spread

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the split pattern that belongs to the public byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_lone_space = re.compile(r"(?<=\S) (?=\S)")


def pieces(text: str, size: int):
    """Parts of about ``size`` characters whose tokens are those of the whole.

    A text is cut only before a space between two characters that are none: by the pattern a token always begins there.
    """
    a = 0
    while len(text) - a > size:
        m = _lone_space.search(text, a + size)
        if m is None:
            break
        yield text[a : m.start()]
        a = m.start()
    yield text[a:]


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken", size: int = 200_000) -> DataFrame:
    """(doc_id, tokens). The vocabulary is read on the driver and sent along; long texts are encoded part by part, with the same tokens."""
    with open(f"{folder}/{name}", "rb") as f:
        vocabulary = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        enc = encoding(vocabulary.value)
        count = lambda text: sum(len(enc.encode_ordinary(p)) for p in pieces(text, size)) if isinstance(text, str) and text.strip() else 0
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": [count(t) for t in pdf["text"]]})

    return spread(documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text"), "doc_id").mapInPandas(run, "doc_id long, tokens long")


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each size (all within the capacity)."""
    order = np.argsort(-sizes, kind="stable")
    where = np.full(len(sizes), -1, dtype=np.int64)
    large = order[sizes[order] * 3 > capacity]
    small = order[sizes[order] * 3 <= capacity]
    gaps: list[int] = []
    free = sorted((int(sizes[i]), int(-k)) for k, i in enumerate(large))
    for k, i in enumerate(large):
        if where[i] >= 0:
            continue
        bin_no, room = len(gaps), int(capacity - sizes[i])
        where[i] = bin_no
        free.pop(bisect_left(free, (int(sizes[i]), -k)))
        j = bisect_right(free, (room, 1)) - 1
        if j >= 0:
            size, mate = free.pop(j)
            where[large[-mate]] = bin_no
            room -= size
        gaps.append(room)
    by_gap: dict[int, list[int]] = {}
    for b, g in enumerate(gaps):
        by_gap.setdefault(g, []).append(b)
    present = sorted(by_gap)
    for i in small:
        size = int(sizes[i])
        at = bisect_left(present, size)
        if at < len(present):
            gap = present[at]
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap]
                present.pop(at)
        else:
            gap, b = capacity, len(gaps)
            gaps.append(capacity)
        where[i], left = b, gap - size
        if left not in by_gap:
            by_gap[left] = []
            insort(present, left)
        by_gap[left].append(b)
    return where


PLACED = "container_id string, doc_id long, part int, first_token long, tokens long"


def _packer(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        group = int(pdf["_g"].iloc[0])
        total = pdf["tokens"].to_numpy(np.int64)
        parts = -(-total // capacity)
        row = np.repeat(np.arange(len(pdf)), parts)
        part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        first = part * capacity
        size = np.minimum(total[row] - first, capacity)
        where = pack(size, capacity)
        return pd.DataFrame(
            {"container_id": [f"{group}-{b}" for b in where], "doc_id": pdf["doc_id"].to_numpy()[row], "part": part.astype(np.int32), "first_token": first, "tokens": size}
        )

    return run


def containers(documents: DataFrame, capacity: int = 2048, folder: str = TOKENIZERS, group_docs: int = 20_000) -> DataFrame:
    """A row for each document, or each part of one that exceeds the capacity: its container and its tokens."""
    counts = cut(token_counts(documents, folder), "tokens")
    groups = max(1, -(-counts.count() // group_docs))
    grouped = counts.where("tokens > 0").withColumn("_g", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    placed = grouped.groupBy("_g").applyInPandas(_packer(capacity), PLACED)
    none = counts.where("tokens = 0").select(F.lit(None).cast("string").alias("container_id"), "doc_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("first_token"), "tokens")
    return placed.unionByName(none)


def container_report(documents: DataFrame, capacity: int = 2048, folder: str = TOKENIZERS) -> DataFrame:
    """How full the containers are, against the fewest that could hold all tokens."""
    by = containers(documents, capacity, folder).where(F.col("container_id").isNotNull()).groupBy("container_id").agg(F.sum("tokens").alias("filled"), F.count(F.lit(1)).alias("items"))
    return by.agg(
        F.count(F.lit(1)).alias("containers"),
        F.sum("items").alias("items"),
        F.sum("filled").alias("tokens"),
        F.ceil(F.sum("filled") / capacity).alias("fewest_possible"),
        (F.sum("filled") / (F.count(F.lit(1)) * capacity)).alias("filled_share"),
        F.max("filled").alias("fullest"),
    )
