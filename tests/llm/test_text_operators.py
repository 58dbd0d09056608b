import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from delibera.llm import clusters as CL
from delibera.llm import conversations as C
from delibera.llm import leakage as L
from delibera.llm import packing as P
from delibera.llm import reading as R
from delibera.llm import truncation as T

NOTE = "note_id string, forum_id string, replyto string, role string, cdate long, mdate long, content_text string, bits int, signature string"


def conversations(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, None) for r in rows], NOTE)
    return {(r.conv_id, r.turn, r.note_id) for r in C.conversations(df, **kw).collect()}


MS = 1_600_000_000_000
WHOLE = [
    ("a", "f", None, "Reviewers", MS, 1, "Hello"),
    ("b", "f", "a", "author", MS // 1000 + 5, 1, "Answer"),
    ("b", "f", "a", "author", MS // 1000 + 5, 3, "Answer, edited"),
    ("c", "f", "?id=f&noteId=b", "AC", None, MS + 9000, " ​ "),
    ("d", "f", " c ", "Area Chair", (MS + 9000) * 1000, 1, "Late"),
]


def test_conversation_is_rebuilt(spark):
    want = {("a", 1, "a"), ("a", 2, "b"), ("a", 3, "d")}
    assert conversations(spark, WHOLE) == want
    assert conversations(spark, WHOLE, reach=2, block=3) == want


@pytest.mark.parametrize(
    "bad",
    [
        ("x", "f", "a", "author", 0, None, "no time"),
        ("x", "f", "a", "author", MS - 5, 1, "earlier"),
        ("x", "f", "a", "n/a", MS + 1, 1, "no role"),
        ("x", "f", "a", None, MS + 1, 1, "no role"),
    ],
)
def test_broken_ones_are_left_out(spark, bad):
    assert conversations(spark, [*WHOLE, bad]) == set()


def test_unanswered_ones_are_left_out(spark):
    rows = [("a", "f", "", "reviewer", MS, 1, "x"), ("b", "f", "a", "Reviewers", MS, 1, "y"), ("h", "g", None, "author", MS, 1, None), ("i", "g", "h", "reviewer", MS, 1, "z"), ("o", "f", "gone", "author", MS, 1, "q"), (None, "f", None, "author", MS, 1, "q")]
    assert conversations(spark, rows) == set()
    assert conversations(spark, []) == set()


NAMES = [a + b + c for a in ("Bal", "Kel", "Mor", "Tas", "Vel") for b in ("ber", "cim", "dor", "lun") for c in ("ato", "enix", "ura", "yst", "ola")]


def interleaved(seed=3, threads=12, size=7):
    """Notes of several threads told alternately in two channels, each answer with a name or number of what it answers; and the true parents."""
    rng, rows, truth, now = random.Random(seed), [], {}, MS
    for forum in ("f", "g"):
        fresh = iter(rng.sample([f"{n}{m}" for n in NAMES for m in ("", "mo")], 2 * threads * size))
        open_ = [[] for _ in range(threads)]
        left = [t for t in range(threads) for _ in range(size)]
        rng.shuffle(left)
        for k, t in enumerate(left):
            now += rng.randint(60_000, 3_600_000)
            names = [next(fresh).capitalize(), str(rng.randint(1000, 99999))]
            node, past = f"{forum}{k:03d}", open_[t]
            text = f"we saw {names[0]} at {names[1]}"
            if past:
                parent = rng.choice(past[-2:])
                truth[node] = parent[0]
                text += f", as for {rng.choice(parent[1])} I would say no"
            past.append((node, names))
            rows.append((node, forum, None, rng.choice(["author", "reviewer"]), now, 1, text, 1, None))
    return rows, truth


def test_parents_are_found_without_links(spark):
    """With every link hidden the likeliest candidates are the planted parents, whatever the blocks."""
    rows, truth = interleaved()
    for block in (8192, 96):
        got = {r.note_id: r.parent_id for r in C.likely_parents(spark.createDataFrame(rows, NOTE)).collect()} if block == 8192 else {
            r.node: r.guess for r in C.guessed_parents(C.notes_of(spark.createDataFrame(rows, NOTE)), 64, block).collect()
        }
        assert sum(got.get(n) == p for n, p in truth.items()) >= 0.9 * len(truth)


def test_a_named_note_outweighs_the_rest_and_a_wrong_name_doesnt(spark):
    """The link is one feature among the others: it wins where the note is there, else time, names and turns decide."""
    rows, truth = interleaved(4, 3, 5)
    some = sorted(truth)[:6]
    first = {"f": "f000", "g": "g000"}
    shown = [(r[0], r[1], first[r[1]] if r[0] in some[:3] else "gone" if r[0] in some[3:] else None, *r[3:]) for r in rows]
    got = {r.note_id: (r.parent_id, r.named) for r in C.likely_parents(spark.createDataFrame(shown, NOTE)).collect()}
    assert all(got[n] == (first[n[0]], True) for n in some[:3])
    assert all(not got[n][1] and got[n][0] in {r[0] for r in rows} for n in some[3:])


def test_conversations_by_given_links_need_no_scores(spark, monkeypatch):
    """A valid link is the parent whatever the scores, so none are worked out, and no names or writers are read for them."""

    def scored(*_):
        raise AssertionError("a score that can't change the result")

    for f in ("guessed_parents", "hashed_names", "hash_of"):
        monkeypatch.setattr(C, f, scored)
    assert conversations(spark, WHOLE) == {("a", 1, "a"), ("a", 2, "b"), ("a", 3, "d")}


def test_conversations_are_disentangled_where_links_are_lost(spark):
    """The likeliest parents form the conversations: whole threads come back that have no link left, and links that are left decide."""
    rows, truth = interleaved()
    rows = [r[:7] for r in rows]
    top = {r[0]: r[0] for r in rows}
    for node in sorted(truth):  # parents come before their answers
        top[node] = top[truth[node]]
    assert conversations(spark, rows) == set()
    for block in (8192, 96):
        got = {note: conv for conv, _, note in conversations(spark, rows, likely=True, block=block)}
        assert sum(got.get(n) == t for n, t in top.items()) >= 0.9 * len(top)
    assert conversations(spark, WHOLE, likely=True) == conversations(spark, WHOLE)
    # where some links are left and others name notes that are gone, all threads come back the same way
    mixed = [(r[0], r[1], (truth[r[0]] if k % 3 else "gone") if r[0] in truth else None, *r[3:]) for k, r in enumerate(rows)]
    got = {note: conv for conv, _, note in conversations(spark, mixed, likely=True)}
    assert sum(got.get(n) == t for n, t in top.items()) >= 0.9 * len(top)
    alone = {note for _, _, note in conversations(spark, mixed)}
    assert len(alone) < 0.9 * len(top)


def brute_window(doc_words, item_words, exact=12, loose=24):
    best = False
    for a in range(len(doc_words)):
        for k in range(len(item_words)):
            n = min(len(doc_words) - a, len(item_words) - k)
            same = [doc_words[a + j] == item_words[k + j] for j in range(n)]
            for s in range(n):
                for e in range(s + exact, n + 1):
                    miss = same[s:e].count(False)
                    if miss == 0 or (e - s >= loose and miss * 8 <= e - s and same[s] and same[e - 1]):
                        best = True
    return best


VOCAB = [f"{a}{b}{c}" for a in ("ka", "mo", "ti", "ru") for b in ("ben", "dor", "lis", "fam") for c in ("", "s", "ek")]


def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice(VOCAB) for _ in range(rng.randint(20, 50)))) for i in range(6)]
    docs, want = [], set()
    for d in range(60):
        words = [rng.choice(VOCAB) for _ in range(30)]
        i, text = rng.choice(items)
        part = text.split()
        a, n = rng.randint(0, 8), rng.choice([8, 11, 12, 14, 24, 32])
        piece = part[a : a + n]
        for _ in range(rng.choice([0, 0, 1, 3, 4])):
            if len(piece) > 2:
                piece[rng.randrange(1, len(piece) - 1)] = "zzz" + rng.choice(VOCAB)
        words[10:10] = piece
        want |= {(d, j) for j, t in items if brute_window(words, t.split())}
        docs.append((d, " ".join(words), 0))
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id long")
    it = spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string")
    got = {tuple(r) for r in L.found_leaks(df, it).collect()}
    assert got == want and len(want) > 15
    small = {(r[0], r[1]) for r in L.leaked_spans(df, it, shard_chars=700).collect()}
    assert small == want


PASSAGE = "Only nine of the forty lab diaries reached the old mint on paper, where seven desk officers saw split votes vanish"


def test_leaks_in_disguise(spark):
    wording = "Which of the following statements best describes the main concern that the careful reviewer raises about this study?"
    items = [(1, f"{PASSAGE}. {wording}"), (2, f"Something else is told in this one, of no interest to anybody who reads it. {wording}"), (3, f"Short. {wording}"), (3, None)]
    loud = PASSAGE.upper().replace("LAB", "LA​B").replace("DIARIES", "DIA-\n> RIES")
    wide = "".join(chr(ord(c) + 0xFEE0) if c.isalpha() else c for c in PASSAGE).replace("ｏｌｄ", "**ｏｌｄ**")
    split = PASSAGE.replace("officers", "offi\ncers").replace("nine", "<b>nine</b>").replace("votes", "vótes")
    docs = [(1, f"Before. {loud} After."), (2, wide), (3, split), (4, f"We ask: {wording}"), (5, " ".join(PASSAGE.split()[:11])), (6, None), (7, ""), (8, "x " * 5000 + PASSAGE)]
    got = {tuple(r) for r in L.found_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (8, 1)}
    spans = L.removal_spans(spark.createDataFrame(docs[-1:], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(r.first_char, r.last_char) for r in spans] == [(10000, 10000 + len(PASSAGE) - 1)]
    assert L.found_leaks(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(2, 5), min_size=1, max_size=60), st.lists(st.lists(st.integers(2, 5), min_size=1, max_size=5), min_size=1, max_size=4))
def test_index_finds_every_occurrence(text, patterns):
    t = np.array([*text, L.GAP, L.END], dtype=np.uint8)
    order = L.suffix_array(t)
    assert list(order) == sorted(range(len(t)), key=lambda i: bytes(t[i:]))
    index = L.FMIndex(t, every=4)
    padded = np.zeros((len(patterns), 5), np.uint8)
    for j, p in enumerate(patterns):
        padded[j, : len(p)] = p[::-1]
    low, high = index.search(padded, np.array([len(p) for p in patterns]))
    for p, a, b in zip(patterns, low, high):
        want = [i for i in range(len(text)) if text[i : i + len(p)] == p]
        assert sorted(index.locate(np.arange(a, max(a, b)))) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80))
def test_packing_holds(sizes):
    sizes = np.array(sizes, dtype=np.int64)
    where = P.pack(sizes, 100)
    if not len(sizes):
        return
    fill = np.bincount(where, weights=sizes)
    assert (where >= 0).all() and fill.max() <= 100 and (fill > 0).all()
    assert all((sizes[where == b] * 3 > 100).sum() <= 2 for b in range(len(fill)))
    assert len(fill) <= max(1, 2 * -(-sizes.sum() // 100))


def test_containers_hold_every_token(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(VOCAB) for _ in range(rng.choice([3, 40, 200, 900]))), 1) for i in range(40)] + [(90, None, 1), (91, " ", 1), (None, "x", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, tokens long")
    rows = P.containers(df, capacity=256, group_docs=15).collect()
    counts = {r.doc_id: r.tokens for r in P.token_counts(df).collect()}
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + r.tokens
        if r.container_id:
            by_bin[r.container_id] = by_bin.get(r.container_id, 0) + r.tokens
        if r.part:
            assert counts[r.doc_id] > 256 and r.first_token == r.part * 256
    assert by_doc == counts and counts[90] == counts[91] == 0
    assert max(by_bin.values()) <= 256 and sum(by_bin.values()) / (256 * len(by_bin)) > 0.9


def test_cut_texts(spark):
    rng = random.Random(2)
    body = lambda: "## Reasoning\n" + " ".join(f"The {rng.choice(VOCAB)} {rng.choice(VOCAB)} of the {rng.choice(VOCAB)} remains {rng.choice(VOCAB)}." for _ in range(rng.randint(5, 14)))
    memos, calls, want = [], [], set()
    for i in range(400):
        job, text, reason = f"j{i}", body(), "stop"
        tail = rng.choice(["\n\nConfidence: low", "\n\n**Evidence:** M-abc:L010-L024", "\n\n| R1 | firm |", "\n\n> “We will revise”", "", "\n\n```\nx = 1\n```", "\n\n- forum thread 9"])
        text += tail
        tokens = len(text) // 4
        if i % 8 == 0:
            text = text[: rng.randint(60, 150)].rstrip(".")
            text = text + rng.choice(["th", " the", " rema"]) if text[-1] != "e" else text + "x y"
            want.add(job)
        elif i % 8 == 1:
            text, tokens, reason = text.split("\n\n")[0], 99, "length"
            want.add(job)
        elif i % 8 == 2 and tail:
            reason = "length"
        memos += [(job, "s", "p", text, "M" if i % 2 else "m", None)] * (2 if i % 9 == 0 else 1)
        calls.append((job, "complete", None if i % 50 == 49 else tokens, None, reason, "2024-01-01"))
    memos += [("e1", "s", "p", None, "m", None), ("e2", "s", "p", "  ", "m", None), (None, "s", "p", "cut of", "m", None)]
    m = spark.createDataFrame(memos, "job_id string, stage string, paper_id string, memo string, model string, created_at string")
    c = spark.createDataFrame(calls, "job_id string, status string, completion_tokens int, reasoning_tokens int, finish_reason string, started_at string")
    j = spark.createDataFrame([(r[0], 99) for r in calls], "job_id string, max_tokens int")
    got = {r[0] for r in T.found_cuts(m, c, j).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 2, (want - got, got - want)
    rates = T.cut_rates(m, c, j).collect()
    assert sum(r.memos for r in rates) == 400 and {r.model for r in rates} == {"m"}
    assert T.found_cuts(m.limit(0), c, j).count() == 0


def test_hazard_peaks(spark):
    rng = random.Random(1)
    rows = [("chars", "m", rng.randint(300, 1500)) for _ in range(3000)] + [("chars", "m", 1000)] * 60
    peaks = T.hazards(spark.createDataFrame(rows, "measure string, stratum string, length long")).collect()
    assert [r.length for r in peaks] == [1000]


def test_clusters(spark):
    rng = random.Random(4)
    matters = {
        1: (["learning rate schedule", "step size tuning", "warmup schedule"], ["The step size decides convergence.", "A schedule was never tuned."]),
        2: (["image collections", "dataset breadth", "toy datasets"], ["Few datasets prove little.", "Broader collections are needed."]),
        3: (["proof of the lemma", "lemma inequality", "missing derivation"], ["The inequality is unjustified.", "The derivation has a gap."]),
        9: (["figure captions", "axis labels", "unreadable plots"], ["Plots must stand alone.", "Labels are tiny."]),
    }
    rows, want = [], {}
    for pk in range(1200):
        c = rng.choice(list(matters))
        objects, reasons = matters[c]
        a, b = rng.choice(objects), rng.choice(reasons)
        a = a.upper() if pk % 11 == 0 else a + rng.choice(["", f" and {rng.choice(objects)}", " of Zanturix"])
        rows.append((pk, None if pk % 13 == 0 else a, None if pk % 17 == 0 and pk % 13 else b, "x"))
        if c != 9:
            want[pk] = c
    rows += [(5000, None, " ", "x"), (None, "lemma", "x", "x"), rows[3]]
    u = spark.createDataFrame(rows, "unit_pk long, inspected_object string, reasoning string, cluster string")
    e = spark.createDataFrame([(c, matters[c][0]) for c in (1, 2, 3)], "cluster_id int, exemplars array<string>")
    got = {r.unit_pk: r.cluster_id for r in CL.found_matters(u, e, clusters=12).collect()}
    assert sum(got.get(k) == c for k, c in want.items()) >= 0.97 * len(want)
    assert sum(k not in want for k in got) <= 0.02 * len(want)
    d = CL.described_clusters(u, clusters=4).collect()
    assert sum(r["size"] for r in d) == 1200 and all(r.exemplars for r in d)
    assert CL.found_matters(u.limit(0), e).count() == 0


def test_tree_keeps_every_row():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, CL.DIM)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = CL.FeatureTree(entries=40)
    tree.add(np.ones(3000), x, (x**2).sum(1))
    assert len(tree.n) <= 40 and tree.n.sum() == 3000 and np.allclose(tree.sum.sum(0), x.sum(0), atol=1e-2)


EASY = ["The cat sat on the mat.", "We went to the big red shop.", "My dog ran fast to me.", "He had a small box of toys.", "It was fun, and we had cake."]
HARD = ["The characterization of the heteroscedastic decomposition necessitates an epistemologically indeterminate reinterpretation, notwithstanding its considerable methodological heterogeneity.", "Consequently, the evaluative inference presupposes an unarticulated commensurability assumption, insofar as the underlying optimization operator satisfies appropriate compatibility conditions."]
MIDDLE = ["It is not always easy to see how the students compared the written answer before anyone had looked at the training pictures in detail.", "Many people believe that several readers should have described the main experiment, which made the whole story easier to follow."]


def reading_docs():
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(240):
        level, pool, n = rng.choice([(1, EASY, 16), (2, MIDDLE, 6), (4, HARD, 5)])
        s = [rng.choice(pool) for _ in range(n)]
        text = rng.choice(["## Review\n\n" + " ".join(s), "\n".join(f"- {x}" for x in s), "\n".join(x.rstrip(".") for x in s), "Summary:\n" + " ".join(s) + "\n\n[1] A et al., vol. 6."])
        rows.append((i, text, level))
        if i % 3 == 0:
            labels.append((i, "a", level))
    return rows, labels


def test_reading_levels(spark):
    rows, labels = reading_docs()
    extra = [(900, None, 0), (901, "", 0), (902, "The cat sat.", 0), (903, "Die Katze ist nicht im Haus und der Hund ist auf dem Weg zu den Kindern. " * 10, 0), (904, "```\nthe cat sat on the mat\n```\n" * 20, 0)]
    df = spark.createDataFrame([(d, t, "x") for d, t, _ in rows + extra], "doc_id long, text string, level string")
    lab = spark.createDataFrame([*labels, labels[0], (900, "a", 1), (1, "b", None)], "doc_id long, rater string, grade_level int")
    got = {r[0] for r in R.found_easy(df, lab).collect()}
    assert got == {d for d, _, level in rows if level == 1}
    held_out = {r.doc_id: r.level for r in R.levels(df, lab).where("doc_id % 3 != 0 AND level IS NOT NULL").collect()}
    true = {d: level for d, _, level in rows}
    assert np.mean([abs(held_out[d] - true[d]) < 0.5 for d in held_out if d in true]) > 0.95
    assert {r.doc_id for r in R.levels(df, lab).where("level IS NULL").collect()} >= {900, 901, 902, 903, 904}
    assert R.found_easy(df, lab.limit(0)).count() == 0


def test_pools_rise():
    at, level = R.isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([1.0, 3, 2, 2, 4]))
    assert list(level) == sorted(level) and list(at) == sorted(at)


def test_prose_only():
    text = "# Title\n\nFirst line goes on\nand ends here. Second one.\n- item one\n- item two\n\n```\ncode here\n```\n| a | b |\n[1] Ref et al., vol. 3."
    assert R.sentences(text) == ["First line goes on and ends here.", "Second one.", "item one", "item two"]


def test_classes_of_cuts_are_fitted():
    """Planted classes come back from unlabelled counts: cuts at a token limit end with sentences too, whole texts don't run out."""
    rng = np.random.default_rng(2)
    kinds = rng.choice(4, 6000, p=[0.88, 0.03, 0.04, 0.05])
    chance = np.array([30.0, 80.0, 10.0, 880.0])
    cells = np.zeros((6000, 5), int)
    for i, k in enumerate(kinds):
        shape = rng.choice(4, p=chance / chance.sum()) if k else rng.choice([0, 1], p=[0.6, 0.4])
        cells[i] = (shape, rng.random() < (0.9 if k == 3 else 0.01), 2 if rng.random() < 0.05 else rng.random() < (0.95 if k == 3 else 0.03), k == 1, rng.integers(3, 7) if k in (1, 2) else rng.integers(9, 12))
    rows, at, n = np.unique(cells, axis=0, return_inverse=True, return_counts=True)
    share = T.classes(rows, n.astype(float), chance)[at.ravel()]
    cut = 1 - share[:, 0] > 0.5
    assert (cut == (kinds > 0)).mean() > 0.99
    between = (cells[:, 0] == 1) & (kinds == 3)
    assert (share[between, 3] > 0.5).mean() > 0.8
    assert T.classes(np.zeros((0, 5), int), np.zeros(0), chance).shape == (0, 4)


def test_long_documents_are_indexed_in_pieces(spark):
    """A document of many shards has an index of bounded size for each piece, and the passages of the whole."""
    rng = random.Random(8)
    item = [rng.choice(VOCAB) + str(rng.randrange(99)) for _ in range(40)]
    words = [rng.choice(VOCAB) for _ in range(9000)]
    for at in (0, 3000, 4500, 9000):
        words[at:at] = item
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(item[:20]) + " and more"), (3, "short")], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    whole, cut = ({tuple(r) for r in L.leaked_spans(docs, items, shard_chars=n).collect()} for n in (1_500_000, 2_000))
    assert whole == cut and len(whole) == 5
    longest = sum(map(len, item))
    sizes = [len(codes) for _, codes in L._pieces(L.Squeezed(" ".join(words)), 2_000, 2 * longest + 64)]
    assert max(sizes) <= 2_000 + 2 * longest + 64 and len(sizes) > 10


def test_runs_of_replaced_words_are_bridged():
    """Five replaced words in a row end no passage of an item long enough to have them."""
    words = [f"w{i}" for i in range(60)]
    items = L.Items([(1, " ".join(words))])
    text = words[:30] + ["zz"] * 5 + words[35:]
    doc = L.Squeezed(" ".join(text))
    i, places, kept = L.aligned(doc, items.words[0], doc.bytes.find(b"".join(items.words[0][:6])), 0, 6)
    assert i == 0 and len(kept) == 60 and sum(kept) == 55


def test_tokens_of_parts_are_those_of_the_whole():
    """Long runs of blanks and words without spaces count as in one piece."""
    with open(f"{P.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        enc = P.encoding(f.read())
    rng = random.Random(6)
    for text in (" ".join(rng.choice(VOCAB) for _ in range(300)), "a  b" + " " * 90 + "\n\n c" * 40 + "x" * 120 + " y's z", " " * 300, "", "é日 本" * 50):
        parts = list(P.pieces(text, 25))
        assert "".join(parts) == text and sum(len(enc.encode_ordinary(p)) for p in parts) == len(enc.encode_ordinary(text))
