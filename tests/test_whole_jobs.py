"""The whole job of each operator: nothing left out by year, field, kind, size or key."""

import datetime
import json

import duckdb
import pytest
from pyspark.sql import functions as F

NOTE = "year int, note_id string, forum_id string, replyto string, kind string, role string, signature string, cdate bigint, mdate bigint, invitations_json string, content_json string, content_text string"
FORUM = "year int, forum_id string, api_version string, submission_json string, replies_json string, reply_count int, fetched_at string"
DAY, BASE = 86_400_000, 15_000  # small stamps count as seconds


def tables(spark, folder, **frames):
    for name, (rows, schema) in frames.items():
        names = [c.split()[0] for c in schema.split(", ")]
        spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def same_as_sql(name, df, folder):
    import __spark_entry__ as entry

    c = duckdb.connect()
    for t in ("messages", "forums", "units"):
        if (folder / f"{t}.parquet").exists():
            c.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    want = c.execute(entry.oracle_sql()[name])
    columns = [x[0] for x in want.description]
    assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, want.fetchall()))


def test_season_has_all_years_submissions_and_window(spark, tmp_path):
    from delibera.plans import corpus

    rows = [(2020, "official_review", 10, 5), (2020, "decision", 12, 5), (2020, "comment", 2, 1), (2020, "comment", 30, 1), (2021, "decision", 400, 6), (2022, "comment", 800, 1)]
    notes = [{"year": y, "note_id": f"{y}{k}{t}-{i}", "forum_id": "f", "kind": k, "cdate": (BASE + t) * DAY} for y, k, t, n in rows for i in range(n)]
    doc = lambda **k: json.dumps(k)
    forums = [{"year": 2021, "forum_id": f"g{i}", "submission_json": json.dumps(doc(cdate=0, tcdate=(BASE + 390) * DAY)) if i else doc(cdate=(BASE + 390) * DAY), "fetched_at": "2021-01-01"} for i in range(5)]
    forums += [{"year": 2021, "forum_id": "g0", "submission_json": '{"cdate":', "fetched_at": "2021-02-01"}, {"year": 2021, "forum_id": "g5", "submission_json": None}]
    d = tables(spark, tmp_path, messages=(notes, NOTE), forums=(forums, FORUM))
    df = corpus.g42_season_series(spark, d)
    day = lambda t: datetime.date(1970, 1, 1) + datetime.timedelta(BASE + t)
    got = {(r.year, (r.day - day(0)).days, r.kind): (r.n, r.dense) for r in df.collect()}
    assert {k: v[0] for k, v in got.items() if v[0]} == {(y, t, k): n for y, k, t, n in rows} | {(2021, 390, "submission"): 5}
    assert sorted({t for (y, t, _), v in got.items() if y == 2020 and v[1]}) == list(range(10, 16))
    assert sorted({t for (y, t, _), v in got.items() if y == 2021 and v[1]}) == list(range(390, 404))
    assert [v[1] for (y, *_), v in got.items() if y == 2022] == [False] * 4
    assert len(got) == 4 * (29 + 14 + 1)
    same_as_sql("g42_season_series", df, tmp_path)


UNIT = "unit_pk bigint, year int, forum_id string, reviewer_key string, inspected_object string, observation string, reasoning string, judgment string, suggested_improvement string"


def test_repeated_texts_of_all_fields_by_review(spark, tmp_path):
    from delibera.plans import mining

    units = [
        {"unit_pk": 1, "forum_id": "f", "reviewer_key": "a", "observation": "No  Code", "judgment": "weak", "reasoning": " "},
        {"unit_pk": 2, "forum_id": "f", "reviewer_key": "b", "observation": "no code ", "reasoning": "weak"},
        {"unit_pk": 3, "forum_id": "g", "reviewer_key": "a", "judgment": "Weak", "suggested_improvement": "add"},
        {"unit_pk": 4, "forum_id": "g", "reviewer_key": "a", "suggested_improvement": "add"},
    ]
    units.append(units[0])
    d = tables(spark, tmp_path, units=(units, UNIT))
    df = mining.g47_g48_field_texts(spark, d)
    assert {tuple(r) for r in df.collect()} == {("observation", "no code", 2, 2, 1, 1, 2), ("judgment", "weak", 2, 2, 2, 1, 3)}
    same_as_sql("g47_g48_field_texts", df, tmp_path)
    places = mining.g47_g48_text_places(spark, d)
    assert {(r.field, r.unit_pk) for r in places.collect()} == {("observation", 1), ("observation", 2), ("judgment", 1), ("judgment", 3)}
    same_as_sql("g47_g48_text_places", places, tmp_path)
    summary = mining.g47_field_summary(spark, d)
    assert {tuple(r) for r in summary.collect()} == {("observation", 2, 1, 1, 2), ("judgment", 2, 1, 1, 2), ("reasoning", 1, 1, 0, 1), ("suggested_improvement", 2, 1, 0, 1)}
    same_as_sql("g47_field_summary", summary, tmp_path)


def test_every_note_gets_line_numbers(spark, tmp_path):
    from delibera.plans import corpus

    texts = {"official_review": "a\n\nb", "comment": "a\r\nb\n", "meta_review": "", "decision": "x\u2028y", "official_comment": "\n".join("l" * 1001), "withdrawal": None}
    notes = [{"year": 2020, "note_id": k, "forum_id": "f", "kind": k, "content_text": t} for k, t in texts.items()]
    d = tables(spark, tmp_path, messages=(notes, NOTE))
    df = corpus.w18_note_lines(spark, d)
    got = {r.note_id: r.numbered for r in df.collect()}
    number = lambda k, t: "\n".join(f"[M-{k}:L{i:03d}] {x}" for i, x in enumerate(t.splitlines() or [""], 1))
    assert got == {k: number(k, t) for k, t in texts.items() if t is not None}
    assert "[M-official_comment:L1001] l" in got["official_comment"]
    same_as_sql("w18_note_lines", df, tmp_path)


def test_hulls_are_of_the_dense_core(spark):
    from delibera.operators import vectors as V

    near = [("a", i, float(i % 10), float(i // 10), "big" if i % 3 else "small") for i in range(100)]
    far = [("a", 100 + i, 1000.0 * (-1) ** i, 500.0 * (-1) ** i, "small") for i in range(10)]
    few = [("b", 200 + i, float(i), float(i * i), "small" if i % 2 else "big") for i in range(6)]
    df = spark.createDataFrame(near + far + few, "k string, id int, x double, y double, c string")
    core = V.dense_core(df, "k", "x", "y", "id")
    mx, my = (sum(r[i] for r in near + far) / 110 for i in (2, 3))
    want = sorted((((r[2] - mx) ** 2 + (r[3] - my) ** 2, r[1]) for r in near + far))[:66]
    assert sorted(r.id for r in core.where("k = 'a'").collect()) == sorted(i for _, i in want)
    assert core.where("k = 'b'").count() == 6 and core.where("id BETWEEN 100 AND 109").count() == 0
    h = V.convex_hulls(core, "k", "x", "y").where("k = 'a'").collect()
    assert all(0 <= r.x <= 9 and 0 <= r.y <= 9 for r in h)
    assert V.dense_core(df.where("id < 60"), "k", "x", "y", "id").count() == 50
    assert {tuple(r) for r in V.majority(df, "k", "c").collect()} == {("a", 110, "big"), ("b", 6, "big")}


def test_hull_query_has_region_size_and_majority(spark, tmp_path):
    import numpy as np

    from delibera.plans import mining

    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=4)], i % 3) for i in range(600)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = mining.m15_hulls(spark, str(tmp_path)).collect()
    assert sum({r.region: r.n for r in got}.values()) == 600 and len({r.region for r in got}) == 22 and {r.label for r in got} <= {0, 1, 2}


def test_classifier_scores_and_predictions(spark):
    from delibera.operators import classify as K

    t = spark.createDataFrame([("It should be clear, without cost",), (None,), ("w " * 90,)], "t string")
    assert [r[0] for r in t.select(K.surface(F.col("t"))).collect()] == [[1, 1, 0, 0, 0, 1, 0, 1, 0.1], [0] * 9, [0] * 8 + [1]]
    pred = spark.createDataFrame([(0, 0.0, 0.0), (0, 0.0, 1.0), (0, 1.0, 1.0), (1, 1.0, 1.0), (1, 2.0, 1.0)], "fold int, label double, prediction double")
    got = {(r.fold, r["class"]): (r.n, r.accuracy, r.f1) for r in K.scores(pred).collect()}
    assert got[None, 0] == (2, None, 0.6667) and got[None, 1] == (2, None, 0.6667) and got[None, 2] == (1, None, 0.0)
    assert got[None, None] == (5, 0.6, 0.4444) and got[1, None] == (2, 0.5, 0.3333)
    rows = [(i, [0.0, 0.0], "must" if i % 2 else "might", float(i % 2) if i < 60 else None) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, v array<float>, t string, label double").select("id", "label", K.features(F.col("v"), F.col("t")).alias("features"))
    every = K.inferred(df, "id")  # the texts alone tell the classes apart
    assert {(r.id, r.prediction) for r in every.collect()} == {(i, float(i % 2)) for i in range(80)}
    assert K.held_out(df, "id").where("label = prediction").count() == 60
    assert {tuple(r) for r in K.crosstab(every, "label").collect()} == {(0.0, 0.0, 30), (1.0, 1.0, 30), (None, 0.0, 10), (None, 1.0, 10)}


def test_json_lines_keep_every_row_within_bounds(spark, tmp_path):
    import hashlib

    from delibera.sources import sinks

    texts = {i: "\u00e9" * (300 if i % 10 == 0 else 20) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "i int, t string").repartition(2)
    path = tmp_path / "out"
    assert sinks.json_lines(df, str(path), rows=7, most_bytes=500, file_bytes=400) == 6
    assert {r.i: r.t for r in spark.read.schema("i int, t string").json(str(path)).collect()} == texts
    files = {str(f.relative_to(path)): f.read_bytes() for f in path.glob("pack=*/*.txt")}
    manifest = [json.loads(x) for x in (path / "_manifest.json").read_text().splitlines()]
    assert {m["path"]: (m["bytes"], m["lines"], m["sha256"]) for m in manifest} == {k: (len(v), v.count(b"\n"), hashlib.sha256(v).hexdigest()) for k, v in files.items()}
    assert all(v.count(b"\n") == 1 if "wide" in k else len(v) <= 400 and v.count(b"\n") <= 7 for k, v in files.items())
    assert sinks.json_lines(df.limit(0), str(tmp_path / "none")) == 0


def test_rows_of_flat_tables_are_unique_over_fetches(spark):
    from delibera.operators import nested as N

    docs = [json.dumps({"t": 1, "a": [{"c": 1, "b": [1]}]}), json.dumps({"t": 1, "a": [{"c": 1, "b": [2, 3]}, {"c": 2, "b": []}]})]
    f = spark.createDataFrame([("f", docs[0]), ("f", docs[1]), ("f", docs[0]), (None, docs[0])], "forum_id string, replies_json string")
    rows = N.flat_tables(f, "replies_json").collect()
    at = {(r.forum_id, r.record, r.table_path, r.row_at) for r in rows}
    assert len(at) == len(rows) and len({r.record for r in rows}) == 2
    assert all(r.parent_path is None or (r.forum_id, r.record, r.parent_path, r.parent_at) in at for r in rows)
    m = spark.createDataFrame([("f", "n", '["x","y"]'), ("f", "n", '["x","y"]'), ("f", "o", '["x"]')], "forum_id string, note_id string, invitations_json string")
    found = N.flat_tables(m, "invitations_json", ("forum_id", "note_id")).where("row_at <> ''").collect()
    assert sorted((r.note_id, r.row_at, json.loads(r.fields)[""]) for r in found) == [("n", "0", "x"), ("n", "1", "y"), ("o", "0", "x")]


def test_records_without_a_year_stay_in_the_unified_table(spark):
    from delibera.operators import drift as D

    doc = lambda **k: json.dumps(k)
    rows = [(2020, "k", f"a{i}", doc(title=f"t{i}")) for i in range(5)] + [(None, "k", "x", doc(title="t", odd=1)), (None, "k", "x", doc(title="t", odd=1)), (None, None, "y", None)]
    df = spark.createDataFrame(rows, "year int, kind string, id string, doc string")
    got = {r.id: r for r in D.unified(spark, df, "messages.content_json", None).collect()}
    assert len(got) == 7 and got["a3"].year == 2020 and got["a3"].f_title == "t3"
    assert (got["x"].year, got["x"].f_title, json.loads(got["x"].other_fields)) == (None, "t", {"odd": 1})
    assert got["y"].year is None and got["y"].f_title is None
