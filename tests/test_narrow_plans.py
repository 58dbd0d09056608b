"""What queries read and shuffle, and texts whose numbers are long."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from delibera.functions import text as T

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["j25_coverage", "j7_p10_p11_exists", "j2_composite_join", "v13_recall", "v5_p13_declared_counts"])
def test_no_text_is_read_for_ids(spark, name):
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not any(c in plan for c in ("content_text", "content_json", "submission_json", "replies_json"))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["g33_icc", "g22_gauntlet", "f_p23_first_present"])
def test_texts_stay_behind(spark, name):
    """What is derived from a text is shuffled, the text isn't; and JSON isn't read."""
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "content_json" not in "".join(line for line in plan.splitlines() if "Relation" not in line)
    assert "content_text" not in "".join(line for line in plan.splitlines() if "Aggregate" in line)


def test_numbers_keep_all_digits(spark):
    row = spark.range(1).select(
        *[T.padded(F.lit(n), k).alias(f"x{n}") for n, k in [(7, 2), (100, 2), (999, 3), (1000, 3)]],
        T.padded(F.lit(None).cast("int"), 2).alias("none"),
        T.numbered_lines(F.array_join(F.array_repeat(F.lit("a"), 1001), "\n"), "M").alias("lines"),
        T.line_references(F.lit("M-x:L999-L1001")).alias("refs"),
    ).first()
    assert tuple(row)[:5] == ("07", "100", "999", "1000", None)
    assert row.lines.split("\n")[999:] == ["[M:L1000] a", "[M:L1001] a"]
    assert row.refs == ["M-x:L999", "M-x:L1000", "M-x:L1001"]


def test_times_are_instants(spark):
    texts = ["2024-05-27 15:58:35.964", "2024-05-27T15:58:35Z", "2024-05-27T17:58:35+02:00", "soon", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.instant_of(F.col("t"))).collect()]
    assert got == [1716825515964, 1716825515000, 1716825515000, None, None]
