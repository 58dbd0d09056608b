"""Sources: sharded JSON lines, one document a file, fenced blocks, labels without a header, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of all shards under ``path``; blank lines are skipped. Bad lines keep their text in ``_bad``."""
    return spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file, with the file's name."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def missing_documents(state: DataFrame, docs: DataFrame) -> DataFrame:
    """Complete entries of a state table (file, status) whose document isn't there."""
    return state.where("status = 'complete'").join(docs.select("file").distinct(), "file", "left_anti")


def fenced_blocks(spark: SparkSession, path: str, language: str, schema: str) -> DataFrame:
    """Rows of the fenced blocks of a language in Markdown files."""
    text = spark.read.text(path, wholetext=True)
    block = F.explode(F.regexp_extract_all("value", F.lit(rf"(?s)```{language}\n(.*?)```"), F.lit(1)))
    line = F.explode(F.split(F.col("b"), "\n"))
    return text.select(block.alias("b")).select(line.alias("line")).where(F.length(F.trim("line")) > 0).select(F.from_json("line", schema).alias("r")).select("r.*")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels (id, code) of a CSV without header."""
    return spark.read.schema("id int, code string").csv(path)


def cataloged(spark: SparkSession, manifest: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the shards that a manifest {"shards": [{"path", "rows"}]} names, and the shards whose count differs."""
    listed = spark.read.schema("shards array<struct<path:string,rows:long>>").option("multiLine", True).json(manifest).select(F.explode("shards").alias("s")).select("s.*")
    folder = manifest.rsplit("/", 1)[0]
    paths = [f"{folder}/{r['path']}" for r in listed.collect()]  # a manifest is a short list
    rows = spark.read.schema(schema).json(paths).withColumn("shard", F.element_at(F.split(F.input_file_name(), "/"), -1))
    counts = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("found"))
    off = listed.join(counts, F.col("path") == F.col("shard"), "left").where(~F.col("rows").eqNullSafe(F.coalesce("found", F.lit(0)))).select("path", "rows", "found")
    return rows, off


def wanted(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Only the wanted rows; an error if any is missing."""
    lost = ids.select(key).distinct().join(rows.select(key), key, "left_anti").limit(5).collect()
    if lost:
        raise KeyError(f"missing: {[r[0] for r in lost]}")
    return rows.join(ids.select(key).distinct(), key, "left_semi")
