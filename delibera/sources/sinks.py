"""Sinks: chunked Parquet, JSON lines, plates, year partitions, size-bounded files, snapshots."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def chunked_parquet(df: DataFrame, path: str, rows: int = 250_000) -> None:
    """Zstandard Parquet of at most ``rows`` rows a file; refuses to overwrite."""
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows).mode("errorifexists").parquet(path)


def json_lines(df: DataFrame, path: str, rows: int = 50_000, most_bytes: int = 1_000_000, file_bytes: int = 450_000_000) -> int:
    """JSON lines, every row of them, in files of at most ``rows`` rows and ``file_bytes`` bytes.

    A line over ``most_bytes`` (or ``file_bytes``) is a file of its own, in a folder ``pack=wide-...``; returns how many
    are over ``most_bytes``. ``path/_manifest.json`` lists lines, bytes and sha256 of each file, a JSON object a line.
    """
    import pandas as pd
    from pyspark import TaskContext

    def packed(batches):
        task, pack, wide, used, held = TaskContext.get().partitionId(), 0, 0, 0, 0
        for pdf in batches:
            names = []
            for v in pdf["value"]:
                size = len(v.encode("utf-8")) + 1  # with the line's end
                if size - 1 > most_bytes or size > file_bytes:
                    names.append(f"wide-{task:05d}-{wide:05d}")
                    wide += 1
                    continue
                if held and (held >= rows or used + size > file_bytes):
                    pack, used, held = pack + 1, 0, 0
                used, held = used + size, held + 1
                names.append(f"{task:05d}-{pack:05d}")
            yield pd.DataFrame({"value": pdf["value"], "pack": names})

    lines = df.select(F.to_json(F.struct("*")).alias("value")).mapInPandas(packed, "value string, pack string")
    # each pack is of one task, so one file; nothing may split or join tasks between packing and writing
    lines.write.partitionBy("pack").option("maxRecordsPerFile", 0).mode("errorifexists").text(path)
    found = _written(df.sparkSession, path)
    spark, jvm = df.sparkSession, df.sparkSession.sparkContext._jvm
    held = spark.read.schema("value string, pack string").text(path).groupBy("pack").agg(F.count(F.lit(1)).alias("lines"), F.max(F.octet_length("value")).alias("longest"))
    counts = {r["pack"]: r for r in held.collect()} if found else {}  # one row a file
    root = jvm.org.apache.hadoop.fs.Path(path)
    out = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(jvm.org.apache.hadoop.fs.Path(root, "_manifest.json"), False)
    try:
        for name, size, digest in found:
            out.write(bytearray((json.dumps({"path": name, "lines": counts[name.split("/")[0][5:]]["lines"], "bytes": size, "sha256": digest}) + "\n").encode()))
    finally:
        out.close()
    return sum(r["longest"] > most_bytes for r in counts.values())


def _written(spark: SparkSession, path: str) -> list[tuple[str, int, str]]:
    """(path below ``path``, bytes, sha256) of each data file, read as a stream."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for folder in fs.listStatus(root):
        for f in fs.listStatus(folder.getPath()) if folder.isDirectory() else []:
            stream = fs.open(f.getPath())
            try:
                digest = jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
            finally:
                stream.close()
            out.append((f"{folder.getPath().getName()}/{f.getPath().getName()}", f.getLen(), digest))
    return sorted(out)


def publish(df: DataFrame, path: str) -> None:
    """Write a table beside ``path`` and put it there by one rename: readers see the old table or the whole new one.

    A failed write leaves the old table; what was there before stays as ``path.before`` until the next publication.
    """
    jvm = df.sparkSession.sparkContext._jvm
    at, staged, before = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.staged", f"{path}.before"))
    fs = at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    df.write.option("compression", "zstd").mode("overwrite").parquet(f"{path}.staged")
    if fs.exists(at):
        fs.delete(before, True)
        if not fs.rename(at, before):
            raise OSError(f"{path} can't be moved")
    if not fs.rename(staged, at):
        raise OSError(f"{path}.staged can't be moved to {path}")


def rebuild_partitions(df: DataFrame, path: str, *columns: str) -> None:
    """Replace the partitions that ``df`` has rows of, and leave the others. A failed write leaves the old files."""
    df.write.partitionBy(*columns).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def plate(df: DataFrame, key: str, value: list[str]) -> DataFrame:
    """A small result as one row with one JSON object, keys sorted."""
    entry = F.struct(F.col(key).cast("string").alias("k"), F.to_json(F.struct(*value)).alias("v"))
    return df.agg(F.sort_array(F.collect_list(entry)).alias("e")).select(F.concat(F.lit("{"), F.array_join(F.transform("e", lambda x: F.concat(F.to_json(F.struct(x["k"].alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(x["k"].alias("k")))) - 6), F.lit(":"), x["v"])), ","), F.lit("}")).alias("json"))


def island(payload: object, element: str) -> str:
    """A script element that carries JSON safely within HTML."""
    return f'<script type="application/json" id="{html.escape(element)}">{json.dumps(payload, ensure_ascii=False).replace("</", "<" + chr(92) + "/")}</script>'


def markdown_lines(df: DataFrame, order: list) -> DataFrame:
    """The lines of a Markdown table of all rows, as rows (line) in the order of ``order`` below the two of the head."""
    cell = lambda c: F.replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\s+", " "), F.lit("|"), F.lit(r"\|"))
    body = df.orderBy(*order).select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in df.columns]), F.lit(" |")).alias("line"))
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return df.sparkSession.createDataFrame([(h,) for h in head], "line string").coalesce(1).union(body)


def markdown_table(df: DataFrame, order: list, most: int = 10_000) -> str:
    """A Markdown table of all rows as one text, for reports; an error beyond ``most`` rows, which ``markdown_lines`` writes."""
    lines = markdown_lines(df, order).limit(most + 3).collect()
    if len(lines) > most + 2:
        raise ValueError(f"more than {most} rows; write them with markdown_lines")
    return "\n".join(r["line"] for r in lines)


def snapshot(spark: SparkSession, source: str, folder: str, name: str, keep: int = 3) -> int:
    """Copy a table into ``folder/name``, verify count and content hash, and drop all but the last ``keep`` copies."""
    src = spark.read.parquet(source)
    target = f"{folder}/{name}"
    src.write.mode("errorifexists").parquet(target)
    digest = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    if digest(src) != digest(spark.read.parquet(target)):
        raise OSError(f"{target} differs from its source")
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory())
    for old in names[:-keep]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{folder}/{old}"), True)
    return len(names[-keep:])
