"""Structured Streaming over events and ledgers: windows, sessions, deduplication, a stateful budget.

The batch functions take any frame, so that a stream and a table give the same rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def timed(df: DataFrame, late: str) -> DataFrame:
    """``df`` with its watermark; a stream's event time must be an instant (tables keep their local time)."""
    at = df.withColumn("ts", F.col("ts").cast("timestamp")) if df.isStreaming else df
    return at.withWatermark("ts", late)


def tumbling(df: DataFrame, every: str = "1 day", late: str = "1 day") -> DataFrame:
    w = timed(df, late).groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(df: DataFrame, size: str = "2 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    w = timed(df, late).groupBy(F.window("ts", size, step)).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), "n")


def sessions(df: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    w = timed(df, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(df: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    return timed(df, late).dropDuplicatesWithinWatermark([key]) if df.isStreaming else df.dropDuplicates([key])


LEDGER = "user_id long, spent long, refused long"


def budget(df: DataFrame, cap: int) -> DataFrame:
    """Per user: charges are admitted until the first that would exceed the cap; then the account stays closed."""

    def update(key, frames, state):
        spent, refused, closed = state.get if state.exists else (0, 0, False)
        for pdf in frames:
            for amount in pdf.sort_values(["ts", "event_id"])["amount"]:
                if closed or spent + amount > cap:
                    closed, refused = True, refused + 1
                else:
                    spent += int(amount)
        state.update((spent, refused, closed))
        yield pd.DataFrame({"user_id": [key[0]], "spent": [spent], "refused": [refused]})

    charges = df.select("user_id", "event_id", "ts", F.greatest(F.lit(0), F.floor("value")).cast("long").alias("amount"))
    return charges.groupBy("user_id").applyInPandasWithState(update, LEDGER, "spent long, refused long, closed boolean", "update", "NoTimeout")


def run_to_end(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain what is there (availableNow) into a memory table; meant for tests and small results."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def drain(df: DataFrame, path: str, checkpoint: str) -> None:
    """Process only what is new into a Parquet table; a batch that runs again writes the same folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
