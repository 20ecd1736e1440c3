"""Event time: windows as batch or stream, deduplication within a watermark, and latest state by key.

Each function takes any DataFrame, batch or streaming; on a batch a watermark changes nothing, so the results of the
two can be compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, schema, time_col: str = "ts", late: str = "1 hour") -> DataFrame:
    """A stream of Parquet files with a watermark on event time (timestamps without zone are read as UTC)."""
    return watermarked(spark.readStream.schema(schema).parquet(folder), time_col, late)


def watermarked(df: DataFrame, time_col: str = "ts", late: str = "1 hour") -> DataFrame:
    return df.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late)


def tumbling(df: DataFrame, width: str, keys: list[str], time_col: str = "ts", value: str = "value") -> DataFrame:
    """Counts and sums per window and key."""
    g = df.groupBy(F.window(time_col, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sliding(df: DataFrame, width: str, step: str, keys: list[str], time_col: str = "ts", value: str = "value") -> DataFrame:
    g = df.groupBy(F.window(time_col, width, step).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(df: DataFrame, gap: str, keys: list[str], time_col: str = "ts") -> DataFrame:
    """Sessions of each key, ended by a gap without events."""
    g = df.groupBy(F.session_window(time_col, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(*keys, F.col("w.start").alias("session_start"), "n")


def deduplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first event of each key; a stream keeps its state only within the watermark."""
    return df.dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


STATE = "user_id long, n long, last_type string"


def latest_state(df: DataFrame, key: str = "user_id") -> DataFrame:
    """Running number of events and the last event type of each key, as a stateful stream operator."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, at, kind = state.get if state.exists else (0, "", "")
        for b in batches:
            n += len(b)
            last = b.sort_values(["ts", "event_id"]).iloc[-1]
            if str(last["ts"]) >= at:
                at, kind = str(last["ts"]), last["event_type"]
        state.update((n, at, kind))
        yield pd.DataFrame({"user_id": [k[0]], "n": [n], "last_type": [kind]})

    return df.groupBy(key).applyInPandasWithState(update, STATE, "n long, at string, kind string", "update", GroupStateTimeout.NoTimeout)


def upsert_sink(df: DataFrame, folder: str, keys: list[str], order: list[str], checkpoint: str):
    """Writes each micro-batch as a generation that holds the latest row of each key; repeated batches change nothing."""
    from tessera.operators.records import latest
    from tessera.sources import generations

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = generations.current(spark, folder)
        new = latest(batch if old is None else old.unionByName(batch), keys, order)
        generations.write(new, folder, f"batch-{number}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")


def last_batch(df: DataFrame, folder: str, checkpoint: str):
    """A sink that keeps the complete result of the last micro-batch, written whole."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(folder)

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("complete")
