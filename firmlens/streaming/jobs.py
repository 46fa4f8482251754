"""Structured Streaming: idempotent saves, liveness and live progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from firmlens.sources.store import FirmStore, insert_absent


def save_stream(rows: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Each batch inserts what isn't stored yet, so that a batch that runs again after a failure adds nothing. It reads only the buckets of its own keys."""
    return rows.writeStream.foreachBatch(lambda df, _: insert_absent(df, path, keys, keys[0])).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def save_results_stream(results: DataFrame, store: FirmStore, name: str, checkpoint: str, tier_filter: str = "all") -> StreamingQuery:
    """Firms with their members and portfolio inside, saved in one go for each micro-batch. `name` is the stream's: a micro-batch that runs again
    after a failure replaces what it wrote."""
    return results.writeStream.foreachBatch(lambda df, i: store.save_results(f"{name}-{i}", df, tier_filter)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def liveness(beats: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of heartbeats: a job was alive from start to end and silent for `gap` after it. beats: job_id, ts."""
    return beats.withWatermark("ts", late).groupBy("job_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("beats")).select("job_id", F.col("session_window.start").alias("alive_from"), F.col("session_window.end").alias("silent_at"), "beats")


def progress(logs: DataFrame) -> DataFrame:
    return logs.groupBy("job_id", "status").agg(F.count(F.lit(1)).alias("n"))
