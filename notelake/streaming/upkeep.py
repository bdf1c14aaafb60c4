"""Change batches, session state and reconcile as streams.

Each function takes a streaming (or batch) DataFrame and returns one; callers choose source, sink and
trigger. Late rows: a session's last time never moves back, a first value is never replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from notelake.operators.state import coalesce_changes, diff_snapshots


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Event times as instants (texts without zone are read in the session's) with a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def settled_changes(events: DataFrame, path: str, gap: str = "750 milliseconds", late: str = "10 minutes") -> DataFrame:
    """Batches of distinct changed paths, released after a quiet gap."""
    return coalesce_changes(_timed(events, late), path, gap)


def session_state(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """First and last time and number of events of each session, for update mode."""
    return _timed(events, late).groupBy("session").agg(F.min("ts").alias("opened_at"), F.max("ts").alias("last_seen_at"), F.count("*").alias("events"))


def first_given(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key, whatever arrives later."""
    return _timed(events, late).dropDuplicatesWithinWatermark(keys)


def reconcile_stream(changes: DataFrame, state_path: str, checkpoint: str, after: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Index each micro-batch against the last snapshot, then hand what changed to ``after``.

    Snapshots are directories numbered by batch, so a batch that is run again writes the same one.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        current = batch.groupBy("concept_id").agg(F.max_by(F.struct("path", "content_hash"), "ts").alias("x")).select("concept_id", "x.*")
        try:
            old = spark.read.schema(current.schema).parquet(f"{state_path}/{batch_id - 1}") if batch_id else current.limit(0)
        except Exception as missing:
            raise RuntimeError(f"snapshot {batch_id - 1} is missing under {state_path}") from missing
        seen = old.join(current.select("concept_id"), "concept_id", "left_semi")
        after(diff_snapshots(seen, current).filter("change <> 'unchanged'"), batch_id)
        old.join(current.select("concept_id"), "concept_id", "left_anti").unionByName(current).write.mode("overwrite").parquet(f"{state_path}/{batch_id}")

    return changes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(run).start()
