"""Snapshots, findings and sessions: what changed, what is open, what is current."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelake.sources.shared import saved


def diff_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(concept_id, change)`` between ``(concept_id, path, content_hash)``: new, changed, moved, missing."""
    o = old.select("concept_id", F.col("path").alias("old_path"), F.col("content_hash").alias("old_hash"))
    n = new.select("concept_id", F.col("path").alias("new_path"), F.col("content_hash").alias("new_hash"))
    change = (
        F.when(F.col("old_path").isNull(), "new")
        .when(F.col("new_path").isNull(), "missing")
        .when(F.col("old_hash") != F.col("new_hash"), "changed")
        .when(F.col("old_path") != F.col("new_path"), "moved")
        .otherwise("unchanged")
    )
    return o.join(n, "concept_id", "full_outer").select("concept_id", change.alias("change"))


def fingerprint(code, path, message):
    """First 32 hex digits of the SHA-256 of the parts joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\x00", code, F.coalesce(path, F.lit("")), message), 256), 1, 32)


def ledger_reconcile(ledger: DataFrame, current: DataFrame, now: str, examined: DataFrame | None = None) -> DataFrame:
    """The ledger ``(fingerprint, path, detected_at, resolved_at)`` after a run that found ``current``.

    New findings open, open ones that are gone resolve, those still there keep their first time, and a
    finding that comes back is a new row. With ``examined(path)`` only findings of those paths resolve.
    """
    open_rows, closed = ledger.filter("resolved_at is null"), ledger.filter("resolved_at is not null")
    found = current.select("fingerprint", "path").distinct()
    still = open_rows.join(found.select("fingerprint"), "fingerprint", "left_semi")
    gone = open_rows.join(found.select("fingerprint"), "fingerprint", "left_anti")
    kept = None
    if examined is not None:
        kept = gone.join(examined.select("path").distinct(), "path", "left_anti").select(ledger.columns)
        gone = gone.join(examined.select("path").distinct(), "path", "left_semi").select(ledger.columns)
    resolved = gone.withColumn("resolved_at", F.lit(now))
    opened = found.join(open_rows.select("fingerprint"), "fingerprint", "left_anti").select(
        "fingerprint", "path", F.lit(now).alias("detected_at"), F.lit(None).cast("string").alias("resolved_at")
    )
    out = closed.unionByName(still).unionByName(resolved).unionByName(opened)
    return out if kept is None else out.unionByName(kept)


def fold_sessions(events: DataFrame) -> DataFrame:
    """One row per session of ``(session, at, kind, event_id)``: times, whether it was opened and wrapped, and its checkpoints.

    Events are judged by ``reconcile.session_log``: what comes before the opening is refused and does not count.
    """
    from notelake.operators.reconcile import session_log

    times = events.groupBy("session").agg(F.min("at").alias("first_event_at"), F.max("at").alias("last_event_at"), F.count("*").alias("events"))
    judged = session_log(events).groupBy("session").agg(
        F.max(F.col("outcome") == "opened").alias("opened"), F.max(F.col("outcome") == "wrapped").alias("wrapped"), F.count_if(F.col("outcome") == "logged").alias("checkpoints"), F.max("last_seen_at").alias("last_seen_at")
    )
    return times.join(judged, "session")


def expire_sessions(sessions: DataFrame, before: DataFrame) -> DataFrame:
    """Opened sessions without checkpoints that were not wrapped and were last seen before the one row of ``before(before)``."""
    idle = sessions.filter("opened and not wrapped and checkpoints = 0")
    return idle.join(F.broadcast(before), F.col("last_seen_at") < F.col("before")).drop("before")


def given_once(events: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The first value of each key."""
    return events.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(value))


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def coalesce_changes(changes: DataFrame, path: str, gap: str = "750 milliseconds") -> DataFrame:
    """Batches of distinct paths released after a quiet gap: ``(start, end, paths)``; batch or stream.

    A table is cut into ranges of time, sessions are made in each, and those that go on over the ends of
    ranges are put together: one row a range decides, so no task holds all changes.
    """
    # Spark's sessions go on where a change comes just at the end of the gap, which is quiet by then.
    window = F.session_window("ts", f"{gap} -1 microseconds").alias("w")
    end = (F.col("w.end") + F.expr("INTERVAL 1 MICROSECOND")).alias("end")
    if changes.isStreaming:
        session = changes.groupBy(window).agg(F.array_sort(F.collect_set(path)).alias("paths"))
        return session.select(F.col("w.start").alias("start"), end, "paths")
    parts = int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = saved(changes.filter("ts is not null").select("ts", F.col(path).alias("path")).repartitionByRange(parts, "ts").withColumn("range", F.spark_partition_id()), "ranges")
    made = ranged.groupBy("range", window).agg(F.collect_set("path").alias("paths"))
    made = saved(made.select("range", F.col("w.start").alias("start"), end, "paths"), "sessions")
    ends = made.groupBy("range").agg(F.count("*").alias("n"), F.min("start").alias("first"), F.max("start").alias("last"), F.max("end").alias("until"))
    before = Window.orderBy("range")  # a row a range
    lag = lambda column: F.lag(column).over(before)
    # Where a range's first session began: here, in the last session of the range before, or where that one's first session began.
    began = F.when(lag("until").isNull() | (F.col("first") >= lag("until")), F.col("first")).when(lag("n") > 1, lag("last"))
    opened = ends.select("range", "first", began.alias("began")).select("range", "first", F.last("began", ignorenulls=True).over(before).alias("began"))
    joined = made.join(F.broadcast(opened), "range").withColumn("start", F.when(F.col("start") == F.col("first"), F.col("began")).otherwise(F.col("start")))
    whole = joined.groupBy("start").agg(F.max("end").alias("end"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("paths")))).alias("paths"))
    return whole.select("start", "end", "paths")
