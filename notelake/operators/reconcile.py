"""Bringing an index's record in line with a store: the full pass, the pass over changes, and what a change concerns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelake.operators.sizes import broadcast_if_small

_COLUMNS = ("concept_id", "path", "action")


def _first_claims(contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents by the smallest path that claims their identity, and the other claims."""
    placed = contents.withColumn("__n", F.row_number().over(Window.partitionBy("concept_id").orderBy("path")))
    return placed.filter("__n = 1").drop("__n"), placed.filter("__n > 1").drop("__n")


def _actions(read: DataFrame, recorded: DataFrame, changed_only: bool) -> DataFrame:
    """indexed or unchanged, for documents that were read."""
    if not changed_only:
        return read.select("concept_id", "path", F.lit("indexed").alias("action"))
    old = recorded.select("concept_id", F.col("path").alias("old_path"), F.col("content_hash").alias("old_hash"))
    same = F.coalesce((F.col("path") == F.col("old_path")) & (F.col("content_hash") == F.col("old_hash")), F.lit(False))
    return read.join(old, "concept_id", "left").select("concept_id", "path", F.when(same, "unchanged").otherwise("indexed").alias("action"))


def reconcile_full(recorded: DataFrame, contents: DataFrame, changed_only: bool = False) -> DataFrame:
    """``(concept_id, path, action)`` of a pass that reads every document.

    ``recorded(concept_id, path, content_hash, size, modified_at)`` is what the index holds,
    ``contents(path, concept_id, content_hash)`` what the store does. Actions: indexed, unchanged (only with
    ``changed_only``: path and hash as recorded), duplicate (a larger path claims an identity already
    claimed) and removed (recorded and claimed by nobody). Rows without identity or path are no documents.
    """
    held, others = _first_claims(contents.filter("concept_id is not null and path is not null"))
    gone = recorded.join(held.select("concept_id"), "concept_id", "left_anti")
    return (
        _actions(held, recorded, changed_only)
        .unionByName(others.select("concept_id", "path", F.lit("duplicate").alias("action")))
        .unionByName(gone.select("concept_id", "path", F.lit("removed").alias("action")))
    )


def reconcile_settled(recorded: DataFrame, listing: DataFrame, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(concept_id, path, action)`` of the pass that trusts sizes and times.

    A recorded document whose file has the recorded size and time in ``listing(path, size, modified_at)``
    is trusted and not read. ``read`` is given the other paths, one column, and returns their
    ``(path, concept_id, content_hash)``; a path that is no document is left out. Trusted documents keep
    their identity against newcomers; among those read the smallest path has it. A document read with
    path and hash as recorded is unchanged: only its size and time moved. What changes under an unmoved
    size and time is left to the full pass.
    """
    stat = recorded.select("concept_id", "path", "size", "modified_at")
    trusted = stat.join(listing, ["path", "size", "modified_at"]).select("concept_id", "path")
    flagged = listing.select("path").join(trusted.select("path"), "path", "left_anti")
    found = read(flagged).filter("concept_id is not null")
    claimed = trusted.select("concept_id").distinct()
    newcomers = found.join(claimed, "concept_id", "left_anti")
    held, others = _first_claims(newcomers)
    late = found.join(claimed, "concept_id", "left_semi").select("concept_id", "path").unionByName(others.select("concept_id", "path"))
    seen = claimed.union(held.select("concept_id"))
    gone = recorded.join(seen, "concept_id", "left_anti")
    return (
        trusted.select("concept_id", "path", F.lit("unchanged").alias("action"))
        .unionByName(_actions(held, recorded, True))
        .unionByName(late.select("concept_id", "path", F.lit("duplicate").alias("action")))
        .unionByName(gone.select("concept_id", "path", F.lit("removed").alias("action")))
    )


def referrers_to_revisit(links: DataFrame, before: DataFrame, changed: DataFrame) -> DataFrame:
    """``(source)``: documents whose links resolve otherwise after a change.

    ``links(source, target_path, target_name, target_id)`` as resolved before; a link has a path or a name.
    ``before(concept_id, path, names)`` describes the documents that changed or left as they were,
    ``changed(concept_id, path, names)`` those that changed as they are; names are compared without case.
    A link is concerned if what it addresses was lost, or was gained by another document than the one it
    resolves to. Edits that keep path and names concern nobody.
    """

    def addresses(df: DataFrame, owner: str) -> DataFrame:
        every = F.concat(F.array(F.struct(F.lit("path").alias("kind"), F.col("path").alias("at"))), F.transform("names", lambda n: F.struct(F.lit("name").alias("kind"), F.lower(n).alias("at"))))
        return df.select(F.col("concept_id").alias(owner), F.explode(every).alias("a")).select(owner, "a.kind", "a.at").filter("at is not null").distinct()

    was, now = addresses(before, "owner"), addresses(changed, "owner")
    lost = was.join(now, ["owner", "kind", "at"], "left_anti").select("kind", "at").distinct().withColumn("lost", F.lit(True))
    # Two owners are enough to know that someone other than the target has it.
    gained = now.groupBy("kind", "at").agg(F.min("owner").alias("one"), F.max("owner").alias("other"))
    moved = broadcast_if_small(lost.join(gained, ["kind", "at"], "full_outer"))
    at = F.when(F.col("target_path").isNotNull(), F.col("target_path")).otherwise(F.lower("target_name"))
    asked = links.withColumns({"kind": F.when(F.col("target_path").isNotNull(), "path").otherwise("name"), "at": at})
    new_owner = F.col("one").isNotNull() & ~(F.col("one").eqNullSafe(F.col("target_id")) & F.col("other").eqNullSafe(F.col("target_id")))
    return asked.join(moved, ["kind", "at"]).filter(F.coalesce("lost", F.lit(False)) | new_owner).select("source").distinct()


def session_log(events: DataFrame) -> DataFrame:
    """``(session, event_id, outcome, place, last_seen_at)``: each event of ``(session, event_id, at, kind)`` in its session's log.

    Kinds: open, wrap, and anything else, which is a checkpoint. Events count in the order of (at, event_id).
    The first open opens the session, and a later one is refused. What comes before it, or without one, is
    refused. Of several wraps the first counts, the others are ignored. ``place`` numbers the logged
    checkpoints of a session from 1; ``last_seen_at`` is the latest time up to that event. Events without session are refused.
    """
    w = Window.partitionBy("session").orderBy("at", "event_id")
    first = F.row_number().over(Window.partitionBy("session", "kind").orderBy("at", "event_id")) == 1
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = events.withColumn("first", first)
    opened = F.max(F.col("kind") == "open").over(so_far)
    ordered = ordered.withColumn("opened", F.coalesce(opened, F.lit(False)) & F.col("session").isNotNull())
    wraps = F.row_number().over(Window.partitionBy("session", "kind", "opened").orderBy("at", "event_id")) == 1
    outcome = (
        F.when(~F.col("opened"), "refused")
        .when(F.col("kind") == "open", F.when(F.col("first"), "opened").otherwise("refused"))
        .when(F.col("kind") == "wrap", F.when(wraps, "wrapped").otherwise("ignored"))
        .otherwise("logged")
    )
    judged = ordered.withColumn("outcome", outcome)
    logged = F.col("outcome") == "logged"
    place = F.when(logged, F.sum(logged.cast("int")).over(so_far))
    seen = F.max(F.when(F.col("outcome").isin("opened", "logged"), F.col("at"))).over(so_far)
    return judged.select("session", "event_id", "outcome", place.cast("int").alias("place"), seen.alias("last_seen_at"))
