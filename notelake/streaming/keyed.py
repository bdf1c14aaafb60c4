"""Keyed state of the upkeep streams: listed paths, held documents, and sessions with their logs.

State lives in the stream's checkpoint, one entry for each path, document or session, so a batch costs
what it changes. A batch that is run again starts from the state before it and gives the same rows.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def with_keyed_state(spark: SparkSession) -> SparkSession:
    """The session, set to the state store that these streams need; call it before a stream starts."""
    spark.conf.set(*_PROVIDER)
    return spark


def _struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


class ListedPath(StatefulProcessor):
    """What was read at a path, with the size and time it had; a file is read again only if these moved."""

    SEEN = "concept_id string, content_hash string, size long, modified_at double"
    OUT = "concept_id string, path string, content_hash string, gone boolean"

    def __init__(self, read: Callable[[Row], tuple[str, str] | None]):
        self.read = read
        self.kept = _struct(self.SEEN)

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", self.kept)

    def handleInputRows(self, key, rows, timerValues):
        path = key[0]
        old = Row("concept_id", "content_hash", "size", "modified_at")(*self.seen.get()) if self.seen.exists() else None
        last = max(rows, key=lambda r: r.seq)
        if old is not None and not last.gone and (old.size, old.modified_at) == (last.size, last.modified_at):
            return
        found = None if last.gone else self.read(last)
        if old is not None and (found is None or found[0] != old.concept_id):
            yield Row(concept_id=old.concept_id, path=path, content_hash=None, gone=True)
        if found is None:
            self.seen.clear()
            return
        self.seen.update((*found, last.size, last.modified_at))
        if old is None or (old.concept_id, old.content_hash) != found:
            yield Row(concept_id=found[0], path=path, content_hash=found[1], gone=False)

    def close(self) -> None:
        pass


class HeldDocument(StatefulProcessor):
    """The paths that claim a document; the smallest holds it."""

    OUT = "concept_id string, change string, path string, old_path string, content_hash string, claims int"

    def __init__(self):
        self.kept = _struct("path string"), _struct("content_hash string")

    def init(self, handle) -> None:
        self.claims = handle.getMapState("claims", *self.kept)

    def _holder(self) -> tuple[str, str] | None:
        return min(((k[0], v[0]) for k, v in self.claims.iterator()), default=None)

    def handleInputRows(self, key, rows, timerValues):
        before = self._holder()
        for row in sorted(rows, key=lambda r: (r.path, not r.gone)):
            if not row.gone:
                self.claims.updateValue((row.path,), (row.content_hash,))
            elif self.claims.containsKey((row.path,)):
                self.claims.removeKey((row.path,))
        now = self._holder()
        if before == now:
            return
        if now is None:
            change = "removed"
        elif before is None:
            change = "new"
        else:
            change = "changed" if before[1] != now[1] else "moved"
        path, content = now or (None, None)
        yield Row(concept_id=key[0], change=change, path=path, old_path=before and before[0], content_hash=content, claims=sum(1 for _ in self.claims.keys()))

    def close(self) -> None:
        pass


def _as_read(row: Row) -> tuple[str, str] | None:
    return None if row.concept_id is None else (row.concept_id, row.content_hash)


def reconcile_changes(observed: DataFrame, read: Callable[[Row], tuple[str, str] | None] = _as_read) -> DataFrame:
    """The index changes ``(concept_id, change, path, old_path, content_hash, claims)`` that observations of a store cause.

    ``observed(path, seq, size, modified_at, gone, ...)`` streams what a listing or a watcher saw; of several
    rows of a path in a batch the one with the largest ``seq`` counts. ``read(row)`` opens the file and
    gives ``(concept_id, content_hash)``, or None if it is no document; it is called, in the task, only for
    paths that are new or whose size or time moved. By default both are columns of the row. Changes: new, changed, moved (same content at another path),
    removed. Of several paths that claim a document the smallest holds it, as in ``reconcile_full``.
    """
    found = observed.filter("path is not null").groupBy("path").transformWithState(ListedPath(read), _struct(ListedPath.OUT), "append", "None")
    return found.groupBy("concept_id").transformWithState(HeldDocument(), _struct(HeldDocument.OUT), "append", "None")


class SessionLog(StatefulProcessor):
    """Who opened a session, when it was last seen, who wrapped it, and the events that the watermark has not passed."""

    OUT = "session string, event_id long, outcome string, at timestamp, last_seen_at timestamp"
    WAITING = "event_id long, at timestamp, kind string"

    def __init__(self):
        self.kept = _struct("opened_by long, last_seen_at timestamp, wrapped_by long"), _struct(self.WAITING)

    def init(self, handle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", self.kept[0])
        self.waiting = handle.getListState("waiting", self.kept[1])

    def handleInputRows(self, key, rows, timerValues):
        # Nothing is final before the watermark has passed it: events wait, in any order of arrival.
        fresh = [(r.event_id, r.at, r.kind) for r in rows]
        self.waiting.appendList(fresh)
        for at in {self._due(t) for _, t, _ in fresh}:
            self.handle.registerTimer(at)
        return iter(())

    def _due(self, at: datetime.datetime) -> int:
        return int(at.timestamp() * 1000) + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        limit = timerValues.getCurrentWatermarkInMs()
        held = [tuple(x) for x in self.waiting.get()]
        due = sorted((x for x in held if self._due(x[1]) <= limit), key=lambda x: (x[1], x[0]))
        rest = [x for x in held if self._due(x[1]) > limit]
        if not due:
            return
        self.waiting.put(rest) if rest else self.waiting.clear()
        opened_by, seen, wrapped = self.session.get() if self.session.exists() else (None, None, None)
        for event_id, at, kind in due:
            if opened_by is None and kind != "open":
                outcome = "refused"
            elif kind == "open":
                outcome = "refused" if opened_by is not None else "opened"
                opened_by = event_id if opened_by is None else opened_by
            elif kind == "wrap":
                outcome = "ignored" if wrapped is not None else "wrapped"
                wrapped = event_id if wrapped is None else wrapped
            else:
                outcome = "logged"
            if outcome in ("opened", "logged"):
                seen = at if seen is None or at > seen else seen
            yield Row(session=key[0], event_id=event_id, outcome=outcome, at=at, last_seen_at=seen)
        if opened_by is not None:
            self.session.update((opened_by, seen, wrapped))

    def close(self) -> None:
        pass


def append_checkpoints(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event of ``(session, event_id, at, kind)`` once, with its outcome as in ``reconcile.session_log``.

    An event is judged when the watermark, ``late`` behind the newest event, has passed it, so events may
    arrive in any order within that time: a checkpoint that arrives before its session's opening waits
    for it. Events that are later than that are dropped by the watermark. Rows of a session come in the
    order of its log; refused ones are told by their outcome and can be written to a table of their own.
    """
    timed = events.filter("session is not null").select(F.col("session").cast("string").alias("session"), "event_id", "at", "kind").withWatermark("at", late)
    return timed.groupBy("session").transformWithState(SessionLog(), _struct(SessionLog.OUT), "append", "EventTime")
