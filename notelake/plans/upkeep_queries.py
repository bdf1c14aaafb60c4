"""Reconcile passes, session logs and the keyed stream over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from notelake.operators import reconcile, state
from notelake.plans.fixtures import links, table, view, with_links
from notelake.plans.registry import query
from notelake.sources.shared import shared_dir
from notelake.streaming import keyed

c = F.col

#: What an index recorded and what the store holds now: new, moved, rewritten, touched and gone documents, changes
#: under an unmoved size and time, and second files that claim a document.
RECORDED = """SELECT concat('d', cast(doc_id AS string)) AS concept_id, CASE WHEN doc_id % 10 = 3 THEN concat('old/', source, '/', cast(doc_id AS string), '.md') ELSE concat(lang, '/', source, '/', cast(doc_id AS string), '.md') END AS path,
  CASE WHEN doc_id % 8 = 1 OR doc_id % 14 = 6 THEN md5(concat(text, ' before')) ELSE md5(text) END AS content_hash, n_chars AS size, CASE WHEN doc_id % 8 = 1 OR doc_id % 12 = 5 THEN 1.0 ELSE 2.0 END AS modified_at
FROM documents WHERE doc_id % 9 <> 0
UNION ALL SELECT concat('gone', cast(doc_id AS string)), concat('gone/', cast(doc_id AS string), '.md'), md5(text), n_chars, 2.0 FROM documents WHERE doc_id % 15 = 2"""
CONTENTS = """SELECT concat('d', cast(doc_id AS string)) AS concept_id, concat(lang, '/', source, '/', cast(doc_id AS string), '.md') AS path, md5(text) AS content_hash, n_chars AS size, 2.0 AS modified_at FROM documents
UNION ALL SELECT concat('d', cast(doc_id AS string)), concat(CASE WHEN doc_id % 40 = 7 THEN 'aa/' ELSE 'zz/' END, cast(doc_id AS string), '.md'), md5(text), n_chars, 3.0 FROM documents WHERE doc_id % 20 = 7"""


def _with_store(sql: str) -> str:
    both = f"recorded AS ({RECORDED}), contents AS ({CONTENTS})".replace("AS string", "AS VARCHAR")
    return f"WITH {both}, claims AS (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY path) AS n FROM contents) {sql}"


_FULL = """SELECT c.concept_id, c.path, CASE WHEN n > 1 THEN 'duplicate' WHEN {same} THEN 'unchanged' ELSE 'indexed' END AS action FROM claims c LEFT JOIN recorded r USING (concept_id)
  UNION ALL SELECT concept_id, path, 'removed' FROM recorded WHERE concept_id NOT IN (SELECT concept_id FROM contents)"""


@query("reconcile_full", _with_store(_FULL.format(same="false")))
def reconcile_full(spark, sf):
    return reconcile.reconcile_full(view(spark, sf, RECORDED), view(spark, sf, CONTENTS))


@query("reconcile_changed", _with_store(_FULL.format(same="c.path = r.path AND c.content_hash = r.content_hash")))
def reconcile_changed(spark, sf):
    """Every document is read; those with path and hash as recorded stay as they are."""
    return reconcile.reconcile_full(view(spark, sf, RECORDED), view(spark, sf, CONTENTS), changed_only=True)


@query("reconcile_settled", _with_store("""SELECT concept_id, path, action FROM (
  SELECT c.concept_id, c.path, CASE WHEN t.concept_id IS NOT NULL AND t.path = c.path THEN 'unchanged' WHEN t.concept_id IS NOT NULL THEN 'duplicate'
    WHEN row_number() OVER (PARTITION BY c.concept_id ORDER BY c.path) > 1 THEN 'duplicate' WHEN c.path = r.path AND c.content_hash = r.content_hash THEN 'unchanged' ELSE 'indexed' END AS action
  FROM contents c LEFT JOIN recorded r USING (concept_id) LEFT JOIN (SELECT r.concept_id, r.path FROM recorded r JOIN contents s ON r.path = s.path AND r.size = s.size AND r.modified_at = s.modified_at) t ON c.concept_id = t.concept_id)
  UNION ALL SELECT concept_id, path, 'removed' FROM recorded WHERE concept_id NOT IN (SELECT concept_id FROM contents)"""))
def reconcile_settled(spark, sf):
    """Only files whose size or time moved are read."""
    contents = view(spark, sf, CONTENTS)
    read = lambda paths: contents.join(paths, "path", "left_semi").select("path", "concept_id", "content_hash")
    return reconcile.reconcile_settled(view(spark, sf, RECORDED), contents.select("path", "size", "modified_at"), read)


@query("stream_reconcile", _with_store("""SELECT concept_id, CASE WHEN r.concept_id IS NULL THEN 'new' WHEN c.concept_id IS NULL THEN 'removed' WHEN c.content_hash <> r.content_hash THEN 'changed' ELSE 'moved' END AS change, c.path, r.path AS old_path
  FROM (SELECT * FROM claims WHERE n = 1) c FULL JOIN (SELECT * FROM recorded) r USING (concept_id) WHERE c.path IS DISTINCT FROM r.path OR (c.content_hash <> r.content_hash AND r.modified_at <> c.modified_at)"""))
def stream_reconcile(spark, sf):
    """The recorded state and then what is there now, as two batches of a stream; the changes of the second."""
    root = f"{shared_dir(spark)}/stream-reconcile-{uuid.uuid4().hex}"
    was, now = view(spark, sf, RECORDED), view(spark, sf, CONTENTS)
    gone = was.join(now, "path", "left_anti")
    row = lambda df, seq, missing: df.select("path", F.lit(seq).cast("long").alias("seq"), c("size").cast("long").alias("size"), c("modified_at").cast("double").alias("modified_at"), F.lit(missing).alias("gone"), "concept_id", "content_hash")
    row(was, 1, False).write.parquet(f"{root}/in/step=1")
    row(now, 2, False).unionByName(row(gone, 2, True)).write.parquet(f"{root}/in/step=2")
    before = spark.conf.get(keyed._PROVIDER[0])
    keyed.with_keyed_state(spark)
    try:
        schema = spark.read.parquet(f"{root}/in/step=1").schema
        for step in (1, 2):  # one listing a run; the state is kept between them
            observed = spark.readStream.schema(schema).parquet(f"{root}/in/step={{1,{step}}}" if step > 1 else f"{root}/in/step=1")
            write = lambda df, n, step=step: df.write.mode("overwrite").parquet(f"{root}/out/step={step}/batch={n}")
            keyed.reconcile_changes(observed).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(keyed._PROVIDER[0], before)
    return spark.read.parquet(f"{root}/out/step=2").select("concept_id", "change", "path", "old_path")


@query("referrers_to_revisit", with_links("""SELECT DISTINCT page_id AS source FROM links WHERE
  href IN (SELECT url FROM pages WHERE page_id % 5 = 0 OR page_id % 7 = 1) AND NOT href IN (SELECT url FROM pages WHERE page_id % 5 <> 0 AND page_id % 7 <> 1)"""))
def referrers_to_revisit(spark, sf):
    """Pages with links to a page that moved (every fifth) or left."""
    pages = table(spark, sf, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"), F.max((c("page_id") % 5 != 0) & (c("page_id") % 7 != 1)).alias("stays"))
    none = F.array().cast("array<string>")
    moved = pages.filter("not stays")
    was = moved.select(c("page_id").alias("concept_id"), c("url").alias("path"), none.alias("names"))
    now = moved.filter("page_id % 5 = 0").select(c("page_id").alias("concept_id"), F.concat(F.lit("moved/"), "url").alias("path"), none.alias("names"))
    held = links(spark, sf).select(c("page_id").alias("source"), c("href").alias("target_path"), F.lit(None).cast("string").alias("target_name"))
    resolved = held.join(pages.select(c("url").alias("target_path"), c("page_id").alias("target_id")), "target_path", "left")
    return reconcile.referrers_to_revisit(resolved, was, now)


#: Events as a session's: who opens, wraps and writes. A session is a user's events in a stretch of 200 events.
_SESSIONS = "SELECT concat(cast(user_id AS string), '-', cast(event_id - event_id % 200 AS string)) AS session, event_id, ts AS at, CASE event_type WHEN 'signup' THEN 'open' WHEN 'purchase' THEN 'wrap' ELSE 'checkpoint' END AS kind FROM events"
_LOG = f"""WITH ev AS ({_SESSIONS.replace("AS string", "AS VARCHAR").replace("ts AS at", "ts AS t")}), o AS (SELECT session, min(row(t, event_id)) AS first FROM ev WHERE kind = 'open' GROUP BY session),
  w AS (SELECT e.session, min(row(t, event_id)) AS first FROM ev e JOIN o USING (session) WHERE kind = 'wrap' AND row(t, event_id) > o.first GROUP BY e.session),
  judged AS (SELECT e.session, event_id, t, CASE WHEN o.first IS NULL OR row(t, event_id) < o.first THEN 'refused' WHEN kind = 'open' THEN CASE WHEN row(t, event_id) = o.first THEN 'opened' ELSE 'refused' END
    WHEN kind = 'wrap' THEN CASE WHEN row(t, event_id) = w.first THEN 'wrapped' ELSE 'ignored' END ELSE 'logged' END AS outcome FROM ev e LEFT JOIN o USING (session) LEFT JOIN w USING (session))"""


@query("append_checkpoints", f"""{_LOG} SELECT session, event_id, outcome, CASE WHEN outcome = 'logged' THEN cast(sum(CASE WHEN outcome = 'logged' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY t, event_id) AS INTEGER) END AS place,
  max(CASE WHEN outcome IN ('opened', 'logged') THEN t END) OVER (PARTITION BY session ORDER BY t, event_id) AS last_seen_at FROM judged""")
def append_checkpoints(spark, sf):
    """Every event with its outcome: opened, logged with its place, wrapped, ignored or refused."""
    return reconcile.session_log(view(spark, sf, _SESSIONS))


@query("expire_sessions", f"""{_LOG}, folded AS (SELECT session, count(CASE WHEN outcome = 'opened' THEN 1 END) AS opened, count(CASE WHEN outcome = 'logged' THEN 1 END) AS logged, count(CASE WHEN outcome = 'wrapped' THEN 1 END) AS wrapped, max(CASE WHEN outcome IN ('opened', 'logged') THEN t END) AS seen FROM judged GROUP BY session)
  SELECT session FROM folded WHERE opened = 1 AND logged = 0 AND wrapped = 0 AND seen < (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def expire_sessions(spark, sf):
    """Opened sessions that hold nothing, were not wrapped and were last seen a day before the newest event."""
    events = view(spark, sf, _SESSIONS)
    before = events.agg((F.max("at") - F.expr("interval 1 day")).alias("before"))
    return state.expire_sessions(state.fold_sessions(events), before).select("session")
