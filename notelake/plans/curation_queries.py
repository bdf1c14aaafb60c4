"""Curation of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelake.operators import curation, graph, retrieval
from notelake.plans.fixtures import edges, notes, table, with_notes
from notelake.plans.registry import query

c = F.col
_LINES = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


@query(
    "text_hazards",
    rf"""WITH lines AS (SELECT doc_id, unnest(parts) AS content, generate_subscripts(parts, 1) AS line
      FROM (SELECT doc_id, regexp_split_to_array(text || chr(10) || '/home/' || source || chr(8203) || ' in /home/user or C:\Users\' || lang, '{_LINES}') AS parts FROM documents)),
    kinds(kind, pattern, chars) AS (VALUES ('zero_width', '[\x{{200B}}-\x{{200D}}\x{{2060}}\x{{FEFF}}]', true), ('bidi_override', '[\x{{202A}}-\x{{202E}}\x{{2066}}-\x{{2069}}]', true),
      ('variation_selector', '[\x{{FE00}}-\x{{FE0F}}\x{{E0100}}-\x{{E01EF}}]', true), ('tag_character', '[\x{{E0000}}-\x{{E007F}}]', true), ('invisible_operator', '[\x{{2061}}-\x{{2064}}]', true),
      ('format_control', '\x{{180E}}', true), ('hangul_filler', '[\x{{115F}}\x{{1160}}\x{{3164}}]', true), ('personal_path_posix', '/home/([A-Za-z][A-Za-z0-9._-]*)', false),
      ('personal_path_macos', '/Users/([A-Za-z][A-Za-z0-9._-]*)', false), ('personal_path_windows', '[Cc]:\\Users\\([A-Za-z][A-Za-z0-9._-]*)', false)),
    cut AS (SELECT doc_id, kind, line, chars, pattern, regexp_extract_all(content, pattern) AS m, regexp_split_to_array(content, pattern) AS p FROM lines JOIN kinds ON regexp_matches(content, pattern)),
    hit AS (SELECT doc_id, kind, line, chars, pattern, m[i] AS match, 1 + list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS "at"
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM cut))
    SELECT doc_id, kind, cast(line AS INTEGER) AS line, cast("at" AS INTEGER) AS "at" FROM hit
    WHERE chars OR lower(regexp_extract(match, pattern, 1)) NOT IN ('user', 'username', 'youruser', 'yourusername', 'your-username', 'example', 'me', 'you', 'name')""",
)
def text_hazards(spark, sf):
    text = F.concat("text", F.lit("\n/home/"), "source", F.lit("\u200b in /home/user or C:\\Users\\"), "lang")
    return curation.text_hazards(table(spark, sf, "documents").select("doc_id", text.alias("text")), "doc_id", "text")


@query(
    "filter_changes",
    """WITH changes AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') || CASE page_id % 6 WHEN 0 THEN '/.git/a.md' WHEN 1 THEN '/~a.md' WHEN 2 THEN '/a.md' WHEN 3 THEN '/a.md.tmp' WHEN 4 THEN '/.a.md' ELSE '/../a.md' END AS path FROM pages)
    SELECT page_id, path FROM changes WHERE path NOT LIKE '/%' AND NOT list_contains(string_split(path, '/'), '..') AND NOT list_has_any(string_split(path, '/'), ['.git', '.obsidian', '.trash', '.stfolder'])
      AND NOT regexp_matches(split_part(path, '/', -1), '^(\\.#|~)|(\\.swp|\\.swx|~|\\.tmp)$') AND path LIKE '%.md'""".replace("\\\\", "\\"),
)
def filter_changes(spark, sf):
    tails = ["/.git/a.md", "/~a.md", "/a.md", "/a.md.tmp", "/.a.md", "/../a.md"]
    path = F.concat(F.regexp_replace("url", "^[a-z]+://", ""), F.element_at(F.array(*map(F.lit, tails)), (c("page_id") % 6 + 1).cast("int")))
    return table(spark, sf, "pages").select("page_id", path.alias("path")).filter(curation.is_watched(c("path")))


_LEDGER = "SELECT cast(event_id AS VARCHAR) AS fingerprint, CASE WHEN event_type = 'error' OR value > 50 THEN 'error' ELSE 'warning' END AS severity, cast(ts AS VARCHAR) AS detected_at, CASE WHEN user_id % 3 = 0 THEN 'done' END AS resolved_at FROM events"


@query("filter_findings", f"SELECT fingerprint, severity, cast(row_number() OVER (PARTITION BY severity ORDER BY detected_at, fingerprint) AS INTEGER) AS place FROM ({_LEDGER}) WHERE resolved_at IS NULL AND severity = 'error'")
def filter_findings(spark, sf):
    ledger = table(spark, sf, "events").select(
        c("event_id").cast("string").alias("fingerprint"), F.when((c("event_type") == "error") | (c("value") > 50), "error").otherwise("warning").alias("severity"),
        c("ts").cast("string").alias("detected_at"), F.when(c("user_id") % 3 == 0, "done").alias("resolved_at"),
    )
    return curation.filter_findings(ledger, "error").select("fingerprint", "severity", "place")


@query("remove_metadata", with_notes("SELECT concept_id, type, path FROM notes WHERE concept_id NOT IN (SELECT source_id FROM edges WHERE relation_type = 'superseded_by')"))
def remove_metadata(spark, sf):
    gone = edges(spark, sf).filter("relation_type = 'superseded_by'").select(c("source_id").alias("concept_id"))
    return curation.remove_metadata(notes(spark, sf).select("concept_id", "type", "path"), gone)


@query(
    "present_successors",
    with_notes(
        "SELECT DISTINCT a.source AS query_id, a.concept_id AS owner, b.concept_id AS successor FROM edges e JOIN notes a ON a.concept_id = e.source_id JOIN notes b ON b.concept_id = e.target_id "
        "WHERE e.relation_type = 'superseded_by' AND a.source = b.source"
    ),
)
def present_successors(spark, sf):
    return curation.present_successors(notes(spark, sf).select(c("source").alias("query_id"), c("concept_id").alias("owner")), edges(spark, sf))


@query("rank_in_query", "SELECT lang AS query_id, doc_id AS owner, cast(row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank FROM documents")
def rank_in_query(spark, sf):
    hits = table(spark, sf, "documents").select(c("lang").alias("query_id"), c("doc_id").alias("owner"), "n_chars")
    return curation.rank_in_query(hits, F.desc("n_chars"), c("owner")).select("query_id", "owner", "rank")


@query(
    "exact_identifier_lane",
    "WITH asked AS (SELECT DISTINCT lang || '-' || cast(label AS VARCHAR) AS identifier, label AS query_id FROM documents JOIN embeddings ON doc_id = vec_id WHERE label IS NOT NULL), "
    "notes AS (SELECT doc_id, 'see ' || upper(lang) || '-' || cast(doc_id % 12 AS VARCHAR) || ', ' || coalesce(text, '') AS body FROM documents) "
    r"SELECT query_id, identifier, doc_id AS owner FROM asked JOIN (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(lower(body), '[^\p{L}\p{N}_-]+'))) AS piece FROM notes) ON piece = lower(identifier)",
)
def exact_identifier_lane(spark, sf):
    d, v = table(spark, sf, "documents"), table(spark, sf, "embeddings")
    asked = d.join(v, c("doc_id") == c("vec_id")).filter("label is not null").select(F.concat("lang", F.lit("-"), c("label").cast("string")).alias("identifier"), c("label").alias("query_id")).distinct()
    body = F.concat(F.lit("see "), F.upper("lang"), F.lit("-"), (c("doc_id") % 12).cast("string"), F.lit(", "), F.coalesce("text", F.lit("")))
    return curation.exact_identifier_lane(asked, d.select("doc_id", body.alias("body")), "doc_id", "body")


@query(
    "ratified_cases",
    "SELECT item_id FROM benchmark WHERE item_id % 3 <> 0",
)
def ratified_cases(spark, sf):
    words = F.split("text", " ")
    cases = table(spark, sf, "benchmark").select("item_id", c("text").alias("task"), F.slice(words, 1, 2).alias("requires"), F.slice(words, 3, 2).alias("forbids"), F.slice(words, 5, 2).alias("deprioritises"))
    # The stamp was given to the lists in another order, and for every third case to another task.
    turned = [F.reverse(x) for x in ("requires", "forbids", "deprioritises")]
    task = F.when(c("item_id") % 3 == 0, F.concat("task", F.lit("?"))).otherwise(c("task"))
    return curation.ratified_cases(cases.withColumn("stamp", curation.expectation_stamp(task, *turned))).select("item_id")


@query(
    "relation_edges",
    with_notes("SELECT concept_id AS source_id, lifecycle AS relation_type, workspace AS target_id FROM notes WHERE lifecycle IS NOT NULL AND workspace IS NOT NULL UNION ALL SELECT concept_id, 'tagged', tag FROM notes"),
)
def relation_edges(spark, sf):
    return curation.relation_edges(_related(spark, sf))[0]


@query(
    "projection_issues",
    with_notes("SELECT concept_id, CASE WHEN lifecycle IS NULL THEN 'invalid_relation' ELSE 'invalid_relation_target' END AS code FROM notes WHERE lifecycle IS NULL OR workspace IS NULL"),
)
def projection_issues(spark, sf):
    return curation.relation_edges(_related(spark, sf))[1]


def _related(spark, sf):
    pair = lambda kind, target: F.struct(kind.alias("type"), target.alias("target"))
    return notes(spark, sf).select("concept_id", F.array(pair(c("lifecycle"), c("workspace")), pair(F.lit(" tagged "), c("tag"))).alias("relations"))


@query(
    "rule_unregistered",
    with_notes("SELECT concept_id, field FROM (SELECT concept_id, type, unnest(list_distinct(['type', 'id', lang, status])) AS field FROM notes) WHERE field NOT IN ('type', 'id', 'en') AND NOT (type = 'decision' AND field = 'final') AND NOT (type = 'task' AND field = 'active')"),
)
def rule_unregistered(spark, sf):
    fields = notes(spark, sf).select("concept_id", "type", F.array(F.lit("type"), F.lit("id"), c("lang"), c("status")).alias("fields"))
    registry = spark.createDataFrame([(None, "type"), (None, "id"), (None, "en"), ("decision", "final"), ("task", "active")], "type string, field string")
    return curation.rule_unregistered(fields, registry)


@query("missing_manifest", with_notes("SELECT DISTINCT source FROM notes WHERE source NOT IN (SELECT split_part(url_path, '/', 1) FROM (SELECT source || '/manifest.md' AS url_path FROM notes WHERE doc_id % 20 = 7))"))
def missing_manifest(spark, sf):
    path = F.when(c("doc_id") % 20 == 7, F.concat("source", F.lit("/manifest.md"))).otherwise(c("path"))
    return curation.missing_manifest(notes(spark, sf).select("source", path.alias("path")), "source", "manifest.md")


@query(
    "compare_runs",
    "SELECT round(b - a, 9) AS delta, round(s, 9) AS swing, abs(round(b - a, 9)) > round(s, 9) AS distinguishable, true AS comparable FROM "
    "(SELECT avg(l_discount) AS a, avg(l_tax) AS b, 1 / count(*) AS s FROM (SELECT l_orderkey, avg(l_discount) AS l_discount, avg(l_tax) AS l_tax FROM lineitem GROUP BY l_orderkey))",
)
def compare_runs(spark, sf):
    runs = table(spark, sf, "lineitem").groupBy(c("l_orderkey").alias("case_id")).agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b")).withColumn("k", F.lit(5))
    return curation.compare_runs(runs.select("case_id", "k", c("a").alias("recall")), runs.select("case_id", "k", c("b").alias("recall")))


_RANKED = "SELECT source AS query_id, concept_id AS owner, lifecycle, row_number() OVER (PARTITION BY source ORDER BY created_at DESC, path) AS rank FROM notes"


@query(
    "violations",
    with_notes(
        f"SELECT r.query_id, kind, r.owner, CASE WHEN kind <> 'required' THEN rank END AS rank FROM (SELECT *, CASE lifecycle WHEN 'accepted' THEN 'required' WHEN 'rejected' THEN 'forbidden' ELSE 'deprioritised' END AS kind FROM ({_RANKED})) r "
        f"LEFT JOIN (SELECT query_id, max(rank) AS last FROM ({_RANKED}) WHERE lifecycle = 'accepted' AND rank <= 10 GROUP BY query_id) l ON l.query_id = r.query_id "
        "WHERE (kind = 'required' AND rank > 10) OR (kind = 'forbidden' AND rank <= 10) OR (kind = 'deprioritised' AND rank < last)"
    ),
)
def violations(spark, sf):
    ranked = curation.rank_in_query(notes(spark, sf).withColumn("query_id", c("source")), F.desc("created_at"), c("path")).withColumnRenamed("concept_id", "owner")
    kind = F.when(c("lifecycle") == "accepted", "required").when(c("lifecycle") == "rejected", "forbidden").otherwise("deprioritised")
    return curation.violations(ranked, ranked.select("query_id", "owner", kind.alias("kind")), 10)


@query(
    "declared_unchanged",
    with_notes(
        "SELECT DISTINCT user_id AS session, path FROM events JOIN notes ON doc_id = event_id % 1000 WHERE CASE WHEN user_id % 2 = 0 THEN event_id % 3 = 0 ELSE created_at <= '2024-06-01' END"
    ),
)
def declared_unchanged(spark, sf):
    held = notes(spark, sf).select("doc_id", "concept_id", "path", F.sha2("body", 256).alias("digest"), c("created_at").alias("modified_at"))
    said = table(spark, sf, "events").select(c("user_id").alias("session"), (c("event_id") % 1000).alias("doc_id"), "event_id").join(held, "doc_id")
    declared = said.select("session", "concept_id", F.lit("2024-06-01").alias("started_at"))
    digest = F.when(c("event_id") % 3 == 0, c("digest")).otherwise(F.lit("another"))
    given = said.filter("session % 2 = 0").select("session", "concept_id", digest.alias("digest"))
    return curation.declared_unchanged(declared, given, held.drop("doc_id"))


@query(
    "reason_stage",
    "SELECT event_id, CASE event_type WHEN 'view' THEN 'external_state' WHEN 'click' THEN 'lexical' ELSE 'named' END AS stage FROM events",
)
def reason_stage(spark, sf):
    code = F.when(c("event_type") == "view", "recent_activity").when(c("event_type") == "click", "fts_rank").otherwise(c("event_type"))
    return table(spark, sf, "events").select("event_id", curation.reason_stage(code, F.lit("named")).alias("stage"))


@query(
    "required_closure",
    with_notes(
        "SELECT concept_id FROM (WITH RECURSIVE r(concept_id) AS (SELECT concept_id FROM notes WHERE doc_id % 50 = 1 UNION SELECT source_id FROM edges JOIN r ON target_id = concept_id WHERE relation_type = 'implements') SELECT concept_id FROM r)"
    ),
)
def required_closure(spark, sf):
    return graph.required_closure(notes(spark, sf).filter("doc_id % 50 = 1"), edges(spark, sf).filter("relation_type = 'implements'"))


def _first_accepted(spark, sf):
    ranked = curation.rank_in_query(notes(spark, sf).withColumn("query_id", c("source")), F.desc("created_at"), c("path")).withColumnRenamed("concept_id", "owner")
    return retrieval.recall_at_k(ranked.select("query_id", "owner", "rank"), ranked.filter("lifecycle = 'accepted'"), 10)


@query("reciprocal_rank", with_notes(f"SELECT query_id, 1.0 / min(rank) AS reciprocal_rank FROM ({_RANKED}) WHERE lifecycle = 'accepted' GROUP BY query_id"))
def reciprocal_rank(spark, sf):
    return _first_accepted(spark, sf).select("query_id", "reciprocal_rank")


@query("first_required_rank", with_notes(f"SELECT query_id, min(rank) AS first_rank FROM ({_RANKED}) WHERE lifecycle = 'accepted' GROUP BY query_id"))
def first_required_rank(spark, sf):
    return _first_accepted(spark, sf).select("query_id", "first_rank")
