"""Text and path functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelake.functions import text as T
from notelake.plans.fixtures import links, notes, numbered, table, with_links, with_notes, with_numbered
from notelake.plans.registry import query

c = F.col


@query("estimate_tokens", "SELECT doc_id, cast(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def estimate_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.estimate_tokens(c("text")).alias("tokens"))


_FLAT = r"trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g'))"


@query("excerpt", f"SELECT doc_id, CASE WHEN length({_FLAT}) <= 320 THEN {_FLAT} ELSE rtrim(substring({_FLAT}, 1, 319)) || '…' END AS excerpt FROM documents")
def excerpt(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.excerpt(c("text")).alias("excerpt"))


@query("normalize_tag", with_notes(r"SELECT DISTINCT tag, regexp_replace(lower(tag), '[^\p{L}\p{N}]', '', 'g') AS norm FROM notes"))
def normalize_tag(spark, sf):
    return notes(spark, sf).select("tag", T.normalize_tag(c("tag")).alias("norm")).distinct()


@query(
    "terms_from_task",
    r"""SELECT item_id, (SELECT list(w ORDER BY i) FROM (SELECT w, min(i) AS i FROM (SELECT unnest(x) AS w, generate_subscripts(x, 1) AS i
    FROM (SELECT list_filter(string_split_regex(text, '[^\p{L}\p{N}_]+'), lambda w: length(w) > 1) AS x)) GROUP BY w)) AS words FROM benchmark""",
)
def terms_from_task(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.task_terms(c("text")).alias("words"))


_Q = "concat('\"', split_part(text, ' ', 1), ' ', split_part(text, ' ', 2), '\" ADR-', cast(item_id AS VARCHAR), ' ', split_part(text, ' ', 3))"


@query(
    "parse_query",
    f"""SELECT item_id, list_filter(regexp_extract_all(q, '"([^"]*)"', 1), lambda p: p <> '') AS phrases,
    list_filter(string_split_regex(regexp_replace(q, '"[^"]*"', ' ', 'g'), '\\s+'), lambda w: w <> '') AS terms,
    list_filter(list_filter(string_split_regex(regexp_replace(q, '"[^"]*"', ' ', 'g'), '\\s+'), lambda w: w <> ''), lambda w: regexp_full_match(w, '[#\\p{{L}}\\p{{N}}_]*[\\p{{L}}\\p{{N}}_][-#][\\p{{L}}\\p{{N}}_-]*\\p{{Nd}}[\\p{{L}}\\p{{N}}_-]*')) AS identifiers
    FROM (SELECT item_id, {_Q} AS q FROM benchmark)""",
)
def parse_query(spark, sf):
    part = lambda i: F.split_part(c("text"), F.lit(" "), F.lit(i))
    asked = table(spark, sf, "benchmark").withColumn("q", F.concat(F.lit('"'), part(1), F.lit(" "), part(2), F.lit('" ADR-'), c("item_id").cast("string"), F.lit(" "), part(3)))
    return asked.select("item_id", T.quoted_phrases(c("q")).alias("phrases"), T.query_terms(c("q")).alias("terms"), T.identifier_terms(c("q")).alias("identifiers"))


@query("content_hash", "SELECT doc_id, sha256(concat('{\"lang\":\"', lang, '\"}', chr(31), text, chr(31))) AS content_hash FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.content_hash(F.concat(F.lit('{"lang":"'), c("lang"), F.lit('"}')), c("text")).alias("content_hash"))


@query("chunk_key", with_notes("SELECT concept_id, sha256(concat(concept_id, chr(31), path, chr(31), '0', chr(31), sha256(body), chr(31))) AS chunk_key FROM notes"))
def chunk_key(spark, sf):
    return notes(spark, sf).select("concept_id", T.chunk_key(c("concept_id"), c("path"), F.lit(0), F.sha2("body", 256)).alias("chunk_key"))


@query("is_stale", with_notes(r"""SELECT concept_id, coalesce(regexp_full_match(stale_after, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})'), false) AND coalesce(stale_after <= '2024-05-15T00:00:00+00:00', false) AS stale FROM notes"""))
def is_stale(spark, sf):
    return notes(spark, sf).select("concept_id", T.is_stale(c("stale_after"), "2024-05-15T00:00:00+00:00").alias("stale"))


@query("marker_scan", "SELECT p.page_id, n.n_name AS marker FROM pages p JOIN nation n ON contains(lower(p.html), lower(n.n_name))")
def marker_scan(spark, sf):
    marks = F.broadcast(table(spark, sf, "nation").select(c("n_name").alias("marker")))  # a fixed vocabulary of 25
    return table(spark, sf, "pages").join(marks, T.marker_count(c("html"), c("marker"))).select("page_id", "marker")


@query("external_ref", with_links("SELECT page_id, href, list_extract(string_split(href, '/'), -1) AS ref FROM links"))
def external_ref(spark, sf):
    return links(spark, sf).select("page_id", "href", T.external_ref(c("href")).alias("ref"))


@query("link_targets", with_links(r"SELECT page_id, href, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') OR starts_with(href, '//') THEN 'external' WHEN starts_with(href, '#') OR href = '' THEN 'self' WHEN starts_with(href, '/') THEN 'absolute' ELSE 'relative' END AS kind FROM links"))
def link_targets(spark, sf):
    return links(spark, sf).select("page_id", "href", T.link_kind(c("href")).alias("kind"))


@query("declared_item", r"SELECT conv_id, turn, nullif(regexp_extract(text, '^\s*([A-Za-z0-9#-]*[0-9][A-Za-z0-9#-]*)', 1), '') AS item FROM conversations")
def declared_item(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.declared_item(c("text")).alias("item"))


@query("decision_number", with_numbered("SELECT concept_id, series, number FROM parts"))
def decision_number(spark, sf):
    return numbered(spark, sf).select("concept_id", T.decision_series(c("path")).alias("series"), T.decision_number(c("path")).alias("number"))


@query("written_title", with_notes(r"SELECT concept_id, replace(regexp_replace(list_extract(string_split(path, '/'), -1), '\.md$', ''), '-', ' ') AS title FROM notes"))
def written_title(spark, sf):
    return notes(spark, sf).select("concept_id", T.written_title(c("body"), c("path")).alias("title"))


@query("resolve_path", with_notes("SELECT concept_id, concat(split_part(path, '/', 1), '/', split_part(path, '/', 2), '/Context/x', cast(doc_id AS VARCHAR), '.md') AS inside, NULL::VARCHAR AS outside FROM notes"))
def resolve_path(spark, sf):
    relative = F.concat(F.lit("../Context/./x"), c("doc_id").cast("string"), F.lit(".md"))
    return notes(spark, sf).select("concept_id", T.resolve_path(c("path"), relative).alias("inside"), T.resolve_path(c("path"), F.lit("../../../../up.md")).alias("outside"))


@query("order_by_segments", with_notes("SELECT concept_id, cast(row_number() OVER (ORDER BY string_split(path, '/'), concept_id) AS INTEGER) AS place FROM notes"))
def order_by_segments(spark, sf):
    from notelake.operators.ranking import global_rank

    return global_rank(notes(spark, sf).withColumn("segments", T.segments(c("path"))), ["segments", "concept_id"], "place").select("concept_id", c("place").cast("int").alias("place"))


@query("list_item_lines", r"SELECT doc_id, cast(i AS INTEGER) AS line, x AS item FROM (SELECT doc_id, unnest(string_split(replace(text, '. ', chr(10) || '- '), chr(10))) AS x, generate_subscripts(string_split(replace(text, '. ', chr(10) || '- '), chr(10)), 1) AS i FROM documents) WHERE starts_with(x, '- ')")
def list_item_lines(spark, sf):
    lines = F.split(F.replace(c("text"), F.lit(". "), F.lit("\n- ")), "\n")
    return table(spark, sf, "documents").select("doc_id", F.posexplode(lines).alias("i", "item")).filter(F.startswith(c("item"), F.lit("- "))).select("doc_id", (c("i") + 1).alias("line"), "item")
