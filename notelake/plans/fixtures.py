"""Driver tables shaped as the library's inputs, by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Notes: identity, path, type, owner, lifecycle, times, tags and body, from documents and their labels.
NOTES = """
SELECT d.doc_id, concat('n', lpad(cast(d.doc_id AS string), 9, '0')) AS concept_id,
  concat(CASE WHEN d.doc_id % 10 = 9 THEN '90_Archive/' WHEN d.doc_id % 10 >= 6 THEN '20_Knowledge/' ELSE '10_Workspaces/' END,
         d.source, '/', CASE d.doc_id % 4 WHEN 0 THEN 'Decisions' WHEN 1 THEN 'Context' WHEN 2 THEN 'Tasks' ELSE 'Logs' END, '/adr-', lpad(cast(d.doc_id % 500 AS string), 4, '0'), '_', d.lang, cast(d.doc_id AS string), '.md') AS path,
  CASE d.doc_id % 6 WHEN 0 THEN 'decision' WHEN 1 THEN 'context' WHEN 2 THEN 'task' WHEN 3 THEN 'standard' WHEN 4 THEN 'knowledge' ELSE 'log' END AS type,
  CASE WHEN d.doc_id % 10 >= 6 AND d.doc_id % 10 < 9 THEN NULL ELSE d.source END AS workspace,
  CASE d.doc_id % 5 WHEN 0 THEN 'accepted' WHEN 1 THEN 'proposed' WHEN 2 THEN 'superseded' WHEN 3 THEN 'rejected' ELSE NULL END AS lifecycle,
  CASE d.doc_id % 7 WHEN 0 THEN 'draft' WHEN 1 THEN 'active' WHEN 2 THEN 'cancelled' WHEN 3 THEN 'final' ELSE 'stable' END AS status,
  concat('2024-', lpad(cast(d.doc_id % 12 + 1 AS string), 2, '0'), '-', lpad(cast(d.doc_id % 28 + 1 AS string), 2, '0'), 'T08:00:00', CASE WHEN d.doc_id % 13 = 5 THEN '' ELSE '+00:00' END) AS created_at,
  CASE WHEN d.doc_id % 3 = 0 THEN concat('2024-0', cast(d.doc_id % 9 + 1 AS string), '-15T00:00:00', CASE WHEN d.doc_id % 9 = 6 THEN '' ELSE '+00:00' END) ELSE NULL END AS stale_after,
  d.lang, d.source, CASE d.doc_id % 3 WHEN 0 THEN upper(d.lang) WHEN 1 THEN concat(d.lang, '-', d.source) ELSE concat(d.lang, '_', d.source) END AS tag,
  coalesce(l.toxic, 0) AS flagged, d.text AS body
FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id
"""

#: Typed edges to notes nearby in the order of ids, so that no note is a hub; targets past the last note dangle.
EDGES = """
SELECT concat('n', lpad(cast(doc_id AS string), 9, '0')) AS source_id,
  CASE doc_id % 5 WHEN 0 THEN 'superseded_by' WHEN 1 THEN 'depends_on' WHEN 2 THEN 'related_to' WHEN 3 THEN 'closes' ELSE 'implements' END AS relation_type,
  concat('n', lpad(cast(abs(doc_id + (doc_id * 7 + 3) % 61 - 30) AS string), 9, '0')) AS target_id
FROM documents WHERE doc_id % 2 = 0
UNION ALL
SELECT concat('n', lpad(cast(doc_id AS string), 9, '0')), 'depends_on', concat('n', lpad(cast(doc_id + 1 AS string), 9, '0')) FROM documents WHERE doc_id % 3 = 0
"""

#: Links of pages: each href with the page it stands on.
LINKS = """
SELECT page_id, url, h AS href FROM (SELECT page_id, url, explode(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages) x
"""
LINKS_DUCK = """
SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages
"""

#: Work items from orders: status, assignee, subject, update time.
ITEMS = """
SELECT cast(o_orderkey AS string) AS external_id, cast(o_custkey AS string) AS project, o_orderstatus AS status, o_orderpriority AS priority,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE substring(cast(o_orderdate AS string), 1, 10) END AS updated_at, o_totalprice AS price
FROM orders
"""

#: Decisions' files: with and without a series, with too few digits, of other kinds.
NUMBERED = """SELECT concat('n', lpad(cast(doc_id AS string), 9, '0')) AS concept_id, concat(source, '/Decisions/', CASE doc_id % 6 WHEN 0 THEN concat('adr-', lpad(cast(doc_id % 70 AS string), 4, '0'), '_', lang, '.md') WHEN 1 THEN concat('ADR-', lang, '-', lpad(cast(doc_id % 90 AS string), 5, '0'), '.md')
  WHEN 2 THEN concat('adr-', cast(doc_id % 90 AS string), '_x.md') WHEN 3 THEN concat('adr-', upper(lang), '-', lpad(cast(doc_id % 50 AS string), 4, '0'), '_y.md') WHEN 4 THEN concat('plan-', lpad(cast(doc_id % 50 AS string), 4, '0'), '_z.md') ELSE concat('adr-', lpad(cast(doc_id % 70 AS string), 4, '0'), 'z.md') END) AS path FROM documents"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run fixture SQL over the driver tables it names."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if f" {t}" in sql}
    sql = sql.replace("{", "{{").replace("}", "}}")
    for name in sorted(used, key=len, reverse=True):
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")
    return spark.sql(sql, **used)


def notes(spark, sf_dir):
    return view(spark, sf_dir, NOTES)


def numbered(spark, sf_dir):
    return view(spark, sf_dir, NUMBERED)


def edges(spark, sf_dir):
    return view(spark, sf_dir, EDGES)


def links(spark, sf_dir):
    return view(spark, sf_dir, LINKS)


def items(spark, sf_dir):
    return view(spark, sf_dir, ITEMS)


def with_notes(sql: str) -> str:
    return f"WITH notes AS ({NOTES.replace('AS string', 'AS VARCHAR')}), edges AS ({EDGES.replace('AS string', 'AS VARCHAR')}) {sql}"


def with_links(sql: str) -> str:
    return f"WITH links AS ({LINKS_DUCK}) {sql}"


def with_items(sql: str) -> str:
    return f"WITH items AS ({ITEMS.replace('AS string', 'AS VARCHAR')}) {sql}"


def with_numbered(sql: str) -> str:
    """Numbered files with their folder, series and number."""
    found = "regexp_extract(list_extract(string_split(path, '/'), -1), '^adr-(?:([a-z][a-z0-9]*)-)?([0-9]{{4,}})(?:_|\\.md$)', {n}, 'i')"
    parts = f"SELECT concept_id, regexp_replace(path, '/[^/]*$', '') AS folder, CASE WHEN {found.format(n=0)} <> '' THEN lower({found.format(n=1)}) END AS series, cast(nullif({found.format(n=2)}, '') AS BIGINT) AS number FROM numbered"
    return f"WITH numbered AS ({NUMBERED.replace('AS string', 'AS VARCHAR')}), parts AS ({parts}) {sql}"
