"""Layout, placement, references, drift and passages over paths and texts made from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelake.functions import layout
from notelake.operators import placement, postings, references
from notelake.operators.sizes import broadcast_if_small
from notelake.plans import stem_sql
from notelake.plans.fixtures import table, view
from notelake.plans.registry import query
from notelake.sources.shared import saved

c = F.col

#: Paths of every kind, and types.
PATHS = """SELECT doc_id, CASE doc_id % 11 WHEN 0 THEN 'decision' WHEN 1 THEN 'knowledge' WHEN 2 THEN 'workspace' WHEN 3 THEN 'life_area' WHEN 4 THEN 'goal' WHEN 5 THEN 'standard' WHEN 6 THEN 'dashboard' WHEN 7 THEN 'resource' WHEN 8 THEN 'person' WHEN 9 THEN 'odd' END AS type,
  CASE doc_id % 26 WHEN 0 THEN 'index.md' WHEN 1 THEN 'home.md' WHEN 2 THEN concat('10_Workspaces/', source, '/workspace.md') WHEN 3 THEN concat('10_Workspaces/', source, '/index.md') WHEN 4 THEN concat('10_Workspaces/', source, '/Decisions/adr-0001_', lang, '.md')
    WHEN 5 THEN concat('10_Workspaces/', source, '/Workspaces/', lang, '/Goals/a.md') WHEN 6 THEN concat('10_Workspaces/', source, '/Workspaces/b.md') WHEN 7 THEN '10_Workspaces/index.md' WHEN 8 THEN concat('20_Life/', lang, '/area.md') WHEN 9 THEN concat('20_Life/', lang, '/deep/er/c.md')
    WHEN 10 THEN concat('20_Life/', lang, '/Workspaces/P/Resources/d.md') WHEN 11 THEN concat('20_Life/', lang, '/Workspaces/e.md') WHEN 12 THEN '20_Life/index.md' WHEN 13 THEN '30_Knowledge/Notes/f.md' WHEN 14 THEN concat('30_Knowledge/Notes/', lang, '/g.md') WHEN 15 THEN '30_Knowledge/Maps/index.md'
    WHEN 16 THEN '50_System/Standards/h.md' WHEN 17 THEN concat('50_System/Templates/', lang, '/i.md') WHEN 18 THEN '50_System/Integrations/j.md' WHEN 19 THEN '50_System/Integrations/tool/k.md' WHEN 20 THEN concat('90_Archive/Workspaces/', source, '/Goals/l.md') WHEN 21 THEN '90_Archive/Knowledge/Notes/m.md'
    WHEN 22 THEN '90_Archive/Other/n.md' WHEN 23 THEN '00_Inbox/o.md' WHEN 24 THEN concat('10_Workspaces/', source, '/Workspaces/', lang, '/Workspaces/x/log.md') ELSE concat('10_Workspaces/', source, '/Operations/p.md') END AS path FROM documents"""
#: Where documents of each type may live.
PLACES = (
    ("dashboard", "exact_path", "home.md", False), ("workspace", "workspace_manifest", "", True), ("life_area", "area_manifest", "", True), ("knowledge", "directory", "30_Knowledge/Notes", True), ("person", "area_content", "", True),
    ("goal", "workspace_section", "Goals", True), ("goal", "area_content", "", True), ("decision", "workspace_section", "Decisions", True), ("decision", "area_content", "", True), ("standard", "directory", "50_System/Standards", True), ("standard", "workspace_section", "Operations", True),
    ("resource", "workspace_section", "Resources", False), ("resource", "area_content", "", False),
)


def _paths(spark, sf):
    return view(spark, sf, PATHS)


_SPLIT = f"WITH paths AS (SELECT *, string_split(path, '/') AS s FROM ({PATHS})), more AS (SELECT *, len(s) AS n, s[-1] AS name FROM paths)"
#: The innermost workspace, found by steps: the first name below a root, then names below Workspaces while they are folders.
_WORKSPACE = """CASE WHEN s[1] = '10_Workspaces' AND n > 2 THEN 2 WHEN s[1] = '90_Archive' AND s[2] = 'Workspaces' AND n > 3 THEN 3 WHEN s[1] = '20_Life' AND s[3] = 'Workspaces' AND n > 4 THEN 4 END"""
_DEPTHS = f"""{_SPLIT}, d0 AS (SELECT *, {_WORKSPACE} AS a FROM more), d1 AS (SELECT *, CASE WHEN s[a + 1] = 'Workspaces' AND n > a + 2 THEN a + 2 ELSE a END AS b FROM d0), d AS (SELECT *, CASE WHEN s[b + 1] = 'Workspaces' AND n > b + 2 THEN b + 2 ELSE b END AS w FROM d1)"""


@query("workspace_dir", f"{_DEPTHS} SELECT doc_id, CASE WHEN w IS NOT NULL THEN array_to_string(s[1:w], '/') END AS workspace FROM d")
def workspace_dir(spark, sf):
    return _paths(spark, sf).select("doc_id", layout.workspace_dir(c("path")).alias("workspace"))


@query("workspace_section", f"{_DEPTHS} SELECT doc_id, CASE WHEN n > w + 1 THEN s[w + 1] END AS section FROM d")
def workspace_section(spark, sf):
    return _paths(spark, sf).select("doc_id", layout.workspace_section(c("path")).alias("section"))


@query("area_content", f"{_DEPTHS} SELECT doc_id, s[1] = '20_Life' AND n > 2 AND w IS NULL AND NOT name IN ('area.md', 'index.md', 'log.md') AS own FROM d")
def area_content(spark, sf):
    return _paths(spark, sf).select("doc_id", layout.area_content(c("path")).alias("own"))


@query("flat_area", f"{_SPLIT} SELECT doc_id, CASE WHEN n > 2 AND s[1] = '30_Knowledge' AND s[2] IN ('Notes', 'Maps') THEN concat(s[1], '/', s[2]) END AS area FROM more")
def flat_area(spark, sf):
    return _paths(spark, sf).select("doc_id", layout.flat_area(c("path")).alias("area"))


_EFFECTIVE = "CASE WHEN s[1] = '90_Archive' AND n > 2 THEN CASE s[2] WHEN 'Workspaces' THEN '10_Workspaces/' WHEN 'Life' THEN '20_Life/' WHEN 'Knowledge' THEN '30_Knowledge/' WHEN 'System' THEN '50_System/' ELSE '90_Archive/' || s[2] || '/' END || array_to_string(s[3:], '/') ELSE path END"


@query("effective_path", f"{_SPLIT} SELECT doc_id, {_EFFECTIVE} AS effective, CASE WHEN s[1] = '10_Workspaces' THEN concat('90_Archive/Workspaces/', array_to_string(s[2:], '/')) END AS archived FROM more")
def effective_path(spark, sf):
    """Where an archived note came from, and where a workspace's file goes once it is archived."""
    return _paths(spark, sf).select("doc_id", layout.effective_path(c("path")).alias("effective"), layout.archived_counterpart(c("path")).alias("archived"))


@query("classify_path", f"{_SPLIT} SELECT doc_id, CASE WHEN path = 'index.md' THEN 'root_index' WHEN name = 'index.md' THEN 'directory_index' WHEN name = 'log.md' THEN 'directory_log' WHEN s[1] = '50_System' AND (s[2] IN ('Templates', 'Skills', 'Agents') AND n > 2 OR s[2] = 'Integrations' AND n > 3) THEN 'foreign_format' ELSE 'concept' END AS role FROM more")
def classify_path(spark, sf):
    return _paths(spark, sf).select("doc_id", layout.role(c("path")).alias("role"))


@query("slug", r"""SELECT doc_id, CASE WHEN s IN ('con', 'nul') THEN s || '-concept' WHEN s <> '' THEN s END AS slug FROM (SELECT doc_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(t, '\s+(?:[–—]|-{2,})\s+', '_', 'g'), '[<>:"/\\|?*\x00-\x1f]', ' ', 'g'), '[^\p{L}\p{N}_\s.-]', ' ', 'g')), '\s+', '-', 'g'), '-{2,}', '-', 'g'), '[-_]*_[-_]*', '_', 'g'), '^[-_.]+|[-_.]+$', '', 'g')) AS s
  FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'ADR-0001 — ' || split_part(text, chr(10), 1) WHEN 1 THEN source || ': ' || lang || '/' || lang || ' (3:1)' WHEN 2 THEN CASE WHEN doc_id % 10 = 2 THEN 'NUL' ELSE '!!!' END ELSE split_part(text, chr(10), 1) END AS t FROM documents))""")
def slug(spark, sf):
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    title = F.when(c("doc_id") % 5 == 0, F.concat(F.lit("ADR-0001 — "), first)).when(c("doc_id") % 5 == 1, F.concat("source", F.lit(": "), "lang", F.lit("/"), "lang", F.lit(" (3:1)"))).when(c("doc_id") % 10 == 2, "NUL").when(c("doc_id") % 5 == 2, "!!!").otherwise(first)
    return table(spark, sf, "documents").select("doc_id", layout.slug(title).alias("slug"))


_PLACED = f"""{_SPLIT}, e AS (SELECT doc_id, type, path AS original, s AS given, {_EFFECTIVE} AS path FROM more), e1 AS (SELECT *, string_split(path, '/') AS s FROM e), e2 AS (SELECT *, len(s) AS n, s[-1] AS name FROM e1), d0 AS (SELECT *, {_WORKSPACE} AS a FROM e2),
  d1 AS (SELECT *, CASE WHEN s[a + 1] = 'Workspaces' AND n > a + 2 THEN a + 2 ELSE a END AS b FROM d0), d AS (SELECT *, CASE WHEN s[b + 1] = 'Workspaces' AND n > b + 2 THEN b + 2 ELSE b END AS w FROM d1),
  p AS (SELECT *, coalesce(n > w + 1, false) AS inside, s[w + 1] AS section, s[1] = '20_Life' AND n > 2 AND w IS NULL AND NOT name IN ('area.md', 'index.md', 'log.md') AS own, array_to_string(s[1:n - 1], '/') AS home FROM d)"""


@query("rule_placement", f"""{_PLACED} SELECT original AS path, 'nested_flat_area' AS code, 'error' AS severity FROM p WHERE given[1] = '30_Knowledge' AND given[2] IN ('Notes', 'Maps') AND len(given) > 3
  UNION ALL SELECT original, 'misplaced_document', CASE WHEN type IN ('dashboard', 'resource') THEN 'warning' ELSE 'error' END FROM p WHERE given[1] <> '00_Inbox' AND CASE type WHEN 'dashboard' THEN path <> 'home.md' WHEN 'workspace' THEN NOT coalesce(name = 'workspace.md' AND n = w + 1, false)
    WHEN 'life_area' THEN NOT (s[1] = '20_Life' AND n = 3 AND name = 'area.md') WHEN 'knowledge' THEN NOT (home = '30_Knowledge/Notes' AND name <> 'index.md') WHEN 'person' THEN NOT own WHEN 'goal' THEN NOT (own OR inside AND section = 'Goals') WHEN 'decision' THEN NOT (own OR inside AND section = 'Decisions')
    WHEN 'standard' THEN NOT (home = '50_System/Standards' AND name <> 'index.md' OR inside AND section = 'Operations') WHEN 'resource' THEN NOT (own OR inside AND section = 'Resources') ELSE false END""")
def rule_placement(spark, sf):
    places = spark.createDataFrame(PLACES, "type string, kind string, value string, binding boolean")
    return placement.rule_placement(_paths(spark, sf), places)


#: Agent files that name paths; the roots are a repository, a workspace and the store.
FILES = """SELECT doc_id, concat('repo', source) AS owner, concat('AGENTS-', cast(doc_id AS string), '.md') AS file,
  concat('See [a](docs/', cast(doc_id % 40 AS string), '.md), [b](./Context/', lang, '.md) and [c](50_System/x', cast(doc_id % 7 AS string), '.json) [again](docs/', cast(doc_id % 40 AS string), '.md) [web](https://a.b/c.md) [glob](docs/*.md) [out](../', lang, '.py) [bare](x.md) [#](#a/b.md) ', substring(text, 1, 50)) AS text FROM documents"""
LISTING = """SELECT concat('repo', source) AS root, concat('docs/', cast(doc_id % 20 AS string), '.md') AS path FROM documents UNION ALL SELECT concat('space-', source), concat('Context/', lang, '.md') FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'store', concat('50_System/x', cast(doc_id % 3 AS string), '.json') FROM documents"""


@query("broken_references", f"""WITH files AS ({FILES.replace('AS string', 'AS VARCHAR')}), listing AS (SELECT DISTINCT root, path FROM ({LISTING.replace('AS string', 'AS VARCHAR')})),
  refs AS (SELECT DISTINCT owner, file, r AS reference FROM (SELECT owner, file, unnest(regexp_extract_all(text, '\\]\\(([^)\\s]+)\\)', 1)) AS r FROM files) WHERE contains(r, '/') AND NOT contains(r, '://') AND NOT starts_with(r, '#') AND regexp_matches(r, '\\.(md|py|toml|yml|yaml|json|sh|cfg|ini)$') AND NOT regexp_matches(r, '[*?\\[\\]<>]'))
  SELECT owner, file, reference FROM refs WHERE NOT EXISTS (SELECT 1 FROM listing WHERE root IN (owner, replace(owner, 'repo', 'space-'), 'store') AND path = regexp_replace(reference, '^\\./', ''))""")
def broken_references(spark, sf):
    files = view(spark, sf, FILES).withColumn("roots", F.array("owner", F.replace("owner", F.lit("repo"), F.lit("space-")), F.lit("store")))
    return references.broken_references(files, view(spark, sf, LISTING))


#: Material by subject (a source's documents in blocks), as recorded and as it is.
NOW = "SELECT concat(source, '-', cast(doc_id - doc_id % 200 AS string)) AS subject, (doc_id - doc_id % 200) / 200 AS block, doc_id, concat(lang, '/', cast(doc_id AS string), '.md') AS path, sha256(text) AS digest FROM documents"
_THEN = "SELECT subject, path, CASE WHEN doc_id % 17 = 3 THEN concat(digest, 'x') ELSE digest END AS digest FROM now WHERE doc_id % 19 <> 4 AND block % 4 <> 1 AND block % 7 <> 3 UNION ALL SELECT subject, concat('gone/', path), digest FROM now WHERE doc_id % 23 = 5 AND block % 4 <> 1 AND block % 7 <> 3 UNION ALL SELECT subject, path, digest FROM now WHERE block % 4 = 1 AND block % 7 <> 3"
_RECORDS = "SELECT DISTINCT subject, CASE WHEN block % 7 <> 5 THEN 'digest' END AS tree_digest, CASE WHEN block % 3 = 0 THEN 'ahead' WHEN block % 3 = 1 THEN 'current' ELSE 'unknown' END AS upstream FROM now WHERE block % 7 <> 3 UNION ALL SELECT DISTINCT concat('old-', subject), 'digest', 'current' FROM now WHERE block % 5 = 0"


@query("provenance_drift", f"""WITH now AS (SELECT * REPLACE (cast(block AS BIGINT) AS block) FROM ({NOW.replace('AS string', 'AS VARCHAR')})), recorded AS ({_RECORDS}), was AS ({_THEN}),
  moved AS (SELECT subject, list_sort(list(path)) AS changed FROM (SELECT coalesce(n.subject, w.subject) AS subject, coalesce(n.path, w.path) AS path FROM now n FULL JOIN was w ON n.subject = w.subject AND n.path = w.path WHERE n.digest IS DISTINCT FROM w.digest) GROUP BY subject),
  present AS (SELECT DISTINCT subject FROM now), j AS (SELECT coalesce(r.subject, p.subject) AS subject, CASE WHEN r.subject IS NULL THEN 'missing' WHEN p.subject IS NULL THEN 'orphaned' WHEN tree_digest IS NULL THEN 'incomplete' ELSE 'recorded' END AS state, upstream FROM recorded r FULL JOIN present p ON r.subject = p.subject)
  SELECT subject, state, CASE WHEN state = 'recorded' THEN CASE WHEN changed IS NOT NULL AND upstream = 'ahead' THEN 'both' WHEN changed IS NOT NULL THEN 'local' WHEN upstream = 'ahead' THEN 'upstream' ELSE 'none' END END AS drift, CASE WHEN state = 'recorded' THEN coalesce(changed, []) END AS changed FROM j LEFT JOIN moved USING (subject)""")
def provenance_drift(spark, sf):
    now = view(spark, sf, NOW.replace("sha256(text)", "sha2(text, 256)")).withColumn("block", c("block").cast("long"))
    records, was = (spark.sql(s.replace("FROM now", "FROM {now}"), now=now) for s in (_RECORDS, _THEN))
    return references.provenance_drift(records, was, now.select("subject", "path", "digest"))


_PARTS = "SELECT doc_id AS owner, place, part, md5(concat(cast(doc_id AS VARCHAR), '-', cast(place AS VARCHAR), '-', part)) AS chunk_key FROM (SELECT doc_id, generate_subscripts(p, 1) - 1 AS place, unnest(p) AS part FROM (SELECT doc_id, string_split({text}, chr(10)) AS p FROM documents WHERE {which}))"


def _chunks(docs, text):
    cut = docs.select(c("doc_id").alias("owner"), F.posexplode(F.split(text, "\n")).alias("ordinal", "text"))
    return cut.withColumn("chunk_key", F.md5(F.concat_ws("-", c("owner").cast("string"), c("ordinal").cast("string"), "text")))


@query("hit_passage", f"""WITH was AS ({_PARTS.format(text='text', which='true')}), now AS ({_PARTS.format(text="CASE WHEN doc_id % 3 = 0 THEN concat('New beginning.', chr(10), text) WHEN doc_id % 3 = 1 THEN concat(text, chr(10), 'more') ELSE text END", which='doc_id % 7 <> 4')}),
  {stem_sql.stems({'was': 'part', 'benchmark': 'text'})}, held AS (SELECT chunk_key, stem AS token FROM (SELECT chunk_key, unnest({stem_sql.words('part')}) AS token FROM was) JOIN stems USING (token)), lens AS (SELECT chunk_key, len({stem_sql.words('part')}) AS len FROM was), st AS (SELECT count(*) AS n, avg(len) AS a FROM lens), tf AS (SELECT chunk_key, token, count(*)::DOUBLE AS f FROM held GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
  asked AS (SELECT DISTINCT query_id, stem AS token FROM (SELECT item_id AS query_id, unnest({stem_sql.words('text')}) AS token FROM benchmark) JOIN stems USING (token)),
  scored AS (SELECT query_id, chunk_key, round(sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / a))), 9) AS score FROM asked JOIN df USING (token) JOIN tf USING (token) JOIN lens USING (chunk_key), st GROUP BY 1, 2),
  hits AS (SELECT query_id, owner, chunk_key FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_key) AS rank FROM scored) JOIN was USING (chunk_key) WHERE rank <= 5), met AS (SELECT h.*, coalesce(n.part, o.part) AS t, coalesce(n.place, o.place) AS line, n.chunk_key IS NULL AS moved FROM hits h LEFT JOIN now n USING (chunk_key) LEFT JOIN now o ON o.owner = h.owner AND o.place = 0),
  flat AS (SELECT *, trim(regexp_replace(t, '[ \\t\\n\\r\\f]+', ' ', 'g')) AS f FROM met) SELECT query_id, owner, coalesce(CASE WHEN f IS NULL THEN '' WHEN length(f) <= 320 THEN f ELSE concat(rtrim(left(f, 319)), '…') END, '') AS passage, cast(line AS INTEGER) AS start_line, moved FROM flat""")
def hit_passage(spark, sf):
    """Each item's first five paragraphs of the index, shown from documents some of which changed or left since."""
    docs = table(spark, sf, "documents")
    was = _chunks(docs, c("text"))
    text = F.when(c("doc_id") % 3 == 0, F.concat(F.lit("New beginning.\n"), "text")).when(c("doc_id") % 3 == 1, F.concat("text", F.lit("\nmore"))).otherwise(c("text"))
    now = _chunks(docs.filter("doc_id % 7 <> 4"), text).withColumns({"start_line": c("ordinal"), "end_line": c("ordinal")})
    index = postings.index_of(was.select("owner", c("chunk_key").alias("chunk"), "text"), {"text": "text"})
    asked = table(spark, sf, "benchmark").select(c("item_id").alias("query_id"), "text")
    found = postings.search_index(index, asked, 5).select("query_id", c("chunk").alias("chunk_key"))
    hits = was.select("owner", "chunk_key").join(broadcast_if_small(saved(found, "found")), "chunk_key").distinct()
    return references.hit_passages(hits, now).select("query_id", "owner", "passage", "start_line", "moved")
