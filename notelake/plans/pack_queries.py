"""Startup packs of every source's workspace, from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelake.operators import packs
from notelake.plans.fixtures import view
from notelake.plans.registry import query

c = F.col

#: Records of each source's workspace: every type, some archived, some of no workspace; and the workspaces themselves.
RECORDS = """SELECT concat('d', lpad(cast(doc_id AS string), 9, '0')) AS concept_id, CASE doc_id % 9 WHEN 0 THEN 'context' WHEN 1 THEN 'standard' WHEN 2 THEN 'goal' WHEN 3 THEN 'decision' WHEN 4 THEN 'plan' WHEN 5 THEN 'walkthrough' WHEN 6 THEN 'task' WHEN 7 THEN 'activity_log' ELSE 'knowledge' END AS type,
  concat(CASE WHEN doc_id % 13 = 5 THEN '90_Archive/' WHEN doc_id % 36 = 1 THEN '50_System/' ELSE '10_Workspaces/' END, source, '/', lang, '/', cast(doc_id AS string), '.md') AS path, concat(lang, ' ', cast(doc_id AS string)) AS title, CASE WHEN doc_id % 36 = 1 THEN NULL ELSE concat('w-', source) END AS workspace_id,
  CASE doc_id % 7 WHEN 0 THEN 'accepted' WHEN 1 THEN 'active' WHEN 2 THEN 'draft' WHEN 3 THEN 'in_progress' WHEN 4 THEN 'done' WHEN 5 THEN 'superseded' END AS lifecycle, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE concat('2024-', lpad(cast(doc_id % 12 + 1 AS string), 2, '0'), '-01') END AS created_at,
  CASE WHEN doc_id % 4 = 0 THEN concat('2025-', lpad(cast(doc_id % 12 + 1 AS string), 2, '0'), '-01') WHEN doc_id % 4 = 1 THEN '' END AS occurred_at, CASE WHEN doc_id % 8 = 0 THEN 'week' END AS covers, CASE WHEN doc_id % 3 = 0 THEN concat('About ', lang) END AS description, doc_id % 10 = 3 AS stale, n_chars AS characters,
  CASE doc_id % 18 WHEN 1 THEN true WHEN 10 THEN CASE WHEN doc_id % 4 = 0 THEN false END END AS required_reading FROM documents
UNION ALL SELECT DISTINCT concat('w-', source), 'workspace', concat('10_Workspaces/', source, '/workspace.md'), source, concat('w-', source), 'active', '2024-01-01', NULL, NULL, NULL, false, cast(100 AS bigint), cast(NULL AS boolean) FROM documents"""
#: Each source's workspace, and its chain of parents: halves of its number.
_SCOPES = "SELECT DISTINCT concat('w-', source) AS scope_id FROM documents"
_PARENTS = " UNION ALL ".join(f"SELECT DISTINCT concat('w-', source) AS scope_id, concat('w-src', cast(floor(cast(substring(source, 4, 9) AS int) / {2**d}) AS int)) AS parent_id, {d} AS depth FROM documents WHERE cast(substring(source, 4, 9) AS int) >= {2**d}" for d in (1, 2))
#: Standards that except another one of the list of standards, and what a search found for each scope.
_EXCEPTS = "SELECT concat('d', lpad(cast(doc_id AS string), 9, '0')) AS source_id, concat('d', lpad(cast(doc_id - 9 AS string), 9, '0')) AS target_id FROM documents WHERE doc_id % 9 = 1 AND doc_id % 27 <> 1"
_FUSED = "SELECT concat('w-', source) AS scope_id, concat('d', lpad(cast(doc_id AS string), 9, '0')) AS concept_id, cast(doc_id % 150 + 1 AS int) AS rank FROM documents WHERE doc_id % 4 = 0"


def _inputs(spark, sf):
    return [view(spark, sf, s) for s in (_SCOPES, _PARENTS, RECORDS)]


def _duck(sql: str) -> str:
    return sql.replace("AS string", "AS VARCHAR").replace("AS int)", "AS INTEGER)").replace("AS bigint", "AS BIGINT")


_BANDS = f"""WITH RECURSIVE records AS ({_duck(RECORDS)}), scopes AS ({_SCOPES}), parents AS ({_duck(_PARENTS)}), excepts AS ({_duck(_EXCEPTS)}), fused AS ({_duck(_FUSED)}), chain AS (SELECT scope_id, scope_id AS at_id, 0 AS depth FROM scopes UNION ALL SELECT * FROM parents),
  live AS (SELECT * FROM records WHERE NOT starts_with(path, '90_Archive/')), own AS (SELECT c.scope_id, r.*, CASE WHEN depth = 0 THEN 'workspace' ELSE 'parent' END AS category, depth AS priority, false AS binding FROM chain c JOIN records r ON r.concept_id = c.at_id),
  sec AS (SELECT s.scope_id, r.* FROM live r JOIN scopes s ON r.workspace_id = s.scope_id),
  std AS (SELECT *, CASE WHEN workspace_id IS NULL THEN '' ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END AS folder FROM (SELECT c.scope_id, r.* FROM live r JOIN chain c ON r.workspace_id = c.at_id WHERE r.type = 'standard' UNION ALL SELECT s.scope_id, r.* FROM live r CROSS JOIN scopes s WHERE r.type = 'standard' AND r.workspace_id IS NULL)),
  turns AS (SELECT *, row_number() OVER (PARTITION BY scope_id, folder ORDER BY path, concept_id) AS turn FROM std),
  ranked AS (
    SELECT scope_id, concept_id, 'context' AS category, 50 AS band, row_number() OVER (PARTITION BY scope_id ORDER BY path, concept_id) AS n, false AS binding FROM sec WHERE type = 'context'
    UNION ALL SELECT scope_id, concept_id, 'standard', 100, row_number() OVER (PARTITION BY scope_id ORDER BY turn, folder, concept_id), true FROM turns
    UNION ALL SELECT scope_id, concept_id, 'goal', 200, row_number() OVER (PARTITION BY scope_id ORDER BY path, concept_id), false FROM sec WHERE type = 'goal' AND lifecycle IN ('proposed', 'active')
    UNION ALL SELECT scope_id, concept_id, 'decision', 300, row_number() OVER (PARTITION BY scope_id ORDER BY CASE lifecycle WHEN 'accepted' THEN 0 WHEN 'proposed' THEN 1 WHEN 'superseded' THEN 2 WHEN 'rejected' THEN 3 ELSE 4 END, coalesce(created_at, '') DESC, path, concept_id), coalesce(lifecycle = 'accepted', false) FROM sec WHERE type = 'decision'
    UNION ALL SELECT scope_id, concept_id, 'plan', 400, row_number() OVER (PARTITION BY scope_id ORDER BY coalesce(created_at, '') DESC, path, concept_id), false FROM sec WHERE type = 'plan' AND lifecycle IN ('draft', 'active')
    UNION ALL SELECT scope_id, concept_id, 'walkthrough', 400, row_number() OVER (PARTITION BY scope_id ORDER BY coalesce(created_at, '') DESC, path, concept_id), false FROM sec WHERE type = 'walkthrough' AND lifecycle = 'in_progress'
    UNION ALL SELECT scope_id, concept_id, 'task', 500, row_number() OVER (PARTITION BY scope_id ORDER BY path, concept_id), false FROM sec WHERE type = 'task' AND NOT coalesce(lifecycle, '') IN ('done', 'cancelled')
    UNION ALL SELECT scope_id, concept_id, 'activity', 600, row_number() OVER (PARTITION BY scope_id ORDER BY coalesce(nullif(occurred_at, ''), nullif(created_at, ''), '') DESC, concept_id), false FROM sec WHERE type = 'activity_log'),
  items AS (SELECT k.scope_id, k.concept_id, category, cast(band + least(n - 1, 99) AS INTEGER) AS priority, binding, stale, CASE WHEN category <> 'walkthrough' THEN characters END AS characters, title, path, description FROM ranked k JOIN records r USING (concept_id)
    UNION ALL SELECT scope_id, concept_id, category, cast(priority AS INTEGER), binding, stale, characters, title, path, description FROM own)"""
_REQUIRED = f"""{_BANDS}, must(scope_id, concept_id) AS (SELECT i.scope_id, i.concept_id FROM items i JOIN records r USING (concept_id) WHERE category = 'standard' AND coalesce(required_reading, starts_with(r.path, '50_System/'))
    UNION SELECT i.scope_id, i.concept_id FROM items i JOIN excepts e ON i.concept_id = e.source_id JOIN must m ON m.scope_id = i.scope_id AND m.concept_id = e.target_id WHERE i.category = 'standard'),
  handoff AS (SELECT scope_id, arg_min(concept_id, row(priority, concept_id)) AS h FROM items JOIN records USING (concept_id) WHERE category = 'activity' AND covers IS NULL GROUP BY scope_id),
  marked AS (SELECT i.*, category IN ('workspace', 'parent', 'context') OR (category = 'standard' AND m.concept_id IS NOT NULL) OR (category = 'activity' AND coalesce(i.concept_id = h, false)) AS required FROM items i LEFT JOIN must m ON m.scope_id = i.scope_id AND m.concept_id = i.concept_id LEFT JOIN handoff o ON o.scope_id = i.scope_id)"""
_FOUND = """SELECT f.scope_id, f.concept_id, 'retrieved' AS category, cast(700 + least(f.rank - 1, 99) AS INTEGER) AS priority, false AS binding, r.stale, r.characters, r.title, r.path, cast(NULL AS VARCHAR) AS description FROM fused f JOIN records r USING (concept_id) WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.scope_id = f.scope_id AND i.concept_id = f.concept_id)"""
#: Caps, ceiling, room, and the walk over the bodies as a recursion over places.
_PACK = f"""{_REQUIRED}, everything AS (SELECT * FROM marked UNION ALL SELECT *, false FROM ({_FOUND})), capped AS (SELECT *, sum(CASE WHEN binding THEN 0 ELSE 1 END) OVER (PARTITION BY scope_id, category ORDER BY priority, concept_id) AS used FROM everything),
  kept AS (SELECT *, row_number() OVER (PARTITION BY scope_id, binding OR required ORDER BY priority, concept_id) AS r FROM capped WHERE binding OR required OR used <= CASE category WHEN 'context' THEN 8 WHEN 'standard' THEN 6 WHEN 'goal' THEN 6 WHEN 'decision' THEN 8 WHEN 'plan' THEN 6 WHEN 'walkthrough' THEN 3 WHEN 'task' THEN 10 WHEN 'activity' THEN 3 WHEN 'retrieved' THEN 5 ELSE 1000000000 END),
  pack AS (SELECT *, cast(row_number() OVER (PARTITION BY scope_id ORDER BY priority, concept_id) AS INTEGER) AS place FROM kept WHERE binding OR required OR r <= 40),
  rooms AS (SELECT scope_id, greatest(0, least(16000, 19000 - sum(length(title) + 110 + CASE WHEN required THEN length(path) + 90 ELSE 0 END + CASE WHEN description <> '' THEN length(description) + 16 ELSE 0 END))) AS room FROM pack GROUP BY scope_id),
  line AS (SELECT p.*, room, row_number() OVER (PARTITION BY scope_id ORDER BY NOT required, NOT binding, stale, place) AS turn FROM pack p JOIN rooms USING (scope_id)),
  walk(scope_id, concept_id, place, turn, spent, bodies, fulls, reason) AS (SELECT scope_id, NULL::VARCHAR, NULL::INTEGER, 0::BIGINT, 0::BIGINT, 0::BIGINT, false, NULL::VARCHAR FROM rooms
    UNION ALL SELECT l.scope_id, l.concept_id, l.place, l.turn, w.spent + CASE WHEN l.characters IS NULL OR l.characters > room OR w.bodies >= 40 OR w.spent + l.characters > room THEN 0 ELSE l.characters END, w.bodies + CASE WHEN l.characters IS NULL OR l.characters > room OR w.bodies >= 40 OR w.spent + l.characters > room THEN 0 ELSE 1 END,
      NOT (l.characters IS NULL OR l.characters > room OR w.bodies >= 40 OR w.spent + l.characters > room), CASE WHEN l.characters > room THEN 'larger than budget' WHEN l.characters IS NOT NULL AND w.bodies >= 40 THEN 'document limit' WHEN w.spent + l.characters > room THEN 'budget spent' END FROM walk w JOIN line l ON l.scope_id = w.scope_id AND l.turn = w.turn + 1)"""


@query("structural_items", f"{_BANDS} SELECT scope_id, concept_id, category, priority, binding, characters FROM items")
def structural_items(spark, sf):
    return packs.structural_items(*_inputs(spark, sf)).select("scope_id", "concept_id", "category", "priority", "binding", "characters")


def _marked(spark, sf):
    scopes, parents, records = _inputs(spark, sf)
    return packs.mark_required(packs.structural_items(scopes, parents, records), records, view(spark, sf, _EXCEPTS))


@query("mark_required", f"{_REQUIRED} SELECT scope_id, concept_id, category, required FROM marked")
def mark_required(spark, sf):
    return _marked(spark, sf).select("scope_id", "concept_id", "category", "required")


@query("retrieved_items", f"{_BANDS} SELECT scope_id, concept_id, priority FROM ({_FOUND})")
def retrieved_items(spark, sf):
    scopes, parents, records = _inputs(spark, sf)
    return packs.retrieved_items(view(spark, sf, _FUSED), packs.structural_items(scopes, parents, records), records).select("scope_id", "concept_id", "priority")


def _startup(spark, sf):
    scopes, parents, records = _inputs(spark, sf)
    return packs.startup_pack(scopes, parents, records, view(spark, sf, _EXCEPTS), view(spark, sf, _FUSED))


@query("startup_pack", f"{_PACK} SELECT scope_id, concept_id, place, fulls AS full, reason FROM walk WHERE turn > 0")
def startup_pack(spark, sf):
    return _startup(spark, sf)


@query("apply_budget", f"{_PACK} SELECT scope_id, count(CASE WHEN fulls THEN 1 END) AS bodies, count(CASE WHEN reason = 'larger than budget' THEN 1 END) AS larger, count(CASE WHEN reason = 'budget spent' THEN 1 END) AS spent, count(*) AS items FROM walk WHERE turn > 0 GROUP BY scope_id")
def apply_budget(spark, sf):
    """How the bodies of each pack fared."""
    made = _startup(spark, sf)
    return made.groupBy("scope_id").agg(F.count_if("full").alias("bodies"), F.count_if(c("reason") == "larger than budget").alias("larger"), F.count_if(c("reason") == "budget spent").alias("spent"), F.count("*").alias("items"))


@query("index_room", f"{_REQUIRED} SELECT scope_id, cast(greatest(0, least(16000, 19000 - sum(length(title) + 110 + CASE WHEN required THEN length(path) + 90 ELSE 0 END + CASE WHEN description <> '' THEN length(description) + 16 ELSE 0 END))) AS BIGINT) AS room FROM marked WHERE category IN ('workspace', 'parent', 'goal', 'activity') GROUP BY scope_id")
def index_room(spark, sf):
    return packs.index_room(_marked(spark, sf).filter(c("category").isin("workspace", "parent", "goal", "activity")))


@query("pack_usage", f"""{_PACK}, u AS (SELECT scope_id, count(*) AS items, sum(CASE WHEN fulls THEN characters ELSE 0 END) AS characters, count(CASE WHEN fulls THEN 1 END) AS full_documents, sum(CASE WHEN required THEN coalesce(characters, 0) ELSE 0 END) AS required_characters FROM walk JOIN (SELECT scope_id, concept_id, characters, required FROM pack) USING (scope_id, concept_id) GROUP BY scope_id)
  SELECT u.scope_id, items, cast(u.characters AS BIGINT) AS characters, full_documents, (SELECT count(*) FROM everything e WHERE e.scope_id = u.scope_id) - items AS dropped, cast(required_characters AS BIGINT) AS required_characters, cast(ceil(u.characters / 4) AS BIGINT) AS tokens FROM u""")
def pack_usage(spark, sf):
    scopes, parents, records = _inputs(spark, sf)
    structural = packs.structural_items(scopes, parents, records)
    items = packs.mark_required(structural, records, view(spark, sf, _EXCEPTS))
    items = items.unionByName(packs.retrieved_items(view(spark, sf, _FUSED), structural, records).withColumn("required", F.lit(False)))
    return packs.pack_usage(packs.apply_budget(items), items)
