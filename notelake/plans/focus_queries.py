"""Focused and deep packs of every source's workspace: hits from documents, edges between them."""

from __future__ import annotations

from notelake.operators import focus, packs
from notelake.plans import fixtures
from notelake.plans import pack_queries as base
from notelake.plans.fixtures import view
from notelake.plans.registry import query

#: What a search found for each scope, documents of other workspaces and knowledge among it, and how many count.
HITS = "SELECT concat('w-', source) AS scope_id, concat('d', lpad(cast(doc_id AS string), 9, '0')) AS concept_id, cast(doc_id % 50 + 1 AS int) AS rank FROM documents WHERE doc_id % 3 <> 1 UNION ALL SELECT concat('w-', source), concat('d', lpad(cast(doc_id + 7 AS string), 9, '0')), cast(doc_id % 90 + 1 AS int) FROM documents WHERE doc_id % 4 = 0"
LIMIT = 200
LINKS = fixtures.EDGES.replace("'n'", "'d'")

_ASSERTED = "NOT relation_type IN ('links_to', 'parent', 'superseded_by', 'closes')"


def _lanes(depth: int, knowledge: bool) -> str:
    """Both lanes: admissible edges of the first ten, each document by its first edge, hop by hop."""
    scoped = "x.concept_id = r.concept_id AND NOT starts_with(r.path, '90_Archive/') AND (EXISTS (SELECT 1 FROM chain c WHERE c.scope_id = x.scope_id AND c.at_id = r.workspace_id)" + (" OR r.type IN ('knowledge', 'map'))" if knowledge else ")")
    sql = f""", hits AS ({base._duck(HITS)}), links AS ({base._duck(LINKS)}),
  found AS (SELECT * FROM (SELECT scope_id, concept_id, cast(row_number() OVER (PARTITION BY scope_id ORDER BY at_rank, concept_id) AS INTEGER) AS rank FROM (SELECT x.scope_id, x.concept_id, min(x.rank) AS at_rank FROM hits x JOIN records r ON {scoped} GROUP BY ALL)) WHERE rank <= {LIMIT}),
  ways AS (SELECT source_id AS node, 0 AS back, relation_type, target_id AS other FROM links UNION ALL SELECT target_id, 1, relation_type, source_id FROM links), front0 AS (SELECT scope_id, concept_id AS node, rank AS at_rank FROM found WHERE rank <= 10)"""
    for hop in range(1, depth + 1):
        before = "".join(f" AND NOT EXISTS (SELECT 1 FROM hop{h} b WHERE b.scope_id = x.scope_id AND b.concept_id = x.concept_id)" for h in range(1, hop))
        offset = " + ".join(["0", *(f"(SELECT count(*) FROM hop{h} b WHERE b.scope_id = y.scope_id)" for h in range(1, hop))])
        sql += f""", met{hop} AS (SELECT f.scope_id, w.other AS concept_id, f.at_rank, w.back, w.relation_type FROM front{hop - 1} f JOIN ways w USING (node)),
  hop{hop} AS (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY at_rank, back, relation_type, concept_id) AS place, cast(place + {offset} AS INTEGER) AS rank, {hop} AS hop FROM (SELECT x.* FROM met{hop} x JOIN records r ON {scoped} WHERE (({_ASSERTED}) OR NOT EXISTS (SELECT 1 FROM found k WHERE k.scope_id = x.scope_id AND k.concept_id = x.concept_id)){before}
    QUALIFY row_number() OVER (PARTITION BY x.scope_id, x.concept_id ORDER BY at_rank, back, relation_type) = 1) y), front{hop} AS (SELECT scope_id, concept_id AS node, place AS at_rank FROM hop{hop} WHERE place <= 10)"""
    return sql + ", reached AS (" + " UNION ALL ".join(f"SELECT scope_id, concept_id, rank, hop, relation_type FROM hop{h}" for h in range(1, depth + 1)) + ")"


def _fused(depth: int, knowledge: bool) -> str:
    """Lanes fused by reciprocal ranks, then eight moves at most of a replacement to the place of what it replaces."""
    sql = _lanes(depth, knowledge) + """, moved0 AS (SELECT scope_id, concept_id, row_number() OVER (PARTITION BY scope_id ORDER BY score DESC, concept_id) AS p FROM (SELECT scope_id, concept_id, round(sum(1.0 / (60 + rank)), 12) AS score FROM (SELECT scope_id, concept_id, rank FROM found UNION ALL SELECT scope_id, concept_id, rank FROM reached) GROUP BY ALL))"""
    for k in range(8):
        sql += f""", move{k} AS (SELECT o.scope_id, o.p AS i, max(n.p) AS j FROM moved{k} o JOIN links l ON l.source_id = o.concept_id AND l.relation_type = 'superseded_by' JOIN moved{k} n ON n.scope_id = o.scope_id AND n.concept_id = l.target_id AND n.p > o.p GROUP BY o.scope_id, o.p QUALIFY row_number() OVER (PARTITION BY o.scope_id ORDER BY o.p) = 1),
  moved{k + 1} AS (SELECT o.scope_id, o.concept_id, CASE WHEN o.p = j THEN i WHEN o.p >= i AND o.p < j THEN o.p + 1 ELSE o.p END AS p FROM moved{k} o LEFT JOIN move{k} m USING (scope_id))"""
    return sql + ", ordered AS (SELECT scope_id, concept_id, cast(p AS INTEGER) AS rank FROM moved8)"


def _budget(everything: str, caps: dict[str, int], most: int, room: str) -> str:
    """Caps, ceiling and the walk over the bodies of items that none requires."""
    cap = " ".join(f"WHEN '{k}' THEN {v}" for k, v in caps.items())
    fits = f"(l.characters IS NOT NULL AND l.characters <= room AND w.bodies < {most} AND w.spent + l.characters <= room)"
    return f""", everything AS ({everything}), capped AS (SELECT *, sum(CASE WHEN binding THEN 0 ELSE 1 END) OVER (PARTITION BY scope_id, category ORDER BY priority, concept_id) AS used FROM everything),
  kept AS (SELECT *, row_number() OVER (PARTITION BY scope_id, binding ORDER BY priority, concept_id) AS r FROM capped WHERE binding OR used <= CASE category {cap} ELSE 1000000000 END),
  pack AS (SELECT *, cast(row_number() OVER (PARTITION BY scope_id ORDER BY priority, concept_id) AS INTEGER) AS place FROM kept WHERE binding OR r <= {most}), rooms AS (SELECT scope_id, {room} AS room FROM pack GROUP BY scope_id),
  line AS (SELECT p.*, room, row_number() OVER (PARTITION BY scope_id ORDER BY NOT binding, stale, place) AS turn FROM pack p JOIN rooms USING (scope_id)),
  walk(scope_id, concept_id, place, turn, spent, bodies, fulls, reason) AS (SELECT scope_id, NULL::VARCHAR, NULL::INTEGER, 0::BIGINT, 0::BIGINT, 0::BIGINT, false, NULL::VARCHAR FROM rooms
    UNION ALL SELECT l.scope_id, l.concept_id, l.place, l.turn, w.spent + CASE WHEN {fits} THEN l.characters ELSE 0 END, w.bodies + CASE WHEN {fits} THEN 1 ELSE 0 END, {fits},
      CASE WHEN l.characters > room THEN 'larger than budget' WHEN l.characters IS NOT NULL AND w.bodies >= {most} THEN 'document limit' WHEN w.spent + l.characters > room THEN 'budget spent' END FROM walk w JOIN line l ON l.scope_id = w.scope_id AND l.turn = w.turn + 1)
  SELECT scope_id, concept_id, place, fulls AS full, reason FROM walk WHERE turn > 0"""


_FOCUSED = "SELECT o.scope_id, o.concept_id, CASE r.type WHEN 'workspace' THEN 'workspace' WHEN 'context' THEN 'context' WHEN 'standard' THEN 'standard' WHEN 'decision' THEN 'decision' WHEN 'task' THEN 'task' WHEN 'activity_log' THEN 'activity' ELSE 'retrieved' END AS category, o.rank - 1 AS priority, false AS binding, r.stale, r.characters, r.title, r.path, cast(NULL AS VARCHAR) AS description FROM ordered o JOIN records r USING (concept_id)"
_STRUCTURE = base._BANDS.replace("sec AS (SELECT s.scope_id, r.* FROM live r JOIN scopes s ON r.workspace_id = s.scope_id)", "sec AS (SELECT c.scope_id, r.* FROM live r JOIN chain c ON r.workspace_id = c.at_id)")
_DEEP = "SELECT * FROM items UNION ALL SELECT o.scope_id, o.concept_id, 'retrieved', cast(700 + least(o.rank - 1, 99) AS INTEGER), false, r.stale, r.characters, r.title, r.path, cast(NULL AS VARCHAR) FROM ordered o JOIN records r USING (concept_id) WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.scope_id = o.scope_id AND i.concept_id = o.concept_id)"


def _inputs(spark, sf):
    return [*base._inputs(spark, sf), view(spark, sf, HITS), view(spark, sf, LINKS)]


@query("union_candidates", f"{base._BANDS}{_lanes(2, False)} SELECT scope_id AS query_id, concept_id AS owner, 'lexical' AS retriever, rank FROM found UNION ALL SELECT scope_id, concept_id, 'graph', rank FROM reached")
def union_candidates(spark, sf):
    """The lexical lane, and two hops of the graph's."""
    scopes, parents, records, hits, edges = _inputs(spark, sf)
    chain = focus.chains(scopes, parents)
    found = focus.lexical_lane(hits, chain, records, limit=LIMIT)
    return focus.union_candidates(found, focus.graph_lane(found, edges, chain, records, depth=2))


@query("focused_items", f"{base._BANDS}{_fused(1, False)} SELECT scope_id, concept_id, category, priority, stale, characters FROM ({_FOCUSED})")
def focused_items(spark, sf):
    scopes, parents, records, hits, edges = _inputs(spark, sf)
    made = focus.focused_items(focus.retrieve(scopes, parents, records, hits, edges, limit=LIMIT), records)
    return made.select("scope_id", "concept_id", "category", "priority", "stale", "characters")


_LEFT = "greatest(0, least(16000, 19000 - sum(length(title) + 110)))"


@query("focused_pack", f"{base._BANDS}{_fused(1, False)}{_budget(_FOCUSED, packs.CAPS, packs.ITEMS, _LEFT)}")
def focused_pack(spark, sf):
    return focus.focused_pack(*_inputs(spark, sf), limit=LIMIT)


@query("deep_pack", f"{_STRUCTURE}{_fused(2, True)}{_budget(_DEEP, packs.DEEP_CAPS, packs.DEEP_ITEMS, '120000')}")
def deep_pack(spark, sf):
    return focus.deep_pack(*_inputs(spark, sf), limit=LIMIT)
