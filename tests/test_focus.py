"""Lanes of focused packs against a walk that takes hits, neighbours and hops one after the other."""

import random

import pytest

from notelake.operators import focus

RECORD = "concept_id string, workspace_id string, type string, path string"
TYPES = ("links_to", "depends_on", "superseded_by", "related_to", "closes", "own_kind")


def walk(found, edges, offered, depth):
    ways = lambda node: [*sorted((t, b) for a, t, b in edges if a == node), *sorted((t, a) for a, t, b in edges if b == node)]
    visited, reached, frontier = set(), [], found[:10]
    for hop in range(1, depth + 1):
        new = []
        for node in frontier:
            for kind, other in ways(node):
                if other in visited or other not in offered or (other in found and kind in ("links_to", "parent", "superseded_by", "closes")):
                    continue
                visited.add(other)
                new.append(other)
                reached.append((other, len(reached) + 1, hop, kind))
        frontier = new[:10]
    return reached


@pytest.mark.parametrize("depth, knowledge", [(1, False), (2, True)])
def test_lanes_equal_the_walk(spark, depth, knowledge):
    rng = random.Random(depth)
    ids = [f"c{i:03}" for i in range(120)]
    records = [(x, rng.choice(("w1", "w2", "w3", None)), rng.choice(("knowledge", "task", "map")), rng.choice(("10_Workspaces/a.md", "10_Workspaces/b.md", "90_Archive/c.md"))) for x in ids]
    edges = sorted({(rng.choice(ids), rng.choice(TYPES), rng.choice(ids)) for _ in range(500)})
    hits = [(s, rng.choice(ids), rng.randrange(1, 60)) for s in ("w1", "w2", "w9") for _ in range(40)]
    scopes, parents = spark.createDataFrame([("w1",), ("w2",), ("w9",)], "scope_id string"), spark.createDataFrame([("w1", "w3", 1)], "scope_id string, parent_id string, depth int")
    held = spark.createDataFrame(records, RECORD)
    chain = focus.chains(scopes, parents)
    lexical = focus.lexical_lane(spark.createDataFrame(hits, "scope_id string, concept_id string, rank int"), chain, held, knowledge).cache()
    graph = focus.graph_lane(lexical, spark.createDataFrame(edges, "source_id string, relation_type string, target_id string"), chain, held, depth, knowledge).collect()
    found = lexical.collect()
    for scope, owners in (("w1", ("w1", "w3")), ("w2", ("w2",)), ("w9", ("w9",))):
        offered = {x for x, w, kind, path in records if not path.startswith("90_") and (w in owners or knowledge and kind in ("knowledge", "map"))}
        best = {}
        for s, x, rank in hits:
            if s == scope and x in offered:
                best[x] = min(rank, best.get(x, 99))
        order = sorted(best, key=lambda x: (best[x], x))
        assert [r.concept_id for r in sorted((r for r in found if r.scope_id == scope), key=lambda r: r.rank)] == order
        assert sorted((r.concept_id, r.rank, r.hop, r.relation_type) for r in graph if r.scope_id == scope) == sorted(walk(order, edges, offered, depth))


def test_nothing_found_gives_no_pack(spark):
    fields = "concept_id string, type string, path string, title string, workspace_id string, lifecycle string, created_at string, occurred_at string, covers string, description string, stale boolean, characters bigint, required_reading boolean"
    empty = lambda schema: spark.createDataFrame([], schema)
    made = focus.focused_pack(spark.createDataFrame([("w1",)], "scope_id string"), empty("scope_id string, parent_id string, depth int"), empty(fields), empty("scope_id string, concept_id string, rank int"), empty("source_id string, relation_type string, target_id string"))
    assert made.count() == 0
