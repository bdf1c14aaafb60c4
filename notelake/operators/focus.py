"""Focused and deep packs: hits of a scope, expanded along asserted edges, fused, put in force order, budgeted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.operators import packs
from notelake.operators.graph import NEVER_CORROBORATE, both_ways
from notelake.operators.retrieval import lift_successors, rrf
from notelake.operators.sizes import broadcast_if_small
from notelake.sources.shared import saved

#: Candidates that a hop expands, types that belong to no workspace, categories of types.
EXPANDED = 10
KNOWLEDGE = ("knowledge", "map")
CATEGORY = {"workspace": "workspace", "context": "context", "standard": "standard", "decision": "decision", "task": "task", "activity_log": "activity"}
_FIELDS = ("scope_id", "concept_id", "category", "priority", "binding", "stale", "characters", "title", "path", "description")


def chains(scopes: DataFrame, parents: DataFrame) -> DataFrame:
    """``(scope_id, workspace_id)``: each scope with itself and its parents."""
    own = scopes.select("scope_id", F.col("scope_id").alias("workspace_id"))
    return own.union(parents.join(scopes, "scope_id").select("scope_id", "parent_id")).distinct()


def in_scope(found: DataFrame, chain: DataFrame, records: DataFrame, knowledge: bool = False) -> DataFrame:
    """The rows of ``found(scope_id, concept_id, ...)`` that the scope can offer: of its workspaces, not archived.

    ``knowledge`` admits knowledge of no workspace too. Candidates meet the records, so what a scope could
    offer is never written out.
    """
    facts = records.filter(~F.startswith("path", F.lit("90_Archive/"))).select("concept_id", "workspace_id", "type")
    held = chain.withColumn("own", F.lit(True))
    met = found.join(facts, "concept_id").join(held, ["scope_id", "workspace_id"], "left")
    kept = F.col("own").isNotNull() | (F.col("type").isin(*KNOWLEDGE) if knowledge else F.lit(False))
    return met.filter(kept).select(found.columns)


def lexical_lane(hits: DataFrame, chain: DataFrame, records: DataFrame, knowledge: bool = False, limit: int | None = None) -> DataFrame:
    """``hits(scope_id, concept_id, rank)`` within the reduction, each concept at its best rank, numbered anew; the first ``limit``."""
    best = in_scope(hits, chain, records, knowledge).groupBy("scope_id", "concept_id").agg(F.min("rank").alias("at"))
    order = Window.partitionBy("scope_id").orderBy("at", "concept_id")
    found = best.select("scope_id", "concept_id", F.row_number().over(order).alias("rank"))
    return found if limit is None else found.filter(F.col("rank") <= limit)


def graph_lane(found: DataFrame, edges: DataFrame, chain: DataFrame, records: DataFrame, depth: int = 1, knowledge: bool = False) -> DataFrame:
    """``(scope_id, concept_id, rank, hop, relation_type)``: what the first hits point at and what points at them.

    A hop expands its first ``EXPANDED`` candidates in order; edges come outgoing first, by type, then by
    id. A document is reached once, by its first edge. Documents among the hits are reached only by
    relations that corroborate. A scope expands a few candidates a hop, so a hop is one join of the edges
    with a small table, whatever the number of hits.
    """
    ways = both_ways(edges)
    known = found.select("scope_id", "concept_id", F.lit(True).alias("known"))
    frontier = found.filter(F.col("rank") <= EXPANDED).select("scope_id", F.col("concept_id").alias("node"), F.col("rank").alias("at"))
    hops: list[DataFrame] = []
    for hop in range(1, depth + 1):
        order = F.struct("at", (F.col("direction") == "incoming").alias("back"), "relation_type", "other")
        met = ways.join(broadcast_if_small(frontier), "node").select("scope_id", F.col("other").alias("concept_id"), "relation_type", order.alias("order"))
        met = met.join(known, ["scope_id", "concept_id"], "left").filter(F.col("known").isNull() | ~F.col("relation_type").isin(*NEVER_CORROBORATE))
        for before in hops:
            met = met.join(before, ["scope_id", "concept_id"], "left_anti")
        first = met.groupBy("scope_id", "concept_id").agg(F.min("order").alias("order"))
        first = in_scope(first, chain, records, knowledge)
        placed = first.withColumn("place", F.row_number().over(Window.partitionBy("scope_id").orderBy("order")))
        so_far = reduce(DataFrame.union, [h.select("scope_id") for h in hops]).groupBy("scope_id").agg(F.count("*").alias("n")) if hops else None
        placed = placed.join(so_far, "scope_id", "left").withColumn("n", F.coalesce("n", F.lit(0))) if hops else placed.withColumn("n", F.lit(0))
        rank = (F.col("place") + F.col("n")).cast("int")
        reached = saved(placed.select("scope_id", "concept_id", rank.alias("rank"), F.lit(hop).alias("hop"), F.col("order.relation_type").alias("relation_type"), "place"), "hop")
        hops.append(reached)
        frontier = reached.filter(F.col("place") <= EXPANDED).select("scope_id", F.col("concept_id").alias("node"), F.col("place").alias("at"))
    return reduce(DataFrame.union, hops).drop("place")


def union_candidates(found: DataFrame, reached: DataFrame) -> DataFrame:
    """``(query_id, owner, retriever, rank)`` of both lanes."""
    lane = lambda df, name: df.select(F.col("scope_id").alias("query_id"), F.col("concept_id").alias("owner"), F.lit(name).alias("retriever"), "rank")
    return lane(found, "lexical").unionByName(lane(reached, "graph"))


def retrieve(scopes: DataFrame, parents: DataFrame, records: DataFrame, hits: DataFrame, edges: DataFrame, depth: int = 1, knowledge: bool = False, limit: int | None = None) -> DataFrame:
    """``(scope_id, concept_id, rank)``: both lanes fused by reciprocal ranks, no document before its replacement."""
    chain = broadcast_if_small(chains(scopes, parents))
    found = saved(lexical_lane(hits, chain, records, knowledge, limit), "lexical")
    reached = graph_lane(found, edges, chain, records, depth, knowledge)
    replaced = edges.filter("relation_type = 'superseded_by'").select(F.col("source_id").alias("old"), F.col("target_id").alias("new"))
    ordered = lift_successors(saved(rrf(union_candidates(found, reached)).select("query_id", "owner", "rank"), "fused"), replaced)
    return ordered.select(F.col("query_id").alias("scope_id"), F.col("owner").alias("concept_id"), "rank")


def _category(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in CATEGORY.items()], F.lit("retrieved"))


def focused_items(fused: DataFrame, records: DataFrame) -> DataFrame:
    """Items of ``fused(scope_id, concept_id, rank)``: category by type, priority from 0 by rank, nothing binding or required.

    Candidates without a record are left out and leave their priority free.
    """
    met = fused.join(records.select("concept_id", "type", "path", "title", "stale", "characters"), "concept_id")
    made = met.withColumn("category", _category(F.col("type"))).withColumn("priority", (F.col("rank") - 1).cast("int"))
    return made.withColumn("binding", F.lit(False)).withColumn("description", F.lit(None).cast("string")).select(*_FIELDS).withColumn("required", F.lit(False))


def focused_pack(scopes: DataFrame, parents: DataFrame, records: DataFrame, hits: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """The pack about what was asked in each scope: hits and their neighbours, one hop, the startup pack's budget."""
    return packs.apply_budget(focused_items(retrieve(scopes, parents, records, hits, edges, limit=limit), records))


def deep_pack(scopes: DataFrame, parents: DataFrame, records: DataFrame, hits: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Structure of the scope and its parents, then what two hops and knowledge of no workspace add; wider limits.

    Nothing is marked as required reading, and no response bounds the bodies.
    """
    structural = saved(packs.structural_items(scopes, parents, records, sections_of_parents=True), "structural")
    fused = retrieve(scopes, parents, records, hits, edges, depth=2, knowledge=True, limit=limit)
    items = structural.unionByName(packs.retrieved_items(fused, structural, records)).withColumn("required", F.lit(False))
    return packs.apply_budget(items, packs.DEEP_CHARACTERS, packs.DEEP_ITEMS, caps=packs.DEEP_CAPS, response=None)
