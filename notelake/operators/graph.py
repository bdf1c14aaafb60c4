"""Typed edges: upkeep, neighbours, bounded traversal, expansion of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelake.sources.shared import saved

#: Relations that never second a document.
NEVER_CORROBORATE = ("links_to", "parent", "superseded_by", "closes")


def add_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """One edge per triple; attributes of the last batch win."""
    both = old.withColumn("__batch", F.lit(0)).unionByName(new.withColumn("__batch", F.lit(1)))
    key = ["source_id", "relation_type", "target_id"]
    last = Window.partitionBy(*key).orderBy(F.desc("__batch"))
    return both.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n", "__batch")


def replace_outgoing(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges of the sources in ``new`` are replaced, others stay."""
    return old.join(new.select("source_id").distinct(), "source_id", "left_anti").unionByName(new)


def remove_incident(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges with neither end in ``gone(concept_id)``."""
    left = edges.join(gone.select(F.col("concept_id").alias("source_id")), "source_id", "left_anti")
    return left.join(gone.select(F.col("concept_id").alias("target_id")), "target_id", "left_anti").select(edges.columns)


def both_ways(edges: DataFrame) -> DataFrame:
    """``(node, direction, relation_type, other)`` for each end of each edge."""
    out = edges.select(F.col("source_id").alias("node"), F.lit("outgoing").alias("direction"), "relation_type", F.col("target_id").alias("other"))
    back = edges.select(F.col("target_id").alias("node"), F.lit("incoming").alias("direction"), "relation_type", F.col("source_id").alias("other"))
    return out.unionByName(back)


def neighbors(edges: DataFrame, seeds: DataFrame, types: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """Neighbours of ``seeds(node)``, at most ``limit`` each, by type, then id, then direction."""
    ways = both_ways(edges)
    if types:
        ways = ways.filter(F.col("relation_type").isin(*types))
    found = ways.join(seeds.select("node").distinct(), "node")
    if limit is None:
        return found
    order = Window.partitionBy("node").orderBy("relation_type", "other", F.desc("direction"))
    return found.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= limit).drop("__n")


def traverse(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """``(seed, node, depth, via)``: breadth first, first arrival kept.

    Of several arrivals in one hop the one from the smallest node wins, outgoing before incoming, then
    by type. Each hop is one join with the frontier and one anti-join with what was reached before.
    """
    ways = both_ways(edges)
    reached = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via"))
    frontier = reached
    for depth in range(1, max_depth + 1):
        first = Window.partitionBy("seed", "other").orderBy("node", F.desc("direction"), "relation_type")
        step = frontier.select("seed", "node").join(ways, "node").withColumn("__n", F.row_number().over(first)).filter("__n = 1")
        step = step.select("seed", F.col("other").alias("node"), F.lit(depth).alias("depth"), F.col("node").alias("via"))
        frontier = step.join(reached.select("seed", "node"), ["seed", "node"], "left_anti")
        reached = reached.unionByName(frontier)
    return reached.filter("depth > 0")


def parent_chain(parents: DataFrame, starts: DataFrame, max_depth: int = 32) -> DataFrame:
    """``(start, ancestor, depth, problem)`` nearest first; a cycle or too deep a chain is marked."""
    current = starts.select("start", F.col("start").alias("ancestor"), F.array("start").alias("path"))
    found = []
    for depth in range(1, max_depth + 1):
        current = current.join(parents.select(F.col("child").alias("ancestor"), "parent"), "ancestor").select(
            "start", F.col("parent").alias("ancestor"), F.lit(depth).alias("depth"), F.array_contains("path", F.col("parent")).alias("cycle"), F.concat("path", F.array("parent")).alias("path")
        )
        found.append(current.select("start", "ancestor", "depth", F.when(F.col("cycle"), "cycle").alias("problem")))
        current = current.filter(~F.col("cycle")).select("start", "ancestor", "path")
        if depth >= 4 and current.isEmpty():
            break
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def expand_hits(hits: DataFrame, edges: DataFrame, hits_per_hop: int = 10) -> DataFrame:
    """``(query_id, owner, rank)``: neighbours of the first hits of each query, in order of arrival.

    Relations that never corroborate do not second a document that the query already found. Each
    target votes once, for its first arrival.
    """
    frontier = hits.filter(F.col("rank") <= hits_per_hop).select("query_id", F.col("owner").alias("node"), "rank")
    ways = both_ways(edges).filter(F.col("other") != F.col("node"))
    reached = frontier.join(ways, "node")
    known = hits.select("query_id", F.col("owner").alias("other")).distinct().withColumn("known", F.lit(True))
    reached = reached.join(known, ["query_id", "other"], "left").filter(F.col("known").isNull() | ~F.col("relation_type").isin(*NEVER_CORROBORATE))
    arrival = [F.col("rank"), F.desc("direction"), F.col("relation_type"), F.col("other")]
    first = Window.partitionBy("query_id", "other").orderBy(*arrival)
    once = reached.withColumn("__n", F.row_number().over(first)).filter("__n = 1")
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*arrival)))
    return placed.select("query_id", F.col("other").alias("owner"), F.col("place").alias("rank"))


def required_closure(required: DataFrame, excepts: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Required documents, and those that except a required one, to a fixpoint.

    Each round joins only what the round before found, and its result is saved, so neither plan nor work
    grows with the rounds before. A chain longer than ``max_rounds`` is an error.
    """
    steps = saved(excepts.select("source_id", "target_id").distinct(), "closure")
    found = fresh = saved(required.select("concept_id").filter("concept_id is not null").distinct(), "closure")
    for _ in range(max_rounds):
        met = steps.join(fresh.select(F.col("concept_id").alias("target_id")), "target_id", "left_semi").select(F.col("source_id").alias("concept_id")).distinct()
        fresh = saved(met.join(found, "concept_id", "left_anti"), "closure")
        if fresh.isEmpty():
            return found
        found = found.unionByName(fresh)
    raise RuntimeError(f"the closure did not settle in {max_rounds} rounds")
