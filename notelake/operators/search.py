"""Search for documents by their chunks: identifiers before words, one place an owner, what is in force before what it replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from notelake.functions.text import identifier_terms
from notelake.operators import curation, postings, references, retrieval, scoring
from notelake.operators.sizes import broadcast_if_small
from notelake.sources.shared import saved


def _place(lane: int) -> Column:
    return F.struct(F.lit(lane).alias("lane"), (-F.col("score")).alias("worse"), F.col("chunk").alias("chunk_key")).alias("place")


def _identifiers(queries: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """``(query_id, text)`` of the queries' identifiers, and ``(query_id, chunk)`` that hold one whole; none where no query has any."""
    named = saved(queries.select("query_id", F.explode(F.array_distinct(identifier_terms(F.col("text")))).alias("identifier")), "identifiers")
    if named.isEmpty():
        return None
    whole = curation.exact_identifier_lane(named, chunks, "chunk_key", "text").select("query_id", F.col("owner").alias("chunk")).distinct()
    return named.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list("identifier")), " ").alias("text")), whole


def best_chunks(index: postings.Index, queries: DataFrame, identifiers: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    """``(query_id, owner, best)``: the best chunk of each document that a query meets, as a struct ``(lane, worse, chunk_key)``.

    Chunks that hold an identifier of the query whole come before those that hold its words; within both
    BM25 decides, of the identifiers' words and of all words; ties by the chunk. Structs compare in that order.
    By joins, for any number of queries.
    """
    met = postings.scored_chunks(index, queries).select("query_id", "owner", _place(1))
    if identifiers:
        named, whole = identifiers
        met = met.unionByName(postings.scored_chunks(index, named).join(whole, ["query_id", "chunk"], "left_semi").select("query_id", "owner", _place(0)))
    return met.groupBy("query_id", "owner").agg(F.min("place").alias("best"))


class _Joined:
    """All documents that a query meets, by joins and written once."""

    def __init__(self, index: postings.Index, queries: DataFrame, identifiers: tuple[DataFrame, DataFrame] | None):
        self.every = saved(best_chunks(index, queries, identifiers), "hits")

    def first(self, gone: DataFrame, limit: int) -> DataFrame:
        return self.every

    def reaching(self, last: DataFrame) -> DataFrame:
        return self.every.join(F.broadcast(last), "query_id").filter(F.col("best") <= F.col("last")).drop("last")  # a row a query

    def of(self, pairs: DataFrame) -> DataFrame:
        return self.every.join(pairs, ["query_id", "owner"], "left_semi")


class _Scored:
    """The same from an index's counts, scored anew for what is asked, so that no pair of a query and a document is written but these."""

    def __init__(self, search: postings.Search, asked: scoring.Asked, kind: DataType, identifiers: tuple[DataFrame, DataFrame] | None):
        self.held, self.asked_stems, self.kind, self.named = search.held, asked, kind, None
        if identifiers:
            named, whole = identifiers
            admitted = saved(whole.groupBy("chunk").agg(F.collect_set("query_id").alias("admitted")), "whole")
            rows = self.held.join(broadcast_if_small(admitted), "chunk")
            self.named = saved(self._scores(rows, search.asked(named)).select("query_id", "owner", _place(0)), "named")

    def _scores(self, rows: DataFrame, asked: scoring.Asked, **how) -> DataFrame:
        return scoring.scored(rows, asked, self.kind, ["owner", "chunk"], "chunk", **how)

    def _with_named(self, found: DataFrame) -> DataFrame:
        places = found.select("query_id", "owner", _place(1))
        return places if self.named is None else places.unionByName(self.named)

    def first(self, gone: DataFrame, limit: int) -> DataFrame:
        """Among them the first ``limit`` documents of each query that are not ``gone``."""
        found = self._scores(self.held.join(gone, "owner", "left_anti"), self.asked_stems, limit=limit, group="owner")
        return self._with_named(found).groupBy("query_id", "owner").agg(F.min("place").alias("best"))

    def reaching(self, last: DataFrame) -> DataFrame:
        """The documents whose best chunk is not behind ``last(query_id, last)``."""
        least = {r["query_id"]: -r["last"]["worse"] for r in last.filter("last.lane = 1").collect()}  # a row a query
        places = self._with_named(self._scores(self.held, self.asked_stems, least=least))
        reached = places.join(F.broadcast(last), "query_id").filter(F.col("place") <= F.col("last"))
        return reached.groupBy("query_id", "owner").agg(F.min("place").alias("best"))

    def of(self, pairs: DataFrame) -> DataFrame:
        """The documents of ``pairs(query_id, owner)`` that their query meets."""
        admitted = saved(pairs.groupBy("owner").agg(F.collect_set("query_id").alias("admitted")), "pairs")
        places = self._with_named(self._scores(self.held.join(broadcast_if_small(admitted), "owner"), self.asked_stems))
        return places.join(pairs, ["query_id", "owner"], "left_semi").groupBy("query_id", "owner").agg(F.min("place").alias("best"))


def search_documents(index: postings.Index, queries: DataFrame, chunks: DataFrame, archived: DataFrame, supersedes: DataFrame, limit: int = 10) -> DataFrame:
    """``(query_id, owner, rank, passage, start_line, end_line, moved)``: the first ``limit`` documents of each query.

    Documents are ordered by their best chunk; with one lane of candidates that is what fusing their
    ranks gives. A document never outranks one that replaced it, ``supersedes(old, new)``: the
    replacement comes to its place. Archived owners (``archived(owner)``) are left out after that and
    before the limit. Only the part of a list that can reach the limit is reordered: owners down to the
    limit's last live one, and the replacements of those.
    """
    gone = saved(archived.select("owner").distinct().withColumn("archived", F.lit(True)), "archived")
    gone = broadcast_if_small(gone)
    queries = queries.select("query_id", "text")
    identifiers = _identifiers(queries, chunks)
    search = postings.opened(index, queries.unionByName(identifiers[0]) if identifiers else queries, several=True)
    asked = search.asked(queries) if search else None
    every = _Joined(index, queries, identifiers) if asked is None else _Scored(search, asked, queries.schema["query_id"].dataType, identifiers)
    own = Window.partitionBy("query_id").orderBy("best")
    live = every.first(gone, limit).join(gone, "owner", "left_anti").withColumn("n", F.row_number().over(own)).filter(F.col("n") <= limit)
    last = saved(live.groupBy("query_id").agg(F.max("best").alias("last")), "last")
    reach = saved(every.reaching(last).join(gone, "owner", "left"), "reach")
    over = supersedes.select("old", "new").filter("old <> new").distinct()
    fresh = reach
    for _ in range(retrieval.MOVES):
        more = saved(fresh.select("query_id", F.col("owner").alias("old")).join(over, "old").select("query_id", F.col("new").alias("owner")).distinct(), "more")
        found = every.of(more).join(reach.select("query_id", "owner"), ["query_id", "owner"], "left_anti")
        fresh = saved(found.join(gone, "owner", "left"), "reach")
        if fresh.isEmpty():
            break
        reach = reach.unionByName(fresh)
    placed = reach.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("best")))
    lifted = retrieval.lift_successors(placed.select("query_id", "owner", "rank"), over)
    kept = lifted.join(reach.filter("archived is null").select("query_id", "owner", F.col("best.chunk_key").alias("chunk_key")), ["query_id", "owner"])
    shown = kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("rank") <= limit)
    return references.hit_passages(shown, chunks).drop("chunk_key")
