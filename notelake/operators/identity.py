"""Identities: the corpus has one, a note has its own, and none gets lost; a note with all its edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions.layout import INBOX, role
from notelake.operators.graph import both_ways

#: Where the corpus states its identity, and the type of that note.
MANIFEST, MANIFEST_TYPE = "50_System/system.md", "system_manifest"


def _finding(rows: DataFrame, code: Column, severity: str, value: Column) -> DataFrame:
    return rows.select("path", code.alias("code"), F.lit(severity).alias("severity"), value.cast("string").alias("value"))


def identity_checks(documents: DataFrame, index: DataFrame, manifest: str = MANIFEST) -> DataFrame:
    """``(path, code, severity, value)`` for ``documents(path, concept_id, type)`` and the kept ``index(path, concept_id)``.

    A document without front matter has a null id. Codes: no_vault_identity (the manifest is missing or has no id);
    duplicate_vault_identity (another note of the manifest's type); duplicate_id, for each path that shares an id, which
    is the value; identity_lost (a document without id whose path the index knows under one, the value); untracked_document (any other without id). Captures in the inbox, reserved files and files
    of other formats may go without. Ids are counted before they meet the paths, so an id of any number of paths is fine.
    """
    named = documents.filter(F.col("concept_id").isNotNull())
    held = named.groupBy("concept_id").agg(F.count("*").alias("n"))
    shared = named.join(held.filter("n > 1"), "concept_id")
    stray = named.filter((F.col("type") == MANIFEST_TYPE) & (F.col("path") != manifest))
    # One row, with or without the manifest.
    missing = named.agg(F.coalesce(F.bool_or(F.col("path") == manifest), F.lit(False)).alias("there")).filter("not there").select(F.lit(manifest).alias("path"))
    bare = documents.filter(F.col("concept_id").isNull() & (role(F.col("path")) == "concept") & ~F.startswith("path", F.lit(f"{INBOX}/"))).select("path")
    known = bare.join(index.groupBy("path").agg(F.min("concept_id").alias("lost")), "path", "left")
    lost, nothing = F.col("lost").isNotNull(), F.lit("")
    return (
        _finding(missing, F.lit("no_vault_identity"), "error", nothing)
        .unionByName(_finding(stray, F.lit("duplicate_vault_identity"), "error", F.col("concept_id")))
        .unionByName(_finding(shared, F.lit("duplicate_id"), "error", F.col("concept_id")))
        .unionByName(_finding(known.filter(lost), F.lit("identity_lost"), "error", F.col("lost")))
        .unionByName(_finding(known.filter(~lost), F.lit("untracked_document"), "warning", nothing))
    )


def concept_view(asked: DataFrame, records: DataFrame, edges: DataFrame) -> DataFrame:
    """Each of ``asked(concept_id)`` with its edges, a row an edge: outgoing, then incoming, by type and other end.

    Columns: ``concept_id``, ``title``, ``path``, ``direction``, ``relation_type``, ``other``, ``other_title`` (null where the other end has no record) and
    ``place`` within concept and direction. A concept without edges has one row with a null direction; an id
    without record has none. Rows, not lists, so a hub is as many rows as it has edges.
    """
    views = records.join(asked.select("concept_id").distinct(), "concept_id").select("concept_id", "title", "path")
    ways = both_ways(edges).withColumnRenamed("node", "concept_id")
    met = views.join(ways, "concept_id", "left").join(records.select(F.col("concept_id").alias("other"), F.col("title").alias("other_title")), "other", "left")
    place = F.row_number().over(Window.partitionBy("concept_id", "direction").orderBy("relation_type", "other"))
    return met.select("concept_id", "title", "path", "direction", "relation_type", "other", "other_title", place.alias("place"))
