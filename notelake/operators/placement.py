"""Placement rules against a table of the places where documents of each type may live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions import layout
from notelake.functions.text import segments
from notelake.operators.sizes import broadcast_if_small


def _accepts(place: Column) -> Column:
    """Whether the effective path, of which the parts stand in columns, is at this place."""
    kind, value = place["kind"], place["value"]
    return (
        ((kind == "exact_path") & (F.col("candidate") == value))
        | ((kind == "directory") & (F.col("home") == value) & (F.col("name") != layout.INDEX))
        | ((kind == "workspace_manifest") & F.coalesce(F.col("candidate") == F.concat("workspace", F.lit(f"/{layout.WORKSPACE_MANIFEST}")), F.lit(False)))
        | ((kind == "area_manifest") & F.coalesce(F.col("candidate") == F.concat("area", F.lit(f"/{layout.AREA_MANIFEST}")), F.lit(False)))
        | ((kind == "workspace_section") & F.coalesce(F.col("section") == value, F.lit(False)))
        | ((kind == "area_content") & F.col("own"))
    )


def rule_placement(notes: DataFrame, places: DataFrame, strict: bool = True) -> DataFrame:
    """``(path, code, severity)`` for notes of ``(path, type)`` that stand where they may not.

    ``places(type, kind, value, binding)`` holds the places of each type: an exact path, a directory, a
    workspace's or an area's manifest, a section of any workspace, or an area's own content. Archived
    notes are judged where they came from. A folder inside a flat area is nested_flat_area, whatever the type.
    A type with places and none that accepts is misplaced_document, an error if ``strict`` and the type's places bind,
    else a warning; types without places and the inbox are not judged. Places go to the notes, which stay where they are.
    """
    listed = places.groupBy("type").agg(F.collect_list(F.struct("kind", "value")).alias("places"), F.max("binding").alias("binding"))
    candidate = layout.effective_path(F.col("path"))
    parts = notes.select("path", "type", candidate.alias("candidate")).withColumns(
        {
            "home": layout.directory_of(F.col("candidate")),
            "name": layout.name_of(F.col("candidate")),
            "workspace": layout.workspace_dir(F.col("candidate")),
            "area": layout.area_dir(F.col("candidate")),
            "section": layout.workspace_section(F.col("candidate")),
            "own": F.coalesce(layout.area_content(F.col("candidate")), F.lit(False)),
        }
    )
    known = parts.join(broadcast_if_small(listed, 10_000), "type", "left")
    nested = layout.flat_area(F.col("path")).isNotNull() & (F.size(segments(F.col("path"))) > 3)
    inbox = F.element_at(segments(F.col("path")), 1) == layout.INBOX
    misplaced = F.col("places").isNotNull() & ~inbox & ~F.exists("places", _accepts)
    severity = F.when(F.lit(strict) & F.col("binding"), "error").otherwise("warning")
    found = F.array_compact(
        F.array(
            F.when(nested, F.struct(F.lit("nested_flat_area").alias("code"), F.lit("error").alias("severity"))),
            F.when(misplaced, F.struct(F.lit("misplaced_document").alias("code"), severity.alias("severity"))),
        )
    )
    return known.select("path", F.explode(found).alias("x")).select("path", "x.code", "x.severity")
