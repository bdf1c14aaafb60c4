"""Validation as data-quality rules: each rule is one column, problems are exploded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions.text import has_offset

#: Closed vocabularies.
STATUSES = ("draft", "stable", "deprecated", "active", "cancelled", "final")
LIFECYCLES = {"decision": ("accepted", "proposed", "superseded", "rejected"), "standard": ("accepted", "superseded")}
TYPES = ("decision", "context", "task", "standard", "knowledge", "log")


def _issue(condition: Column, code: str, severity: str, field: str) -> Column:
    return F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(field).alias("field")))


def rules() -> list[Column]:
    """All single-document rules as nullable structs."""
    c = F.col
    lifecycle = F.lit(False)
    for kind, allowed in LIFECYCLES.items():
        lifecycle = lifecycle | ((c("type") == kind) & ~c("lifecycle").isin(*allowed))
    return [
        _issue(c("workspace").isNull() & ~c("type").isin("knowledge"), "missing_required_field", "error", "workspace"),
        _issue(~c("type").rlike("^[a-z][a-z_]*$"), "invalid_type", "error", "type"),
        _issue(~c("type").isin(*TYPES), "unregistered_type", "warning", "type"),
        _issue(~c("concept_id").rlike("^n[0-9]{9}$"), "invalid_id", "error", "id"),
        _issue(c("created_at").isNotNull() & ~has_offset(c("created_at")), "invalid_timestamp", "error", "created_at"),
        _issue(c("stale_after").isNotNull() & ~has_offset(c("stale_after")), "invalid_timestamp", "error", "stale_after"),
        _issue(~c("status").isin("draft", "stable", "deprecated", "active"), "invalid_status", "error", "status"),
        _issue(F.coalesce(lifecycle, F.lit(False)), "invalid_lifecycle", "warning", "lifecycle"),
        _issue(c("tag") != F.lower("tag"), "unnormalised_tag", "warning", "tags"),
    ]


def validate(notes: DataFrame) -> DataFrame:
    """``(path, concept_id, code, severity, field)`` in one pass over the notes."""
    found = notes.select("path", "concept_id", F.explode(F.array_compact(F.array(*rules()))).alias("i"))
    return found.select("path", "concept_id", "i.code", "i.severity", "i.field")


def validate_changed(notes: DataFrame, changed: DataFrame) -> DataFrame:
    return validate(notes.join(changed.select("concept_id").distinct(), "concept_id", "left_semi"))


def rule_relations(edges: DataFrame, known: DataFrame, registered: tuple[str, ...]) -> DataFrame:
    """Edges of unregistered types and edges whose target nobody holds."""
    ids = known.select(F.col("concept_id").alias("target_id")).distinct().withColumn("held", F.lit(True))
    checked = edges.join(ids, "target_id", "left")
    problems = F.array_compact(
        F.array(
            F.when(~F.col("relation_type").isin(*registered), F.lit("unregistered_relation_type")),
            F.when(F.col("held").isNull(), F.lit("unresolved_relation_target")),
        )
    )
    return checked.select("source_id", "relation_type", "target_id", F.explode(problems).alias("code"))
