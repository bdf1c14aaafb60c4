"""Front matter and tracker pages as VARIANT: modelled fields become columns, everything else is kept as it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Front matter that becomes a column, the form of an identity (UUID version 7), and the length of an excerpt.
MODELLED = ("id", "type", "title", "tags", "domains", "lifecycle", "status", "authority", "workspace")
IDENTITY = "^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
EXCERPT = 240


def fields_of(variant: Column) -> Column:
    """The members of a VARIANT object as a map; null for anything else."""
    return variant.try_cast("map<string, variant>")


def shape(value: Column) -> Column:
    """STRING, BOOLEAN, VOID, ARRAY, OBJECT or a kind of number; null where there is no value."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def text_of(value: Column) -> Column:
    """A string as it is; other values as JSON writes them; null for null."""
    return F.when(shape(value) == "STRING", value.try_cast("string")).when(shape(value) != "VOID", F.to_json(value))


def string_of(value: Column) -> Column:
    """The trimmed text of a string; null for an empty one and for other kinds."""
    return F.when(shape(value) == "STRING", F.nullif(F.trim(value.try_cast("string")), F.lit("")))


def list_of(value: Column) -> Column:
    """The texts of a list, trimmed and without empty ones; a string is a list of itself, other kinds are empty."""
    items = F.filter(F.transform(value.try_cast("array<variant>"), lambda x: F.trim(F.coalesce(text_of(x), F.lit("null")))), lambda x: x != "")
    single = F.when(F.trim(value.try_cast("string")) != "", F.array(value.try_cast("string"))).otherwise(F.array().cast("array<string>"))
    return F.when(shape(value) == "ARRAY", items).when(shape(value) == "STRING", single).otherwise(F.array().cast("array<string>"))


def _reference(value: Column) -> tuple[Column, Column]:
    """A field that should hold an identity: the identity, and whether something else stands there."""
    text = text_of(value)
    valid = text.rlike(IDENTITY)
    return F.when(valid, text), F.coalesce(~valid, F.lit(False))


def metadata_record(notes: DataFrame) -> DataFrame:
    """One record per note of ``(path, concept_id, frontmatter VARIANT)``; nothing is refused, problems are ``issues``.

    A missing, empty or non-text title is the file's name without ``.md``; a missing type is ``unknown``. The
    owner is the workspace, else the area; a reference that is no identity is an issue and counts as
    absent. Tags and domains may be a single string. All fields that are not modelled, nested ones too,
    stay in ``extra`` as a map of VARIANT. Front matter that is null or no object has no fields.
    """
    held = notes.select("path", "concept_id", F.coalesce(fields_of(F.col("frontmatter")), F.create_map().cast("map<string, variant>")).alias("f"))
    field = lambda name: F.element_at("f", F.lit(name))
    workspace, bad_workspace = _reference(field("workspace"))
    area, bad_area = _reference(field("area"))
    title = F.when(F.trim(string_of(field("title"))) != "", field("title").try_cast("string"))
    issues = F.array_compact(
        F.array(
            F.when(title.isNull(), F.lit("missing_title")),
            F.when(bad_workspace, F.lit("invalid_workspace_reference")),
            F.when(workspace.isNull() & bad_area, F.lit("invalid_area_reference")),
        )
    )
    return held.select(
        "concept_id",
        F.coalesce(string_of(field("type")), F.lit("unknown")).alias("type"),
        "path",
        F.coalesce(title, F.regexp_replace("path", r"^.*/|\.md$", "")).alias("title"),
        F.coalesce(workspace, area).alias("workspace_id"),
        list_of(field("tags")).alias("tags"),
        list_of(field("domains")).alias("domains"),
        *(string_of(field(c)).alias(c) for c in ("lifecycle", "status", "authority")),
        F.map_filter("f", lambda name, _: ~name.isin(*MODELLED)).alias("extra"),
        issues.alias("issues"),
    )


def entries(extra: Column) -> Column:
    """A map of VARIANT as sorted ``name=JSON`` texts."""
    return F.array_sort(F.transform(F.map_entries(extra), lambda e: F.concat(e["key"], F.lit("="), F.to_json(e["value"]))))


def normalize_work_items(pages: DataFrame, connection: str, project_ref: str, base_url: str) -> DataFrame:
    """Work packages of ``(payload VARIANT)`` as items: modelled columns, ``parent``, ``extra`` and ``extensions``.

    Links give titles; a link without href is none. The excerpt is the description with white space
    collapsed, cut to ``EXCERPT`` characters with an ellipsis. Fields named customField and a number stay in
    ``extensions`` as they are. Empty times and dates are null, ``extra`` holds what is there.
    """
    p = F.col("payload")
    text = lambda path: F.try_variant_get(p, path, "string")
    linked = lambda name: F.when(text(f"$._links.{name}.href").isNotNull(), text(f"$._links.{name}.title"))
    identifier = text("$.id")
    raw = F.nullif(text("$.description.raw"), F.lit(""))
    collapsed = F.trim(F.regexp_replace(raw, r"\s+", " "))
    excerpt = F.when(F.length(collapsed) <= EXCERPT, collapsed).otherwise(F.concat(F.rtrim(F.substring(collapsed, 1, EXCERPT - 1)), F.lit("…")))
    extra = {
        "connection": F.lit(connection),
        "project_ref": F.lit(project_ref),
        "display_id": F.coalesce(text("$.displayId"), identifier),
        **{name: linked(name) for name in ("project", "type", "responsible", "category", "sprint")},
        "description": raw,
        "description_excerpt": excerpt,
        "created_at": F.nullif(text("$.createdAt"), F.lit("")),
        "start_date": F.nullif(text("$.startDate"), F.lit("")),
        "due_date": F.nullif(text("$.dueDate"), F.lit("")),
        "percent_complete": text("$.percentageDone"),
        "lock_version": text("$.lockVersion"),
    }
    packed = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in extra.items())), lambda e: e["value"].isNotNull()))
    return pages.filter(identifier.isNotNull()).select(
        identifier.alias("external_id"),
        F.coalesce(text("$.subject"), F.lit("")).alias("title"),
        linked("status").alias("status"),
        linked("assignee").alias("assignee"),
        linked("priority").alias("priority"),
        linked("version").alias("milestone"),
        F.nullif(text("$.updatedAt"), F.lit("")).alias("updated_at"),
        F.concat(F.rtrim(F.lit(base_url), F.lit("/")), F.lit("/work_packages/"), identifier).alias("url"),
        F.regexp_extract(text("$._links.parent.href"), "([^/]*)/*$", 1).alias("parent"),
        packed.alias("extra"),
        F.map_filter(fields_of(p), lambda name, _: name.rlike("^customField[0-9]+$")).alias("extensions"),
    )
