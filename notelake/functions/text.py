"""Text functions over columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of an excerpt, a token, a chunk.
EXCERPT, CHARACTERS_PER_TOKEN, CHUNK = 320, 4, 2000
_OFFSET = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def estimate_tokens(text: Column) -> Column:
    """Tokens a text is counted as: a quarter of its characters, rounded up."""
    return F.ceil(F.length(text) / CHARACTERS_PER_TOKEN)


def excerpt(text: Column, limit: int = EXCERPT) -> Column:
    """White space collapsed; longer texts are cut and end with an ellipsis within the limit."""
    flat = F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…")))


def normalize_tag(tag: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(tag), r"[^\p{L}\p{N}]", "")


def task_terms(task: Column) -> Column:
    """Distinct words of more than one character, in order."""
    return F.array_distinct(F.filter(F.split(task, r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 1))


def quoted_phrases(query: Column) -> Column:
    return F.filter(F.regexp_extract_all(query, F.lit('"([^"]*)"'), F.lit(1)), lambda p: p != "")


def query_terms(query: Column) -> Column:
    """Words outside quotation marks, in order."""
    return F.filter(F.split(F.regexp_replace(query, '"[^"]*"', " "), r"\s+"), lambda w: w != "")


def identifier_terms(query: Column) -> Column:
    """Words that look like identifiers: letters, digits, underscores or a leading hash, a hyphen or hash inside, a digit behind it."""
    word = r"[\p{L}\p{N}_]"
    return F.filter(query_terms(query), lambda w: w.rlike(rf"^[#\p{{L}}\p{{N}}_]*{word}[-#][\p{{L}}\p{{N}}_-]*\p{{Nd}}[\p{{L}}\p{{N}}_-]*$"))


def merge_terms(*lists: Column) -> Column:
    """All lists in turn, first occurrence kept."""
    return F.array_distinct(F.concat(*lists))


def content_hash(metadata: Column, body: Column) -> Column:
    return F.sha2(F.concat(metadata, F.lit("\x1f"), body, F.lit("\x1f")), 256)


def chunk_key(*parts: Column) -> Column:
    """SHA-256 of the parts, each ended by a unit separator."""
    return F.sha2(F.concat(*[x for p in parts for x in (p.cast("string"), F.lit("\x1f"))]), 256)


def has_offset(stamp: Column) -> Column:
    """True for ISO 8601 texts that state their offset: others make no claim about time."""
    return F.coalesce(stamp.rlike(_OFFSET), F.lit(False))


def is_stale(stale_after: Column, now: str) -> Column:
    """True from the very instant of ``stale_after`` on."""
    return F.when(has_offset(stale_after), F.try_to_timestamp(stale_after) <= F.lit(now).cast("timestamp")).otherwise(F.lit(False))


def marker_count(text: Column, marker: Column) -> Column:
    """True where the marker occurs in the text, case ignored."""
    return F.contains(F.lower(text), F.lower(marker))


def external_ref(href: Column) -> Column:
    """The last segment of a link."""
    return F.element_at(F.split(href, "/"), -1)


def declared_item(text: Column) -> Column:
    """Leading identifier of a declaration, null without one."""
    found = F.regexp_extract(text, r"^\s*([A-Za-z0-9#-]*[0-9][A-Za-z0-9#-]*)", 1)
    return F.when(found != "", found)


def written_title(body: Column, path: Column) -> Column:
    """The first level-one heading, else the file's stem with hyphens as spaces."""
    heading = F.regexp_extract(body, r"(?m)^# +(.+?)\s*$", 1)
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", "")
    return F.when(heading != "", heading).otherwise(F.replace(stem, F.lit("-"), F.lit(" ")))


def segments(path: Column) -> Column:
    return F.split(path, "/")


#: A numbered decision's file: adr, a series if there is one, and four digits at least.
_NUMBERED = r"(?i)^adr-(?:([a-z][a-z0-9]*)-)?(\d{4,})(?:_|\.md$)"


def decision_series(path: Column) -> Column:
    """Series of a numbered file in lower case, empty for the main one; null without a number."""
    name = F.element_at(segments(path), -1)
    return F.when(name.rlike(_NUMBERED), F.lower(F.regexp_extract(name, _NUMBERED, 1)))


def decision_number(path: Column) -> Column:
    return F.regexp_extract(F.element_at(segments(path), -1), _NUMBERED, 2).try_cast("long")


def resolve_path(source: Column, target: Column) -> Column:
    """A relative target against the source's directory; null if it leaves the root."""
    parts = F.concat(F.slice(segments(source), 1, F.size(segments(source)) - 1), segments(target))

    def step(stack: Column, part: Column) -> Column:
        up = F.when(F.size(stack["s"]) == 0, F.struct(stack["s"].alias("s"), F.lit(True).alias("out"))).otherwise(
            F.struct(F.slice(stack["s"], 1, F.size(stack["s"]) - 1).alias("s"), stack["out"].alias("out"))
        )
        return F.when((part == ".") | (part == ""), stack).when(part == "..", up).otherwise(F.struct(F.concat(stack["s"], F.array(part)).alias("s"), stack["out"].alias("out")))

    start = F.struct(F.array().cast("array<string>").alias("s"), F.lit(False).alias("out"))
    folded = F.aggregate(parts, start, step)
    return F.when(~folded["out"], F.array_join(folded["s"], "/"))


def link_kind(target: Column) -> Column:
    """What a link points at: external, self, absolute or relative."""
    return (
        F.when(target.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:") | F.startswith(target, F.lit("//")), "external")
        .when(F.startswith(target, F.lit("#")) | (target == ""), "self")
        .when(F.startswith(target, F.lit("/")), "absolute")
        .otherwise("relative")
    )
