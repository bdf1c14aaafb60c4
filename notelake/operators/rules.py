"""Rules as data: a registry table says what each field of each type must be, one pass applies all of it.

``registry(type, field, rule, argument, code, severity)``: ``type`` is a document type or ``*`` for all.
Rules: required; string, boolean, list, mapping (the kind of value); pattern (``argument`` is a regular
expression that a string must match); one_of and each_one_of (``argument`` names a vocabulary);
list_of_strings, lowercase_items, each_mapping and mapping_of_mappings (what the members must be, for
values of the right kind); equals (the string ``argument`` and nothing else); reference (an identity, null
is none); alone (the field ``argument`` must not stand beside it); members (``argument`` ``by,at``: names
that a mapping has), member_pattern (``by,at|pattern``) and member_time (``at,by``), which judge the first
name's value in a mapping that has all of them; each_members, each_member_pattern and each_member_time, the
same for the mappings of a list. A null value is absent, but for boolean, reference and alone. ``vocabularies(name, value)`` are the lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions.layout import role
from notelake.operators.records import fields_of, shape, text_of
from notelake.operators.sizes import broadcast_if_small

#: The form of a reference, of a time with an offset, and the one field that the root index may have.
REFERENCE = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
TIME = r"^\d{4}-\d{2}-\d{2}[T ]([01]\d|2[0-3])(:[0-5]\d(:[0-5]\d([.,]\d+)?)?)?(Z|[+-]([01]\d|2[0-3])(:?[0-5]\d)?)$"
ROOT_FIELD = "okf_version"
#: Rules, whether the value of a field breaks them as a whole, in which case the value is named.
_KINDS = {"string": "STRING", "boolean": "BOOLEAN", "list": "ARRAY", "mapping": "OBJECT"}


def _is_time(text: Column) -> Column:
    """Whether a text is a date that exists with a time and an offset."""
    return F.coalesce(text.rlike(TIME) & F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))


def _broken(rule: Column, value: Column, present: Column, beside: Column) -> Column:
    """The texts that break the rule: the value, or those of its members that do; empty where it holds."""
    kind, none = shape(value), F.array().cast("array<string>")
    given = kind.isNotNull() & (kind != "VOID")
    whole = F.array(F.coalesce(text_of(value), F.lit("null")))
    items = F.coalesce(F.when(kind == "ARRAY", value.try_cast("array<variant>")), F.array().cast("array<variant>"))
    members = F.when(kind == "OBJECT", F.map_entries(value.try_cast("map<string, variant>")))
    texts = lambda keep: F.transform(F.filter(items, keep), lambda x: F.coalesce(text_of(x), F.lit("null")))
    allowed = lambda text: F.array_contains(F.coalesce(rule["allowed"], none), text)
    name = rule["rule"]
    wrong_kind = F.lit(False)
    for asked, wanted in _KINDS.items():
        wrong_kind = wrong_kind | ((name == asked) & (kind != wanted) & (given | F.lit(asked == "boolean")))
    text = F.when(kind == "STRING", value.try_cast("string"))
    like = lambda tested, pattern: F.coalesce(F.regexp_like(tested, pattern), F.lit(False))
    string = lambda x: F.when(shape(x) == "STRING", x.try_cast("string"))
    blocks = F.transform(F.filter(F.when(F.startswith(name, F.lit("each_")), items).when(kind == "OBJECT", F.array(value)), lambda x: shape(x) == "OBJECT"), fields_of)
    asked = F.split(F.split_part(rule["argument"], F.lit("|"), F.lit(1)), ",")
    complete = lambda block: F.forall(asked, lambda name: F.map_contains_key(block, name))
    # Names hold no bar, so what stands behind the first one is the pattern.
    behind = F.regexp_replace(rule["argument"], "^[^|]*[|]", "")
    firsts = F.transform(F.filter(blocks, complete), lambda block: F.element_at(block, F.get(asked, F.lit(0))))
    told = lambda keep: F.coalesce(F.transform(F.filter(firsts, keep), lambda x: F.coalesce(text_of(x), F.lit("null"))), none)
    return (
        F.when(name == "required", F.when(~present, F.array(F.lit(""))).otherwise(none))
        .when(~present, none)
        .when(wrong_kind, whole)
        .when(name == "reference", F.when(like(text, F.lit(REFERENCE)), none).otherwise(whole))
        .when(name == "alone", F.when(F.coalesce(beside, F.lit(False)), whole).otherwise(none))
        .when(~given, none)
        .when(name == "pattern", F.when(F.coalesce(F.regexp_like(text, rule["argument"]), F.lit(False)), none).otherwise(whole))
        .when(name == "equals", F.when(F.coalesce(text == rule["argument"], F.lit(False)), none).otherwise(whole))
        .when(name == "each_mapping", texts(lambda x: ~shape(x).isin("OBJECT", "VOID")))
        .when(name.isin("members", "each_members"), F.coalesce(F.transform(F.filter(blocks, lambda block: ~complete(block)), lambda block: F.array_join(F.array_sort(F.map_keys(block)), ",")), none))
        .when(name.isin("member_pattern", "each_member_pattern"), told(lambda x: ~like(string(x), behind)))
        .when(name.isin("member_time", "each_member_time"), told(lambda x: ~_is_time(string(x))))
        .when(name == "one_of", F.when(F.coalesce(allowed(text), F.lit(False)), none).otherwise(whole))
        .when(name == "each_one_of", texts(lambda x: F.coalesce(~allowed(F.when(shape(x) == "STRING", x.try_cast("string"))), F.lit(True))))
        .when(name == "list_of_strings", texts(lambda x: shape(x) != "STRING"))
        .when(name == "lowercase_items", texts(lambda x: (shape(x) == "STRING") & (F.lower(x.try_cast("string")) != x.try_cast("string"))))
        .when(name == "mapping_of_mappings", F.coalesce(F.transform(F.filter(members, lambda e: shape(e["value"]) != "OBJECT"), lambda e: e["key"]), none))
        .otherwise(none)
    )


def compiled(registry: DataFrame, vocabularies: DataFrame) -> DataFrame:
    """The registry by type, ``(type, rules)``, with each rule's vocabulary beside it."""
    lists = vocabularies.groupBy(F.col("name").alias("argument")).agg(F.collect_set("value").alias("allowed"))
    rule = F.struct("field", "rule", "argument", "code", "severity", "allowed")
    return registry.join(lists, "argument", "left").groupBy("type").agg(F.array_sort(F.collect_list(rule)).alias("rules"))


def apply_rules(notes: DataFrame, registry: DataFrame, vocabularies: DataFrame) -> DataFrame:
    """``(path, code, severity, field, value)`` for all that breaks a rule in ``notes(path, frontmatter VARIANT)``.

    A note meets the rules of its type and those of all types. Rules go to the notes, which are not
    shuffled as long as the registry is small. ``value`` is the text that breaks the rule, empty for an
    absent field. Notes whose front matter is null or no object have no fields; unknown rule names find nothing.
    """
    rules = broadcast_if_small(compiled(registry, vocabularies), 10_000)
    held = notes.select("path", F.coalesce(fields_of(F.col("frontmatter")), F.create_map().cast("map<string, variant>")).alias("f"))
    kind = F.element_at("f", F.lit("type"))
    typed = held.withColumn("type", F.explode(F.array_compact(F.array(F.lit("*"), F.when(shape(kind) == "STRING", kind.try_cast("string"))))))
    each = typed.join(rules, "type").select("path", "f", F.explode("rules").alias("r"))
    value = F.element_at("f", F.col("r.field"))
    broken = _broken(F.col("r"), value, F.map_contains_key("f", F.col("r.field")), F.map_contains_key("f", F.col("r.argument")))
    found = each.select("path", "r", F.explode(broken).alias("value"))
    return found.select("path", "r.code", "r.severity", "r.field", "value")


def reserved_findings(notes: DataFrame) -> DataFrame:
    """``(path, code, severity, field, value)`` of reserved files that carry the front matter of a concept.

    Indexes and logs have none, but the root's index may name its format. ``value`` lists the fields that must
    go, in order. Concepts and files of other formats are not judged here.
    """
    kind = role(F.col("path"))
    names = F.map_keys(fields_of(F.col("frontmatter")))
    wrong = F.filter(names, lambda name: ~((kind == "root_index") & (name == ROOT_FIELD)))
    held = notes.select("path", F.when(~kind.isin("concept", "foreign_format"), F.array_sort(wrong)).alias("wrong")).filter(F.size("wrong") > 0)
    return held.select("path", F.lit("reserved_document_has_frontmatter").alias("code"), F.lit("error").alias("severity"), F.lit("").alias("field"), F.array_join("wrong", ",").alias("value"))


def validate(notes: DataFrame, registry: DataFrame, vocabularies: DataFrame) -> DataFrame:
    """All findings: reserved files by their own rule, concepts by the registry, files of other formats by none."""
    concepts = notes.filter(role(F.col("path")) == "concept")
    return reserved_findings(notes).unionByName(apply_rules(concepts, registry, vocabularies))


def written_vocabularies(notes: DataFrame) -> DataFrame:
    """``(name, value)`` of the registry documents among the notes: their ``registry`` field names the list, ``values`` holds it."""
    held = notes.select(fields_of(F.col("frontmatter")).alias("f"))
    field = lambda name: F.element_at("f", F.lit(name))
    lists = held.filter((shape(field("type")) == "STRING") & (field("type").try_cast("string") == "registry") & (shape(field("values")) == "ARRAY"))
    each = lists.select(text_of(field("registry")).alias("name"), F.explode(field("values").try_cast("array<variant>")).alias("v"))
    return each.filter(shape(F.col("v")) == "STRING").select("name", F.col("v").try_cast("string").alias("value")).distinct()
