"""Reserved files, references, schema versions and actors over front matter made from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelake.operators import rules
from notelake.plans.fixtures import view
from notelake.plans.registry import query

_V = "concat('0190a000-0000-7000-8000-', lpad(cast(doc_id AS string), 12, '0'))"


def _block(number: str) -> str:
    """A mapping of an actor and a time, with one or both odd or absent."""
    return f"""CASE {number} % 8 WHEN 0 THEN '{{"at":"2024-05-01T10:00:00Z","by":"human:ann"}}' WHEN 1 THEN '{{"at":"2024-05-01","by":"process:sync.1"}}' WHEN 2 THEN '{{"at":"2024-02-30T10:00:00+02:00","by":"tool/1.0"}}' WHEN 3 THEN '{{"by":"human:ann"}}'
    WHEN 4 THEN '{{"at":"2024-05-01T10:00:00+02:00","by":"ann@example"}}' WHEN 5 THEN '{{"at":12,"by":["x"]}}' WHEN 6 THEN '{{"at":null,"by":"human:","note":"x"}}' ELSE '{{"at":"2024-05-01T10:00:00","by":null}}' END"""


#: Notes in all roles; names of fields stand in order, so both engines write the front matter alike.
NOTES = f"""SELECT doc_id, CASE WHEN doc_id % 40 = 7 THEN 'index.md' WHEN doc_id % 20 = 3 THEN concat('10_Workspaces/', source, '/', cast(doc_id AS string), '/index.md') WHEN doc_id % 20 = 13 THEN concat('10_Workspaces/', source, '/', cast(doc_id AS string), '/log.md')
  WHEN doc_id % 20 = 17 THEN concat('50_System/Templates/', lang, '/', cast(doc_id AS string), '.md') ELSE concat('10_Workspaces/', source, '/', lang, '/', cast(doc_id AS string), '.md') END AS path, concat('{{', concat_ws(',',
  CASE doc_id % 6 WHEN 0 THEN concat('"area":"', {_V}, '"') WHEN 1 THEN '"area":null' WHEN 2 THEN '"area":"Home"' END,
  CASE doc_id % 5 WHEN 0 THEN concat('"generated":', {_block('floor(doc_id / 5)')}) WHEN 1 THEN '"generated":"ann"' WHEN 2 THEN '"generated":null' WHEN 3 THEN '"generated":[{{"by":1}}]' END,
  CASE WHEN doc_id % 40 = 7 OR doc_id % 60 = 3 THEN '"okf_version":"0.1"' END,
  CASE doc_id % 7 WHEN 0 THEN concat('"parent":"', {_V}, '"') WHEN 1 THEN '"parent":7' WHEN 2 THEN concat('"parent":"', upper({_V}), 'A"') END,
  CASE doc_id % 4 WHEN 0 THEN '"schema":"notes/1"' WHEN 1 THEN '"schema":"notes/2"' WHEN 2 THEN '"schema":1' END,
  CASE doc_id % 9 WHEN 0 THEN concat('"verified":[', {_block('floor(doc_id / 9)')}, ',null,', {_block('(floor(doc_id / 9) + 3)')}, ',"ann"]') WHEN 1 THEN '"verified":"ann"' WHEN 2 THEN '"verified":{{"by":"human:ann"}}' WHEN 3 THEN '"verified":[]' END,
  CASE doc_id % 4 WHEN 0 THEN concat('"workspace":"', {_V}, '"') WHEN 1 THEN '"workspace":"bad"' WHEN 2 THEN '"workspace":null' END), '}}') AS fm FROM documents"""

_ACTOR = r"^(?:human:[\w.-]+|process:[\w.-]+|[\w.-]+/[\w.-]+)$"
#: The registry of the queries: one row a rule.
REGISTRY = (
    ("*", "schema", "equals", "notes/1", "unrecognised_schema", "warning"),
    ("*", "workspace", "reference", None, "invalid_workspace_reference", "error"),
    ("*", "parent", "reference", None, "invalid_parent_reference", "error"),
    ("*", "area", "reference", None, "invalid_area_reference", "error"),
    ("*", "area", "alone", "workspace", "conflicting_scope_fields", "error"),
    ("*", "generated", "mapping", None, "invalid_generated", "error"),
    ("*", "generated", "members", "by,at", "incomplete_generated", "error"),
    ("*", "generated", "member_pattern", f"by,at|{_ACTOR}", "invalid_actor", "error"),
    ("*", "generated", "member_time", "at,by", "invalid_timestamp", "error"),
    ("*", "verified", "list", None, "invalid_verified", "error"),
    ("*", "verified", "each_mapping", None, "invalid_verified", "error"),
    ("*", "verified", "each_members", "by,at", "incomplete_verified", "error"),
    ("*", "verified", "each_member_pattern", f"by,at|{_ACTOR}", "invalid_actor", "error"),
    ("*", "verified", "each_member_time", "at,by", "invalid_timestamp", "error"),
)


def _notes(spark, sf):
    return view(spark, sf, NOTES).withColumn("frontmatter", F.parse_json("fm"))


def _found(spark, sf, *fields):
    registry = spark.createDataFrame([r for r in REGISTRY if not fields or r[1] in fields], "type string, field string, rule string, argument string, code string, severity string")
    return rules.validate(_notes(spark, sf), registry, spark.createDataFrame([], "name string, value string"))


#: Concepts with their front matter, and the blocks of the two fields that hold actors.
_TWIN = f"""WITH every AS (SELECT doc_id, path, fm::JSON AS fm FROM ({NOTES.replace('AS string', 'AS VARCHAR')})), notes AS (SELECT * FROM every WHERE NOT (path = 'index.md' OR path LIKE '%/index.md' OR path LIKE '%/log.md' OR path LIKE '50_System/Templates/%')),
  blocks AS (SELECT path, 'generated' AS field, fm -> '$.generated' AS b FROM notes WHERE json_type(fm, '$.generated') = 'OBJECT' UNION ALL SELECT path, 'verified', b FROM (SELECT path, unnest(json_extract(fm, '$.verified[*]')) AS b FROM notes WHERE json_type(fm, '$.verified') = 'ARRAY') WHERE json_type(b) = 'OBJECT'),
  complete AS (SELECT * FROM blocks WHERE list_contains(json_keys(b), 'by') AND list_contains(json_keys(b), 'at'))"""
_RESERVED = """SELECT path, 'reserved_document_has_frontmatter' AS code, 'error' AS severity, '' AS field, array_to_string(list_sort(k), ',') AS value FROM (SELECT path, list_filter(json_keys(fm), lambda x: NOT (path = 'index.md' AND x = 'okf_version')) AS k FROM every WHERE path = 'index.md' OR path LIKE '%/index.md' OR path LIKE '%/log.md') WHERE len(k) > 0"""
_HEX = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
_SCHEMA = "SELECT path, 'unrecognised_schema' AS code, 'warning' AS severity, 'schema' AS field, fm ->> '$.schema' AS value FROM notes WHERE json_type(fm, '$.schema') <> 'NULL' AND NOT (json_type(fm, '$.schema') = 'VARCHAR' AND fm ->> '$.schema' = 'notes/1')"
_REFERENCES = " UNION ALL ".join(
    f"SELECT path, 'invalid_{f}_reference' AS code, 'error' AS severity, '{f}' AS field, coalesce(fm ->> '$.{f}', 'null') AS value FROM notes WHERE json_exists(fm, '$.{f}') AND NOT (json_type(fm, '$.{f}') = 'VARCHAR' AND regexp_full_match(fm ->> '$.{f}', '{_HEX}'))" for f in ("workspace", "parent", "area")
) + " UNION ALL SELECT path, 'conflicting_scope_fields', 'error', 'area', coalesce(fm ->> '$.area', 'null') FROM notes WHERE json_exists(fm, '$.area') AND json_exists(fm, '$.workspace')"
_TIME = r"regexp_full_match(b ->> '$.at', '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:\d{2})') AND try_cast(left(b ->> '$.at', 10) AS DATE) IS NOT NULL"
_ACTORS = f"""SELECT path, 'invalid_generated' AS code, 'error' AS severity, 'generated' AS field, fm ->> '$.generated' AS value FROM notes WHERE json_type(fm, '$.generated') NOT IN ('OBJECT', 'NULL')
  UNION ALL SELECT path, 'invalid_verified', 'error', 'verified', fm ->> '$.verified' FROM notes WHERE json_type(fm, '$.verified') NOT IN ('ARRAY', 'NULL')
  UNION ALL SELECT path, 'invalid_verified', 'error', 'verified', b ->> '$' FROM (SELECT path, unnest(json_extract(fm, '$.verified[*]')) AS b FROM notes WHERE json_type(fm, '$.verified') = 'ARRAY') WHERE json_type(b) NOT IN ('OBJECT', 'NULL')
  UNION ALL SELECT path, 'incomplete_' || field, 'error', field, array_to_string(list_sort(json_keys(b)), ',') FROM blocks WHERE NOT (list_contains(json_keys(b), 'by') AND list_contains(json_keys(b), 'at'))
  UNION ALL SELECT path, 'invalid_actor', 'error', field, coalesce(b ->> '$.by', 'null') FROM complete WHERE NOT (json_type(b, '$.by') = 'VARCHAR' AND regexp_full_match(b ->> '$.by', 'human:[\\w.-]+|process:[\\w.-]+|[\\w.-]+/[\\w.-]+'))
  UNION ALL SELECT path, 'invalid_timestamp', 'error', field, coalesce(b ->> '$.at', 'null') FROM complete WHERE NOT (json_type(b, '$.at') = 'VARCHAR' AND {_TIME})"""


@query("rule_reserved", f"{_TWIN} {_RESERVED}")
def rule_reserved(spark, sf):
    return rules.reserved_findings(_notes(spark, sf))


@query("rule_schema", f"{_TWIN} {_RESERVED} UNION ALL {_SCHEMA}")
def rule_schema(spark, sf):
    return _found(spark, sf, "schema")


@query("rule_references", f"{_TWIN} {_RESERVED} UNION ALL {_REFERENCES}")
def rule_references(spark, sf):
    return _found(spark, sf, "workspace", "parent", "area")


@query("rule_actors", f"{_TWIN} {_RESERVED} UNION ALL {_ACTORS}")
def rule_actors(spark, sf):
    return _found(spark, sf, "generated", "verified")


@query("validate_registry", f"{_TWIN}, found AS ({_RESERVED} UNION ALL {_SCHEMA} UNION ALL {_REFERENCES} UNION ALL {_ACTORS}) SELECT code, severity, count(*) AS findings, count(DISTINCT path) AS notes FROM found GROUP BY ALL")
def validate_registry(spark, sf):
    """Findings of the whole registry by code."""
    return _found(spark, sf).groupBy("code", "severity").agg(F.count("*").alias("findings"), F.countDistinct("path").alias("notes"))
