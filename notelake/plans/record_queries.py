"""VARIANT records and registry-driven rules over front matter made from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelake.operators import records, rules
from notelake.plans.fixtures import view
from notelake.plans.registry import query

c = F.col

_ID = "concat('0190a000-0000-7000-8000-', lpad(cast(doc_id AS string), 12, '0'))"
#: Front matter of documents as JSON, with missing, odd and nested fields; names stand in order, so both engines write it alike.
FRONT = f"""SELECT doc_id, concat('d', cast(doc_id AS string)) AS concept_id, concat(lang, '/', source, '/', cast(doc_id AS string), '.md') AS path, concat('{{', concat_ws(',',
  CASE doc_id % 4 WHEN 0 THEN concat('"area":"', {_ID}, '"') WHEN 1 THEN '"area":"nowhere"' END,
  CASE doc_id % 5 WHEN 0 THEN '"authority":"derived"' WHEN 1 THEN '"authority":"bogus"' WHEN 2 THEN '"authority":3' WHEN 3 THEN '"authority":null' END,
  CASE doc_id % 3 WHEN 0 THEN concat('"created_at":"2024-01-0', cast(doc_id % 9 + 1 AS string), '"') END,
  CASE doc_id % 9 WHEN 0 THEN '"domains":["' || lang || '","x"]' WHEN 1 THEN '"domains":"' || lang || '"' WHEN 2 THEN '"domains":[1,"en"]' END,
  CASE doc_id % 6 WHEN 0 THEN concat('"due":{{"at":', cast(doc_id AS string), ',"by":["x",2]}}') WHEN 1 THEN '"due":"later"' END,
  CASE doc_id % 8 WHEN 0 THEN '"extensions":["x"]' WHEN 1 THEN '"extensions":{{"loose":3,"tool":{{"a":1}}}}' WHEN 2 THEN '"extensions":"text"' WHEN 3 THEN '"extensions":{{"tool":{{}}}}' END,
  CASE doc_id % 5 WHEN 0 THEN '"lifecycle":" accepted "' WHEN 1 THEN '"lifecycle":""' WHEN 2 THEN '"lifecycle":7' END,
  CASE doc_id % 7 WHEN 0 THEN '"priority":"high"' WHEN 1 THEN '"priority":"urgent"' WHEN 2 THEN '"priority":["low"]' END,
  CASE doc_id % 9 WHEN 0 THEN '"profiles":"base"' WHEN 1 THEN '"profiles":["base","unknown"]' WHEN 2 THEN '"profiles":{{"a":1}}' WHEN 3 THEN '"profiles":["research",7]' END,
  CASE WHEN doc_id % 11 = 0 THEN concat('"registry":"', source, '"') END,
  CASE doc_id % 10 WHEN 0 THEN '"required_reading":"true"' WHEN 1 THEN '"required_reading":true' WHEN 2 THEN '"required_reading":null' END,
  CASE doc_id % 4 WHEN 0 THEN '"status":"stable"' WHEN 1 THEN '"status":"odd"' END,
  CASE doc_id % 8 WHEN 0 THEN '"tags":"solo"' WHEN 1 THEN '"tags":["a"," b ","",3]' WHEN 2 THEN '"tags":{{"k":1}}' WHEN 3 THEN '"tags":""' WHEN 4 THEN '"tags":["Upper","low"]' END,
  CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '"title":42' WHEN 2 THEN '"title":"  "' ELSE concat('"title":"Title ', cast(doc_id AS string), '"') END,
  CASE WHEN doc_id % 11 = 0 THEN '"type":"registry"' WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN '"type":["note"]' WHEN doc_id % 5 = 2 THEN '"type":" task "' ELSE '"type":"decision"' END,
  CASE doc_id % 4 WHEN 0 THEN '"values":"one"' WHEN 1 THEN '"values":["a",2]' WHEN 2 THEN concat('"values":["', lang, '","b"]') END,
  CASE doc_id % 6 WHEN 0 THEN concat('"workspace":"', {_ID}, '"') WHEN 1 THEN '"workspace":"bad"' WHEN 2 THEN '"workspace":12' WHEN 3 THEN '"workspace":null' END,
  CASE WHEN doc_id % 3 = 1 THEN '"zeta":true' END), '}}') AS fm FROM documents"""


def front(spark, sf):
    return view(spark, sf, FRONT).withColumn("frontmatter", F.parse_json("fm"))


def with_front(sql: str) -> str:
    return f"WITH front AS (SELECT doc_id, concept_id, path, fm::JSON AS fm FROM ({FRONT.replace('AS string', 'AS VARCHAR')})) {sql}"


def _string(name: str) -> str:
    return f"CASE WHEN json_type(fm, '$.{name}') = 'VARCHAR' THEN nullif(trim(fm ->> '$.{name}'), '') END"


def _list(name: str) -> str:
    return f"""coalesce(CASE json_type(fm, '$.{name}') WHEN 'ARRAY' THEN list_filter(list_transform(json_extract(fm, '$.{name}[*]'), lambda x: trim(x ->> '$')), lambda x: x <> '') WHEN 'VARCHAR' THEN CASE WHEN trim(fm ->> '$.{name}') <> '' THEN [fm ->> '$.{name}'] END END, [])"""


_VALID = r"'[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}'"


@query("metadata_record", with_front(f""", t AS (SELECT *, CASE WHEN json_type(fm, '$.title') = 'VARCHAR' AND trim(fm ->> '$.title') <> '' THEN fm ->> '$.title' END AS given, CASE WHEN json_type(fm, '$.workspace') <> 'NULL' THEN fm ->> '$.workspace' END AS w, CASE WHEN json_type(fm, '$.area') <> 'NULL' THEN fm ->> '$.area' END AS a FROM front)
  SELECT concept_id, coalesce({_string('type')}, 'unknown') AS type, path, coalesce(given, regexp_extract(path, '([^/]*)\\.md$', 1)) AS title,
    CASE WHEN regexp_full_match(w, {_VALID}) THEN w WHEN regexp_full_match(a, {_VALID}) THEN a END AS workspace_id, {_list('tags')} AS tags, {_list('domains')} AS domains, {_string('lifecycle')} AS lifecycle, {_string('status')} AS status, {_string('authority')} AS authority,
    list_sort(list_transform(list_filter(json_keys(fm), lambda k: NOT k IN ('id', 'type', 'title', 'tags', 'domains', 'lifecycle', 'status', 'authority', 'workspace')), lambda k: concat(k, '=', json_extract(fm, concat('$.', k))::VARCHAR))) AS extra,
    list_filter([CASE WHEN given IS NULL THEN 'missing_title' END, CASE WHEN NOT regexp_full_match(w, {_VALID}) THEN 'invalid_workspace_reference' END, CASE WHEN NOT coalesce(regexp_full_match(w, {_VALID}), false) AND NOT regexp_full_match(a, {_VALID}) THEN 'invalid_area_reference' END], lambda x: x IS NOT NULL) AS issues FROM t"""))
def metadata_record(spark, sf):
    return records.metadata_record(front(spark, sf)).withColumn("extra", records.entries(c("extra")))


#: Tracker pages made from orders: links with and without href, empty dates, long descriptions, custom fields.
PAYLOADS = """SELECT o_orderkey, concat('{', concat_ws(',', CASE WHEN o_orderkey % 3 = 0 THEN concat('"createdAt":"', substring(cast(o_orderdate AS string), 1, 10), 'T00:00:00Z"') END,
  CASE WHEN o_orderkey % 4 = 0 THEN '"customField12":{"a":[1]}' END, CASE WHEN o_orderkey % 5 = 0 THEN '"customFieldX":1' END,
  CASE o_orderkey % 4 WHEN 0 THEN concat('"description":{"raw":"', repeat(concat(o_orderpriority, '   text  '), 20), '"}') WHEN 1 THEN '"description":{"raw":""}' WHEN 2 THEN '"description":"plain"' ELSE concat('"description":{"raw":" order  ', cast(o_orderkey AS string), ' "}') END,
  CASE WHEN o_orderkey % 7 = 0 THEN concat('"displayId":"P-', cast(o_orderkey AS string), '"') END, CASE WHEN o_orderkey % 2 = 0 THEN '"dueDate":""' ELSE '"dueDate":"2024-05-01"' END,
  concat('"id":', cast(o_orderkey AS string)), CASE WHEN o_orderkey % 6 = 1 THEN '"percentageDone":40' END, concat('"subject":"', o_orderpriority, '"'),
  concat('"_links":{"parent":{', CASE WHEN o_orderkey % 3 = 1 THEN concat('"href":"/api/v3/work_packages/', cast(o_custkey AS string), '/"') ELSE '"href":null' END, '},"status":{', CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE '"href":"/s/1",' END, '"title":"', o_orderstatus, '"}}')), '}') AS payload FROM orders"""


@query("normalize_work_items", f"""WITH p AS (SELECT payload::JSON AS j, regexp_replace(trim(regexp_replace(payload::JSON ->> '$.description.raw', '\\s+', ' ', 'g')), '', '') AS d FROM ({PAYLOADS.replace('AS string', 'AS VARCHAR')}))
  SELECT j ->> '$.id' AS external_id, j ->> '$.subject' AS title, CASE WHEN j ->> '$._links.status.href' IS NOT NULL THEN j ->> '$._links.status.title' END AS status, concat('http://tracker/work_packages/', j ->> '$.id') AS url,
    nullif(regexp_extract(j ->> '$._links.parent.href', '([^/]*)/*$', 1), '') AS parent, coalesce(j ->> '$.displayId', j ->> '$.id') AS display_id, CASE WHEN d <> '' THEN CASE WHEN length(d) <= 240 THEN d ELSE concat(rtrim(left(d, 239)), '…') END END AS excerpt,
    nullif(j ->> '$.dueDate', '') AS due_date, j ->> '$.createdAt' AS created_at, j ->> '$.percentageDone' AS percent_complete, coalesce(j -> '$.customField12', NULL)::VARCHAR AS custom, CASE WHEN json_exists(j, '$.customField12') THEN 1 ELSE 0 END AS extensions FROM p""")
def normalize_work_items(spark, sf):
    pages = view(spark, sf, PAYLOADS).select(F.parse_json("payload").alias("payload"))
    made = records.normalize_work_items(pages, "main", "demo", "http://tracker/")
    extra = lambda name: F.element_at("extra", F.lit(name))
    return made.select(
        "external_id", "title", "status", "url", F.nullif("parent", F.lit("")).alias("parent"), extra("display_id").alias("display_id"), extra("description_excerpt").alias("excerpt"), extra("due_date").alias("due_date"), extra("created_at").alias("created_at"),
        extra("percent_complete").alias("percent_complete"), F.to_json(F.element_at("extensions", F.lit("customField12"))).alias("custom"), F.size("extensions").alias("extensions"),
    )


#: The registry of the queries: one row a rule.
REGISTRY = (
    ("registry", "values", "list", None, "invalid_registry_values", "error"),
    ("registry", "values", "list_of_strings", None, "invalid_registry_values", "error"),
    ("*", "profiles", "list", None, "invalid_profiles", "error"),
    ("*", "profiles", "each_one_of", "profiles", "unregistered_profile", "warning"),
    ("*", "extensions", "mapping", None, "invalid_extensions", "error"),
    ("*", "extensions", "mapping_of_mappings", None, "invalid_extensions", "error"),
    ("*", "required_reading", "boolean", None, "invalid_required_reading", "error"),
    ("*", "authority", "one_of", "authorities", "invalid_authority", "error"),
    ("*", "priority", "one_of", "priorities", "invalid_priority", "error"),
    ("*", "title", "required", None, "missing_required_field", "error"),
    ("*", "type", "required", None, "missing_required_field", "error"),
    ("*", "tags", "list", None, "invalid_list_field", "error"),
    ("*", "tags", "lowercase_items", None, "unnormalised_tag", "warning"),
    ("*", "domains", "list", None, "invalid_list_field", "error"),
    ("*", "domains", "each_one_of", "written", "unregistered_domain", "warning"),
)
VOCABULARIES = {"profiles": ("base", "research"), "authorities": ("authoritative", "informational", "provisional", "derived"), "priorities": ("low", "normal", "high", "critical")}


def _found(spark, sf, *codes):
    notes = front(spark, sf)
    registry = spark.createDataFrame([r for r in REGISTRY if r[4] in codes], "type string, field string, rule string, argument string, code string, severity string")
    fixed = spark.createDataFrame([(n, v) for n, values in VOCABULARIES.items() for v in values], "name string, value string")
    written = rules.written_vocabularies(notes).select(F.lit("written").alias("name"), "value")
    return rules.apply_rules(notes, registry, fixed.unionByName(written.distinct()))


def _whole(field: str, code: str, wanted: str, more: str = "true") -> str:
    return f"SELECT path, '{code}' AS code, 'error' AS severity, '{field}' AS field, fm ->> '$.{field}' AS value FROM front WHERE json_type(fm, '$.{field}') NOT IN ('{wanted}', 'NULL') AND {more}"


def _items(field: str, code: str, severity: str, broken: str, more: str = "true") -> str:
    return f"SELECT path, '{code}', '{severity}', '{field}', x ->> '$' FROM (SELECT path, unnest(json_extract(fm, '$.{field}[*]')) AS x FROM front WHERE json_type(fm, '$.{field}') = 'ARRAY' AND {more}) WHERE {broken}"


_REGISTRY_TYPE = "fm ->> '$.type' = 'registry'"


@query("rule_registry", with_front(f"{_whole('values', 'invalid_registry_values', 'ARRAY', _REGISTRY_TYPE)} UNION ALL {_items('values', 'invalid_registry_values', 'error', "json_type(x) <> 'VARCHAR'", _REGISTRY_TYPE)}"))
def rule_registry(spark, sf):
    return _found(spark, sf, "invalid_registry_values")


@query("rule_profiles_extensions", with_front(f"""{_whole('profiles', 'invalid_profiles', 'ARRAY')} UNION ALL {_items('profiles', 'unregistered_profile', 'warning', "NOT (json_type(x) = 'VARCHAR' AND x ->> '$' IN ('base', 'research'))")}
  UNION ALL {_whole('extensions', 'invalid_extensions', 'OBJECT')} UNION ALL SELECT path, 'invalid_extensions', 'error', 'extensions', k FROM (SELECT path, fm, unnest(json_keys(fm, '$.extensions')) AS k FROM front WHERE json_type(fm, '$.extensions') = 'OBJECT') WHERE json_type(fm, concat('$.extensions.', k)) <> 'OBJECT'"""))
def rule_profiles_extensions(spark, sf):
    return _found(spark, sf, "invalid_profiles", "unregistered_profile", "invalid_extensions")


@query("rule_booleans", with_front("SELECT path, 'invalid_required_reading' AS code, 'error' AS severity, 'required_reading' AS field, coalesce(fm ->> '$.required_reading', 'null') AS value FROM front WHERE json_exists(fm, '$.required_reading') AND json_type(fm, '$.required_reading') <> 'BOOLEAN'"))
def rule_booleans(spark, sf):
    return _found(spark, sf, "invalid_required_reading")


@query("rule_vocabularies", with_front("""SELECT path, 'invalid_authority' AS code, 'error' AS severity, 'authority' AS field, fm ->> '$.authority' AS value FROM front WHERE json_type(fm, '$.authority') <> 'NULL' AND NOT fm ->> '$.authority' IN ('authoritative', 'informational', 'provisional', 'derived')
  UNION ALL SELECT path, 'invalid_priority', 'error', 'priority', fm ->> '$.priority' FROM front WHERE json_exists(fm, '$.priority') AND NOT fm ->> '$.priority' IN ('low', 'normal', 'high', 'critical')"""))
def rule_vocabularies(spark, sf):
    return _found(spark, sf, "invalid_authority", "invalid_priority")


@query("rule_required", with_front("SELECT path, 'missing_required_field' AS code, 'error' AS severity, f AS field, '' AS value FROM front, (VALUES ('title'), ('type')) t(f) WHERE NOT list_contains(json_keys(fm), f)"))
def rule_required(spark, sf):
    return _found(spark, sf, "missing_required_field")


@query("rule_classification", with_front(f""", written AS (SELECT DISTINCT x ->> '$' AS v FROM (SELECT unnest(json_extract(fm, '$.values[*]')) AS x FROM front WHERE {_REGISTRY_TYPE} AND json_type(fm, '$.values') = 'ARRAY') WHERE json_type(x) = 'VARCHAR')
  {_whole('tags', 'invalid_list_field', 'ARRAY')} UNION ALL {_whole('domains', 'invalid_list_field', 'ARRAY')} UNION ALL {_items('tags', 'unnormalised_tag', 'warning', "json_type(x) = 'VARCHAR' AND lower(x ->> '$') <> x ->> '$'")}
  UNION ALL {_items('domains', 'unregistered_domain', 'warning', "NOT (json_type(x) = 'VARCHAR' AND x ->> '$' IN (SELECT v FROM written))")}"""))
def rule_classification(spark, sf):
    """The domain list is what the registry documents among the notes write."""
    return _found(spark, sf, "invalid_list_field", "unnormalised_tag", "unregistered_domain")
