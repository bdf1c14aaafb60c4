"""Identities of documents whose front matter is partly gone, and notes with their edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelake.operators import identity
from notelake.plans.fixtures import edges, notes, view, with_notes
from notelake.plans.registry import query

c = F.col
_PATH = "concat(CASE doc_id % 10 WHEN 4 THEN '00_Inbox/' WHEN 8 THEN '50_System/Templates/' ELSE '10_Workspaces/' END, source, '/', CASE WHEN doc_id % 30 = 9 THEN concat(cast(doc_id AS string), '/index') ELSE cast(doc_id AS string) END, '.md')"
#: Documents: some without identity, pairs that share one, some that claim to be the manifest.
DOCUMENTS = f"SELECT {_PATH} AS path, CASE WHEN doc_id % 6 < 2 THEN NULL WHEN doc_id % 24 = 3 THEN concat('i', cast(doc_id + 1 AS string)) ELSE concat('i', cast(doc_id AS string)) END AS concept_id, CASE WHEN doc_id % 50 = 11 THEN 'system_manifest' ELSE 'note' END AS type FROM documents"
#: What the index knew: documents it read when they had an identity.
INDEX = f"SELECT {_PATH} AS path, CASE WHEN doc_id % 12 = 1 THEN concat('i', cast(doc_id + 1 AS string)) ELSE concat('i', cast(doc_id AS string)) END AS concept_id FROM documents WHERE doc_id % 4 <> 2"


@query(
    "identity_checks",
    f"""WITH d AS ({DOCUMENTS.replace('AS string', 'AS VARCHAR')}), x AS ({INDEX.replace('AS string', 'AS VARCHAR')}),
  bare AS (SELECT d.path, (SELECT min(x.concept_id) FROM x WHERE x.path = d.path) AS lost FROM d WHERE concept_id IS NULL AND NOT path LIKE '00_Inbox/%' AND NOT path LIKE '50_System/Templates/%' AND NOT path LIKE '%/index.md')
  SELECT '50_System/system.md' AS path, 'no_vault_identity' AS code, 'error' AS severity, '' AS value WHERE NOT EXISTS (SELECT 1 FROM d WHERE path = '50_System/system.md')
  UNION ALL SELECT path, 'duplicate_vault_identity', 'error', concept_id FROM d WHERE type = 'system_manifest' AND concept_id IS NOT NULL
  UNION ALL SELECT path, 'duplicate_id', 'error', concept_id FROM d WHERE concept_id IN (SELECT concept_id FROM d GROUP BY concept_id HAVING count(*) > 1)
  UNION ALL SELECT path, CASE WHEN lost IS NULL THEN 'untracked_document' ELSE 'identity_lost' END, CASE WHEN lost IS NULL THEN 'warning' ELSE 'error' END, coalesce(lost, '') FROM bare""",
)
def identity_checks(spark, sf):
    return identity.identity_checks(view(spark, sf, DOCUMENTS), view(spark, sf, INDEX))


@query(
    "concept_view",
    with_notes("""SELECT v.concept_id, v.tag AS title, v.path, direction, relation_type, other, o.tag AS other_title, cast(row_number() OVER (PARTITION BY v.concept_id, direction ORDER BY relation_type, other) AS INTEGER) AS place
  FROM notes v LEFT JOIN (SELECT source_id AS id, 'outgoing' AS direction, relation_type, target_id AS other FROM edges UNION ALL SELECT target_id, 'incoming', relation_type, source_id FROM edges) w ON w.id = v.concept_id LEFT JOIN notes o ON o.concept_id = w.other"""),
)
def concept_view(spark, sf):
    records = notes(spark, sf).select("concept_id", c("tag").alias("title"), "path")
    return identity.concept_view(records.select("concept_id"), records, edges(spark, sf))
