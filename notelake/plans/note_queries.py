"""Markdown projection, validation and packs over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelake.functions import markdown
from notelake.operators import quality
from notelake.plans.fixtures import edges, notes, with_notes
from notelake.plans.registry import query

#: A note's body with a heading, a list and a link around the document's text.
_BODY = "concat('# ', lang, chr(10), chr(10), body, chr(10), chr(10), '## Links', chr(10), '- see [next](../', cast(doc_id AS string), '.md) and `[no](x.md)`')"


def _marked(spark, sf):
    return notes(spark, sf).withColumn("body", F.expr(_BODY.replace("chr(", "char(")))


@query("chunk_documents")
def chunk_documents(spark, sf):
    return markdown.chunk_documents(_marked(spark, sf)).select("owner", "heading_path", "ordinal", "start_line", "end_line", "chunk_key")


@query("links", with_notes("SELECT concept_id AS owner, concat('../', cast(doc_id AS VARCHAR), '.md') AS target, false AS is_name FROM notes"))
def links(spark, sf):
    return markdown.scan_notes(_marked(spark, sf), "concept_id", "body").select("owner", F.explode("links").alias("l")).select("owner", "l.target", "l.is_name")


_OK = r"regexp_full_match({}, '\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}(\.\d+)?(Z|[+-]\d{{2}}:\d{{2}})')"
VALIDATE = f"""
SELECT path, concept_id, 'missing_required_field' AS code, 'error' AS severity, 'workspace' AS field FROM notes WHERE workspace IS NULL AND type <> 'knowledge'
UNION ALL SELECT path, concept_id, 'invalid_timestamp', 'error', 'created_at' FROM notes WHERE NOT {_OK.format('created_at')}
UNION ALL SELECT path, concept_id, 'invalid_timestamp', 'error', 'stale_after' FROM notes WHERE NOT {_OK.format('stale_after')}
UNION ALL SELECT path, concept_id, 'invalid_status', 'error', 'status' FROM notes WHERE status NOT IN ('draft', 'stable', 'deprecated', 'active')
UNION ALL SELECT path, concept_id, 'invalid_lifecycle', 'warning', 'lifecycle' FROM notes WHERE (type = 'decision' AND lifecycle NOT IN ('accepted', 'proposed', 'superseded', 'rejected')) OR (type = 'standard' AND lifecycle NOT IN ('accepted', 'superseded'))
UNION ALL SELECT path, concept_id, 'unnormalised_tag', 'warning', 'tags' FROM notes WHERE tag <> lower(tag)
"""


@query("validate_corpus", with_notes(VALIDATE))
def validate_corpus(spark, sf):
    return quality.validate(notes(spark, sf))


@query("validate_changed", with_notes(f"SELECT * FROM ({VALIDATE}) WHERE concept_id IN (SELECT concept_id FROM notes WHERE doc_id % 4 = 1)"))
def validate_changed(spark, sf):
    return quality.validate_changed(notes(spark, sf), notes(spark, sf).filter("doc_id % 4 = 1"))


@query(
    "rule_relations",
    with_notes(
        "SELECT source_id, relation_type, target_id, 'unregistered_relation_type' AS code FROM edges WHERE relation_type = 'implements' "
        "UNION ALL SELECT source_id, relation_type, target_id, 'unresolved_relation_target' FROM edges WHERE target_id NOT IN (SELECT concept_id FROM notes)"
    ),
)
def rule_relations(spark, sf):
    return quality.rule_relations(edges(spark, sf), notes(spark, sf), ("superseded_by", "depends_on", "related_to", "closes"))
