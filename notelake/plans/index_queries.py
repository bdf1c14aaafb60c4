"""Stems and kept postings over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelake.functions.words import stems, words
from notelake.operators import postings
from notelake.plans import stem_sql
from notelake.plans.fixtures import table
from notelake.plans.registry import query

c = F.col


@query("stem_tokens", f"WITH {stem_sql.stems({'documents': 'text'})} SELECT token, stem, count(*) AS occurrences FROM (SELECT unnest({stem_sql.words('text')}) AS token FROM documents) JOIN stems USING (token) GROUP BY token, stem")
def stem_tokens(spark, sf):
    """Every word of the documents with its stem and how often it occurs."""
    each = table(spark, sf, "documents").select(F.explode(words(c("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("occurrences"))
    held = each.groupBy(F.pmod(F.hash("token"), F.lit(64)).alias("part")).agg(F.collect_list(F.struct("token", "occurrences")).alias("rows"))
    zipped = held.select(F.explode(F.arrays_zip(c("rows.token").alias("token"), c("rows.occurrences").alias("occurrences"), stems(c("rows.token")).alias("stem"))).alias("r"))
    return zipped.select("r.token", "r.stem", "r.occurrences")


#: Later versions of documents: which owners each names, and their new text; without one they are removed.
_VERSIONS = {
    1: ("doc_id % 3 = 0", "concat(text, ' ', source)"),
    2: ("doc_id % 5 < 2", "concat(lang, ' ', source, ' ', text)"),
    3: ("doc_id % 7 = 4", None),
}


def _paragraphs(docs, version, text):
    cut = docs.select("doc_id", F.posexplode(F.split(F.expr(text), "\n")).alias("place", "part"))
    return cut.select(c("doc_id").alias("owner"), (F.lit(version * 10_000_000_000) + c("doc_id") * 1000 + c("place")).alias("chunk"), "part")


def _replaced(spark, sf, once=False):
    """The index after three replacements, each of which names owners and brings their new chunks; chunks are counted ``once`` or when asked."""
    docs, fields = table(spark, sf, "documents"), {"text": "part"}
    index = postings.index_of(_paragraphs(docs.filter("doc_id % 11 <> 0"), 0, "text"), fields)
    index = postings.counted_once(index) if once else index
    for version, (owners, text) in _VERSIONS.items():
        named = docs.filter(owners)
        fresh = _paragraphs(named, version, text) if text else _paragraphs(docs.limit(0), version, "text")
        index = postings.replace_chunks(index, named.select(c("doc_id").alias("owner")), fresh, fields)
    return index


_CURRENT = f"""current AS (SELECT doc_id, CASE WHEN doc_id % 7 = 4 THEN NULL WHEN doc_id % 5 < 2 THEN concat(lang, ' ', source, ' ', text) WHEN doc_id % 3 = 0 THEN concat(text, ' ', source) WHEN doc_id % 11 <> 0 THEN text END AS body,
  CASE WHEN doc_id % 5 < 2 THEN 2 WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS version FROM documents),
  parts AS (SELECT doc_id AS owner, version * 10000000000 + doc_id * 1000 + generate_subscripts(p, 1) - 1 AS chunk, unnest(p) AS part FROM (SELECT doc_id, version, string_split(body, chr(10)) AS p FROM current WHERE body IS NOT NULL))"""
_INDEX = f"""WITH {_CURRENT}, {stem_sql.stems({'parts': 'part'})},
  held AS (SELECT owner, chunk, stem AS token FROM (SELECT owner, chunk, unnest({stem_sql.words('part')}) AS token FROM parts) JOIN stems USING (token))"""


@query("replace_chunks", f"""{_INDEX} SELECT token, count(DISTINCT chunk) AS df, count(*) AS occurrences, (SELECT count(*) FROM parts) AS chunks, (SELECT cast(sum(len({stem_sql.words('part')})) AS BIGINT) FROM parts) AS words FROM held GROUP BY token""")
def replace_chunks(spark, sf):
    """Terms, postings and totals after replacements; the SQL builds the last state anew."""
    index = _replaced(spark, sf, once=True)
    counted = index.postings.groupBy("token").agg(F.sum("f").cast("long").alias("occurrences"))
    return index.terms.join(counted, "token").join(F.broadcast(index.totals)).select("token", "df", "occurrences", "chunks", "words")


@query("search_index", f"""{_INDEX}, lens AS (SELECT chunk, len({stem_sql.words('part')}) AS len FROM parts), st AS (SELECT count(*) AS n, avg(len) AS a FROM lens), tf AS (SELECT chunk, token, count(*)::DOUBLE AS f FROM held GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
  {stem_sql.stems({'benchmark': 'text'}, 'asked_stems')}, asked AS (SELECT DISTINCT query_id, stem AS token FROM (SELECT item_id AS query_id, unnest({stem_sql.words('text')}) AS token FROM benchmark) JOIN asked_stems USING (token)),
  scored AS (SELECT query_id, chunk, round(sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / a))), 9) AS score FROM asked JOIN df USING (token) JOIN tf USING (token) JOIN lens USING (chunk), st GROUP BY 1, 2)
  SELECT query_id, chunk, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk) AS rank FROM scored) WHERE rank <= 10""")
def search_index(spark, sf):
    """Each item's first ten paragraphs from the index after the replacements."""
    asked = table(spark, sf, "benchmark").select(c("item_id").alias("query_id"), "text")
    return postings.search_index(_replaced(spark, sf), asked, 10).select("query_id", "chunk", F.round("score", 5).alias("score"))
