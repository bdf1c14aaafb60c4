"""Further joins, windows, sessions and generated tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from notelake.functions import text as T
from notelake.operators import graph, retrieval, state
from notelake.operators.ranking import top_k
from notelake.plans.fixtures import edges, items, links, notes, table, with_items, with_links, with_notes
from notelake.plans.registry import query

c = F.col


@query("keywords", with_notes("SELECT concept_id, concat_ws(' ', lang, tag, lifecycle) AS keywords FROM notes"))
def keywords(spark, sf):
    return notes(spark, sf).select('concept_id', F.concat_ws(' ', 'lang', 'tag', 'lifecycle').alias('keywords'))


@query("listify", with_notes("SELECT concept_id, list_filter([trim(lang), trim(coalesce(lifecycle, '')), trim(concat(' ', tag))], lambda x: x <> '') AS tags FROM notes"))
def listify(spark, sf):
    return notes(spark, sf).select('concept_id', F.filter(F.transform(F.array('lang', F.coalesce('lifecycle', F.lit('')), F.concat(F.lit(' '), 'tag')), lambda x: F.trim(x)), lambda x: x != '').alias('tags'))


@query("scope_owner", with_notes("SELECT concept_id, coalesce(CASE WHEN regexp_full_match(workspace, 'src[0-9]+') THEN workspace END, CASE WHEN type = 'knowledge' THEN 'area' END) AS owner FROM notes"))
def scope_owner(spark, sf):
    return notes(spark, sf).select('concept_id', F.coalesce(F.when(c('workspace').rlike('^src[0-9]+$'), c('workspace')), F.when(c('type') == 'knowledge', 'area')).alias('owner'))


@query("merge_terms", "SELECT item_id, list_concat([lower(split_part(text, ' ', 1))], list_filter([lower(split_part(text, ' ', 2))], lambda w: w <> lower(split_part(text, ' ', 1)))) AS terms FROM benchmark")
def merge_terms(spark, sf):
    part = lambda i: F.lower(F.split_part(c('text'), F.lit(' '), F.lit(i)))
    return table(spark, sf, 'benchmark').select('item_id', T.merge_terms(F.array(part(1)), F.array(part(2), part(1))).alias('terms'))


@query("log_date", "SELECT event_id, cast(substring(cast(ts AS VARCHAR), 1, 10) AS DATE) AS day FROM events")
def log_date(spark, sf):
    return table(spark, sf, 'events').select('event_id', F.substring(c('ts').cast('string'), 1, 10).cast('date').alias('day'))


@query("coerce_field", "SELECT event_id, TRY_CAST(split_part(event_type || '-' || cast(event_id AS VARCHAR), '-', CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS value FROM events")
def coerce_field(spark, sf):
    return table(spark, sf, 'events').select('event_id', F.when(c('event_id') % 2 == 0, c('event_id').cast('string')).otherwise(c('event_type')).try_cast('bigint').alias('value'))


@query("path_references", with_links(r"SELECT page_id, href FROM links WHERE contains(href, '/') AND regexp_matches(href, '\.(html?|md|txt)$') AND NOT regexp_matches(href, '[*?]')"))
def path_references(spark, sf):
    return links(spark, sf).filter(F.contains('href', F.lit('/')) & c('href').rlike(r'\.(html?|md|txt)$') & ~c('href').rlike('[*?]')).select('page_id', 'href')


@query("document_names", with_notes("SELECT DISTINCT lower(tag) AS name, first_value(tag) OVER (PARTITION BY lower(tag) ORDER BY tag) AS spelling FROM notes"))
def document_names(spark, sf):
    return top_k(notes(spark, sf).select(F.lower('tag').alias('name'), c('tag').alias('spelling')), ['name'], ['spelling'], 1).select('name', 'spelling')


@query("lineage_edges", "SELECT n_name AS source_id, 'parent' AS relation_type, r_name AS target_id FROM nation JOIN region ON n_regionkey = r_regionkey")
def lineage_edges(spark, sf):
    return table(spark, sf, 'nation').join(table(spark, sf, 'region'), c('n_regionkey') == c('r_regionkey')).select(c('n_name').alias('source_id'), F.lit('parent').alias('relation_type'), c('r_name').alias('target_id'))


@query("fts_join_chunks", "SELECT d.doc_id, v.label FROM documents d JOIN embeddings v ON d.doc_id = v.vec_id")
def fts_join_chunks(spark, sf):
    return table(spark, sf, 'documents').select('doc_id').join(table(spark, sf, 'embeddings').select(c('vec_id').alias('doc_id'), 'label'), 'doc_id')


@query("folder_links", with_links("SELECT page_id, href FROM links WHERE ends_with(href, '/') AND href NOT IN (SELECT DISTINCT regexp_replace(url, '[^/]*$', '') FROM pages)"))
def folder_links(spark, sf):
    return links(spark, sf).filter(F.endswith('href', F.lit('/'))).join(table(spark, sf, 'pages').select(F.regexp_replace('url', '[^/]*$', '').alias('href')).distinct(), 'href', 'left_anti').select('page_id', 'href')


@query("dangling_cases", "SELECT item_id, wanted FROM (SELECT item_id, item_id * 100 AS wanted FROM benchmark UNION ALL SELECT item_id, item_id + 1 FROM benchmark) WHERE wanted NOT IN (SELECT doc_id FROM documents)")
def dangling_cases(spark, sf):
    b = table(spark, sf, 'benchmark')
    wanted = b.select('item_id', F.explode(F.array(c('item_id') * 100, c('item_id') + 1)).alias('wanted'))
    return wanted.join(table(spark, sf, 'documents').select(c('doc_id').alias('wanted')), 'wanted', 'left_anti').select('item_id', 'wanted')


@query("parent_mismatch", with_notes("SELECT concept_id, CASE WHEN workspace IS NULL THEN 'undeclared' WHEN p.source_id IS NULL THEN 'unlinked' WHEN p.target_id IS NULL THEN 'absent' ELSE 'linked' END AS state FROM notes n LEFT JOIN (SELECT source_id, min(t.concept_id) AS target_id FROM edges e LEFT JOIN notes t ON t.concept_id = e.target_id GROUP BY source_id) p ON p.source_id = n.concept_id"))
def parent_mismatch(spark, sf):
    held = notes(spark, sf).select(c('concept_id').alias('target_id'), c('concept_id').alias('found'))
    up = edges(spark, sf).join(held, 'target_id', 'left').groupBy('source_id').agg(F.min('found').alias('found'))
    state_of = F.when(c('workspace').isNull(), 'undeclared').when(c('source_id').isNull(), 'unlinked').when(c('found').isNull(), 'absent').otherwise('linked')
    return notes(spark, sf).join(up, c('concept_id') == c('source_id'), 'left').select('concept_id', state_of.alias('state'))


@query("prefer_explicit_scope", with_notes("SELECT concept_id, coalesce(workspace, CASE WHEN doc_id % 2 = 0 THEN source END, 'unmapped') AS scope FROM notes"))
def prefer_explicit_scope(spark, sf):
    return notes(spark, sf).select('concept_id', F.coalesce('workspace', F.when(c('doc_id') % 2 == 0, c('source')), F.lit('unmapped')).alias('scope'))


@query("lane_credit", "SELECT event_type AS lane, count(DISTINCT user_id) AS found FROM events GROUP BY event_type")
def lane_credit(spark, sf):
    return table(spark, sf, 'events').groupBy(c('event_type').alias('lane')).agg(F.countDistinct('user_id').alias('found'))


@query("declarations", "SELECT conv_id, list(role ORDER BY turn, role) AS roles FROM conversations GROUP BY conv_id")
def declarations(spark, sf):
    held = table(spark, sf, 'conversations').groupBy('conv_id').agg(F.array_sort(F.collect_list(F.struct('turn', 'role'))).alias('t'))
    return held.select('conv_id', F.transform('t', lambda x: x['role']).alias('roles'))


@query("index_counts", with_notes("SELECT count(CASE WHEN doc_id % 10 = 1 THEN 1 END) AS added, count(CASE WHEN doc_id % 10 = 2 THEN 1 END) AS missing, count(CASE WHEN doc_id % 10 NOT IN (1, 2) THEN 1 END) AS unchanged FROM notes"))
def index_counts(spark, sf):
    n = notes(spark, sf).select('doc_id', 'concept_id', 'path', F.md5('body').alias('content_hash'))
    change = state.diff_snapshots(n.filter('doc_id % 10 <> 1'), n.filter('doc_id % 10 <> 2'))
    return change.agg(F.count_if(c('change') == 'new').alias('added'), F.count_if(c('change') == 'missing').alias('missing'), F.count_if(c('change') == 'unchanged').alias('unchanged'))


@query("detect_moves", with_notes("SELECT concept_id FROM notes WHERE doc_id % 10 = 4"))
def detect_moves(spark, sf):
    n = notes(spark, sf).select('doc_id', 'concept_id', 'path', F.lit('h').alias('content_hash'))
    new = n.withColumn('path', F.when(c('doc_id') % 10 == 4, F.concat(F.lit('moved/'), 'path')).otherwise(c('path')))
    return state.diff_snapshots(n, new).filter("change = 'moved'").select('concept_id')


@query("forget_gone", with_notes("SELECT source_id, target_id FROM edges WHERE source_id NOT IN (SELECT concept_id FROM notes WHERE doc_id % 10 = 2)"))
def forget_gone(spark, sf):
    return edges(spark, sf).join(notes(spark, sf).filter('doc_id % 10 = 2').select(c('concept_id').alias('source_id')), 'source_id', 'left_anti').select('source_id', 'target_id')


@query("diff_findings", with_notes("SELECT concept_id AS fingerprint, CASE WHEN doc_id % 3 = 0 THEN 'resolved' WHEN doc_id % 3 = 1 THEN 'opened' ELSE 'open' END AS state FROM notes"))
def diff_findings(spark, sf):
    n = notes(spark, sf).select('doc_id', c('concept_id').alias('fingerprint'))
    old, new = n.filter('doc_id % 3 <> 1').withColumn('o', F.lit(1)), n.filter('doc_id % 3 <> 0').withColumn('n', F.lit(1))
    both = old.select('fingerprint', 'o').join(new.select('fingerprint', 'n'), 'fingerprint', 'full_outer')
    return both.select('fingerprint', F.when(c('n').isNull(), 'resolved').when(c('o').isNull(), 'opened').otherwise('open').alias('state'))


@query("best_rank_per_lane", "SELECT conv_id AS query_id, role AS owner, 'turns' AS retriever, min(turn) AS rank FROM conversations GROUP BY conv_id, role")
def best_rank_per_lane(spark, sf):
    return retrieval.best_rank_per_lane(table(spark, sf, 'conversations').select(c('conv_id').alias('query_id'), c('role').alias('owner'), F.lit('turns').alias('retriever'), c('turn').alias('rank')))


@query("first_passage", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS n FROM conversations) WHERE n = 1")
def first_passage(spark, sf):
    return top_k(table(spark, sf, 'conversations'), ['conv_id'], [F.length('text').desc(), 'turn'], 1).select('conv_id', 'turn')


@query("corroborates", with_notes("SELECT source_id, target_id FROM edges WHERE relation_type NOT IN ('links_to', 'parent', 'superseded_by', 'closes')"))
def corroborates(spark, sf):
    return edges(spark, sf).filter(~c('relation_type').isin(*graph.NEVER_CORROBORATE)).select('source_id', 'target_id')


@query("applicable_standards", with_notes("SELECT s.scope_id, n.concept_id FROM (SELECT DISTINCT source AS scope_id FROM notes) s JOIN notes n ON n.type = 'standard' AND n.workspace = s.scope_id"))
def applicable_standards(spark, sf):
    scopes = notes(spark, sf).select(c('source').alias('scope_id')).distinct()
    return notes(spark, sf).filter("type = 'standard'").join(scopes, c('workspace') == c('scope_id')).select('scope_id', 'concept_id')


@query("work_signals", with_items("SELECT project, count(*) AS total, count(CASE WHEN status = 'O' THEN 1 END) AS open_items, max(updated_at) AS latest FROM items GROUP BY project"))
def work_signals(spark, sf):
    return items(spark, sf).groupBy('project').agg(F.count('*').alias('total'), F.count_if(c('status') == 'O').alias('open_items'), F.max('updated_at').alias('latest'))


@query("session_signals", "SELECT conv_id, max(turn) AS last_turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn > 4) GROUP BY conv_id")
def session_signals(spark, sf):
    t = table(spark, sf, 'conversations')
    return t.join(t.filter('turn > 4').select('conv_id'), 'conv_id', 'left_anti').groupBy('conv_id').agg(F.max('turn').alias('last_turn'))


@query("cache_prune", with_items("SELECT external_id FROM items WHERE NOT (project IN (SELECT project FROM items WHERE priority = '1-URGENT') AND status = 'F')"))
def cache_prune(spark, sf):
    complete = items(spark, sf).filter("priority = '1-URGENT'").select('project').distinct()
    gone = items(spark, sf).filter("status = 'F'").join(complete, 'project', 'left_semi').select('external_id')
    return items(spark, sf).select('external_id').join(gone, 'external_id', 'left_anti')


@query("cache_fresh", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 15 MINUTE")
def cache_fresh(spark, sf):
    e = table(spark, sf, 'events')
    newest = e.agg(F.max('ts').alias('newest'))
    return e.join(F.broadcast(newest), c('ts') >= c('newest') - F.expr('interval 15 minutes')).select('event_id')


@query("nav_entries", with_notes("SELECT regexp_replace(path, '/[^/]*$', '') AS directory, list(concept_id ORDER BY path, concept_id) AS documents FROM notes GROUP BY 1"))
def nav_entries(spark, sf):
    held = notes(spark, sf).groupBy(F.regexp_replace('path', '/[^/]*$', '').alias('directory')).agg(F.array_sort(F.collect_list(F.struct('path', 'concept_id'))).alias('d'))
    return held.select('directory', F.transform('d', lambda x: x['concept_id']).alias('documents'))


@query("nav_block", with_notes("SELECT regexp_replace(path, '/[^/]*$', '') AS directory, string_agg('- [' || lang || '](' || list_extract(string_split(path, '/'), -1) || ')', chr(10) ORDER BY path, concept_id) AS block FROM notes GROUP BY 1"))
def nav_block(spark, sf):
    line = F.concat(F.lit('- ['), 'lang', F.lit(']('), F.element_at(T.segments(c('path')), -1), F.lit(')')).alias('x')
    held = notes(spark, sf).groupBy(F.regexp_replace('path', '/[^/]*$', '').alias('directory')).agg(F.array_sort(F.collect_list(F.struct('path', 'concept_id', line))).alias('d'))
    return held.select('directory', F.array_join(F.transform('d', lambda x: x['x']), '\n').alias('block'))


@query("nav_missing", with_notes("SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS directory FROM notes WHERE regexp_replace(path, '/[^/]*$', '') NOT IN (SELECT regexp_replace(path, '/[^/]*$', '') FROM notes WHERE doc_id % 20 = 0)"))
def nav_missing(spark, sf):
    home = F.regexp_replace('path', '/[^/]*$', '').alias('directory')
    return notes(spark, sf).select(home).distinct().join(notes(spark, sf).filter('doc_id % 20 = 0').select(home), 'directory', 'left_anti')


@query("resurfaces", with_notes("SELECT concept_id, CASE WHEN type IN ('context', 'standard') THEN true WHEN type = 'decision' THEN coalesce(lifecycle <> 'rejected', true) ELSE workspace IS NOT NULL END AS surfaces FROM notes"))
def resurfaces(spark, sf):
    return notes(spark, sf).select('concept_id', F.when(c('type').isin('context', 'standard'), True).when(c('type') == 'decision', F.coalesce(c('lifecycle') != 'rejected', F.lit(True))).otherwise(c('workspace').isNotNull()).alias('surfaces'))


@query("normalize_work_relations", "SELECT DISTINCT * FROM (SELECT l_partkey AS item, 'supplied_by' AS kind, l_suppkey AS other FROM lineitem UNION ALL SELECT l_suppkey, 'supplies', l_partkey FROM lineitem)")
def normalize_work_relations(spark, sf):
    from notelake.sources.readers import work_relations

    pairs = table(spark, sf, 'lineitem').select(c('l_partkey').alias('from_id'), c('l_suppkey').alias('to_id'), F.lit('supplied_by').alias('type'), F.lit('supplies').alias('reverse_type'))
    return work_relations(pairs)


@query("coalesce_changes", """WITH e AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 10 SECOND THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (ORDER BY ts, event_id) AS prev FROM events))
    SELECT min(ts) AS "start", list_sort(list(DISTINCT event_type)) AS paths FROM e GROUP BY s""")
def coalesce_changes(spark, sf):
    return state.coalesce_changes(table(spark, sf, 'events'), 'event_type', '10 seconds').select('start', 'paths')
