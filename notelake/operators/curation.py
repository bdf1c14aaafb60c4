"""Curation of a corpus: hazards in texts, changed paths, open findings, ratified cases, comparable runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Invisible characters by family.
INVISIBLE = {
    "zero_width": r"[\u200B\u200C\u200D\u2060\uFEFF]",
    "bidi_override": r"[\u202A-\u202E\u2066-\u2069]",
    "variation_selector": r"[\uFE00-\uFE0F\x{E0100}-\x{E01EF}]",
    "tag_character": r"[\x{E0000}-\x{E007F}]",
    "invisible_operator": r"[\u2061-\u2064]",
    "format_control": r"\u180E",
    "hangul_filler": r"[\u115F\u1160\u3164]",
}
#: Home directories, and user names that stand for nobody.
HOMES = {
    "personal_path_posix": r"/home/([A-Za-z][A-Za-z0-9._-]*)",
    "personal_path_macos": r"/Users/([A-Za-z][A-Za-z0-9._-]*)",
    "personal_path_windows": r"[Cc]:\\Users\\([A-Za-z][A-Za-z0-9._-]*)",
}
PLACEHOLDERS = ("user", "username", "youruser", "yourusername", "your-username", "example", "me", "you", "name")
#: Directories and names of files whose changes say nothing about notes.
IGNORED = (".git", ".obsidian", ".trash", ".stfolder")
TEMPORARY = r"^(\.#|~)|(\.swp|\.swx|~|\.tmp)$"
_LINES = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def _placed(line: Column, pattern: str) -> Column:
    """Matches of the pattern in the line with the columns they start at, from 1."""
    start = F.struct(F.array().cast("array<struct<match:string,at:int>>").alias("found"), F.lit(1).alias("next"))

    def step(state: Column, match: Column) -> Column:
        at = F.call_function("locate", match, line, state["next"])
        return F.struct(F.concat(state["found"], F.array(F.struct(match.alias("match"), at.alias("at")))).alias("found"), (at + F.length(match)).alias("next"))

    return F.aggregate(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)), start, step)["found"]


def text_hazards(texts: DataFrame, id_col: str, text_col: str, forbidden: tuple[str, ...] = ()) -> DataFrame:
    """``(id, kind, line, at)``: invisible characters, home paths of real users, forbidden literals.

    Lines and columns count from 1. A forbidden literal is told once a line. Null and empty texts hold none.
    """
    lines = texts.select(id_col, F.posexplode(F.split(text_col, _LINES)).alias("line", "content"))
    content = F.col("content")
    nothing = F.array().cast("array<struct<kind:string,at:int>>")

    def hits(kind: str, pattern: str) -> Column:
        user = lambda x: F.lower(F.regexp_extract(x["match"], pattern, 1))
        found = _placed(content, pattern)
        found = F.filter(found, lambda x: ~user(x).isin(*PLACEHOLDERS)) if kind in HOMES else found
        return F.when(content.rlike(pattern), F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["at"].alias("at")))).otherwise(nothing)

    kinds = [hits(kind, pattern) for kind, pattern in (INVISIBLE | HOMES).items()]
    for literal in forbidden:
        at = F.instr(content, literal)
        kinds.append(F.when(at > 0, F.array(F.struct(F.lit("forbidden_path").alias("kind"), at.alias("at")))).otherwise(nothing))
    hit = lines.select(id_col, (F.col("line") + 1).alias("line"), F.explode(F.concat(*kinds)).alias("h"))
    return hit.select(id_col, "h.kind", "line", "h.at")


def is_watched(path: Column, ignored: tuple[str, ...] = IGNORED) -> Column:
    """True for a relative path whose change can concern a note: Markdown, not temporary, not in an ignored directory."""
    name = F.element_at(F.split(path, "/"), -1)
    outside = F.startswith(path, F.lit("/")) | F.exists(F.split(path, "/"), lambda part: part == "..")
    return F.coalesce(~outside & ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, ignored))) & ~name.rlike(TEMPORARY) & F.endswith(name, F.lit(".md")), F.lit(False))


def filter_findings(ledger: DataFrame, severity: str | None = None) -> DataFrame:
    """Open findings, those of one severity if named, with ``place``: their order by time, then fingerprint, in each severity."""
    found = ledger.filter("resolved_at is null")
    found = found if severity is None else found.filter(F.col("severity") == severity)
    return found.withColumn("place", F.row_number().over(Window.partitionBy("severity").orderBy("detected_at", "fingerprint")))


def remove_metadata(records: DataFrame, gone: DataFrame) -> DataFrame:
    """The records of ``concept_id`` not in ``gone``."""
    return records.join(gone.select("concept_id").distinct(), "concept_id", "left_anti").select(records.columns)


def present_successors(ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """``(query_id, owner, successor)``: successors that the same query's list holds too."""
    over = edges.filter("relation_type = 'superseded_by'").select(F.col("source_id").alias("owner"), F.col("target_id").alias("successor")).distinct()
    held = ranked.select("query_id", F.col("owner").alias("successor"))
    return ranked.select("query_id", "owner").join(over, "owner").join(held, ["query_id", "successor"], "left_semi").select("query_id", "owner", "successor").distinct()


def rank_in_query(hits: DataFrame, *order: Column) -> DataFrame:
    """The hits with ``rank`` from 1 without gaps in each query."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def exact_identifier_lane(identifiers: DataFrame, texts: DataFrame, id_col: str = "concept_id", text_col: str = "body") -> DataFrame:
    """``(query_id, identifier, owner)``: texts that hold an identifier whole, case ignored.

    Whole means between characters that are neither letters, digits, underscores nor hyphens, so each
    text is cut there and its pieces are joined with the identifiers. Blank identifiers find nothing.
    """
    asked = identifiers.select("query_id", F.lower(F.trim("identifier")).alias("piece"), "identifier").filter("piece != ''").distinct()
    pieces = texts.select(F.col(id_col).alias("owner"), F.explode(F.array_distinct(F.split(F.lower(text_col), r"[^\p{L}\p{N}_-]+"))).alias("piece"))
    return pieces.join(asked, "piece").select("query_id", "identifier", "owner")


def expectation_stamp(task: Column, requires: Column, forbids: Column, deprioritises: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a case's expectations; the order within its lists does not matter."""
    lists = [F.to_json(F.array_sort(x)) for x in (deprioritises, forbids, requires)]
    return F.substring(F.sha2(F.concat_ws("\x1f", *lists, task), 256), 1, 16)


def ratified_cases(cases: DataFrame) -> DataFrame:
    """Cases whose ``stamp`` is that of their expectations as they are now."""
    return cases.filter(F.col("stamp") == expectation_stamp(F.col("task"), F.col("requires"), F.col("forbids"), F.col("deprioritises")))


def relation_edges(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and issues of ``notes(concept_id, relations array<struct<type, target>>)``.

    A relation needs a type, else ``invalid_relation``, and a target, else ``invalid_relation_target``.
    Types that nobody registered are kept as written.
    """
    each = notes.select("concept_id", F.explode("relations").alias("r")).select("concept_id", F.trim("r.type").alias("type"), F.trim("r.target").alias("target"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    code = F.when(blank("type"), "invalid_relation").when(blank("target"), "invalid_relation_target")
    judged = each.withColumn("code", code)
    edges = judged.filter("code is null").select(F.col("concept_id").alias("source_id"), F.col("type").alias("relation_type"), F.col("target").alias("target_id"))
    return edges, judged.filter("code is not null").select("concept_id", "code")


def rule_unregistered(notes: DataFrame, registered: DataFrame) -> DataFrame:
    """``(concept_id, field)``: front-matter fields that neither all types nor the note's type registers.

    ``notes(concept_id, type, fields array<string>)``; ``registered(type, field)``, a null type for all types.
    """
    each = notes.select("concept_id", "type", F.explode(F.array_distinct("fields")).alias("field"))
    common = registered.filter("type is null").select("field").distinct()
    own = registered.filter("type is not null").distinct()
    return each.join(common, "field", "left_anti").join(own, ["type", "field"], "left_anti").select("concept_id", "field")


def missing_manifest(notes: DataFrame, scope_col: str, manifest: str) -> DataFrame:
    """Scopes with notes none of which has the path ``scope/manifest``."""
    scopes = notes.filter(F.col(scope_col).isNotNull()).select(scope_col, F.concat_ws("/", scope_col, F.lit(manifest)).alias("path")).distinct()
    return scopes.join(notes.select("path").distinct(), "path", "left_anti").select(scope_col)


def compare_runs(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """``(delta, swing, distinguishable, comparable)`` of two runs ``(case_id, k, recall)``.

    Runs compare only if both have the same cases with the same ``k``; otherwise the first three are
    null. A difference counts if it exceeds what one case can account for, 1 / cases.
    """
    both = baseline.select("case_id", F.col("k").alias("k_a"), F.col("recall").alias("a"), F.lit(True).alias("in_a")).join(
        candidate.select("case_id", F.col("k").alias("k_b"), F.col("recall").alias("b"), F.lit(True).alias("in_b")), "case_id", "full_outer"
    )
    same = F.coalesce(F.col("in_a") & F.col("in_b") & (F.col("k_a") == F.col("k_b")), F.lit(False))
    made = both.agg(F.avg("b").alias("b"), F.avg("a").alias("a"), (1 / F.nullif(F.count("*"), F.lit(0))).alias("swing"), F.coalesce(F.bool_and(same), F.lit(False)).alias("comparable"))
    delta = F.round(F.col("b") - F.col("a"), 9)
    told = lambda c: F.when(F.col("comparable"), c)
    return made.select(told(delta).alias("delta"), told(F.round("swing", 9)).alias("swing"), told(F.abs(delta) > F.round("swing", 9)).alias("distinguishable"), "comparable")


def violations(ranked: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """``(query_id, kind, owner, rank)``: expectations ``(query_id, kind, owner)`` that a ranking broke.

    A ``required`` document is missing from the first ``k``, a ``forbidden`` one is among them, a
    ``deprioritised`` one stands anywhere before the last required one found among the first ``k``.
    ``rank`` is null for missing documents. Repeated expectations are told once.
    """
    met = expected.distinct().join(ranked.select("query_id", "owner", "rank"), ["query_id", "owner"], "left")
    found = F.coalesce(F.col("rank") <= k, F.lit(False))
    last = met.filter((F.col("kind") == "required") & found).groupBy("query_id").agg(F.max("rank").alias("last"))
    broken = (
        ((F.col("kind") == "required") & ~found)
        | ((F.col("kind") == "forbidden") & found)
        | ((F.col("kind") == "deprioritised") & F.coalesce(F.col("rank") < F.col("last"), F.lit(False)))
    )
    shown = F.when(F.col("kind") != "required", F.col("rank"))
    return met.join(last, "query_id", "left").filter(broken).select("query_id", "kind", "owner", shown.alias("rank"))


def declared_unchanged(declared: DataFrame, given: DataFrame, documents: DataFrame) -> DataFrame:
    """``(session, path)``: documents that a session declared changed and left as they were.

    ``declared(session, concept_id, started_at)``, ``given(session, concept_id, digest)``,
    ``documents(concept_id, path, digest, modified_at)``. A given document is unchanged while its digest
    is the one it was given with; any other while it was not modified after the session started.
    Documents that are gone or whose time is unknown are not held against the session.
    """
    held = declared.distinct().join(documents.withColumnRenamed("digest", "now"), "concept_id")
    judged = held.join(given.select("session", "concept_id", "digest"), ["session", "concept_id"], "left")
    same = F.when(F.col("digest").isNotNull(), F.col("now") == F.col("digest")).otherwise(F.col("modified_at") <= F.col("started_at"))
    return judged.filter(F.coalesce(same, F.lit(False))).select("session", "path").distinct()


#: The stage of each reason code.
STAGES = {
    "workspace_required": "scope",
    "parent_workspace": "scope",
    "metadata_filter": "metadata",
    "freshness": "metadata",
    "structural_location": "structure",
    "exact_identifier_match": "lexical",
    "fts_rank": "lexical",
    "foreign_material": "lexical",
    "relation_depth": "relation",
    "recent_activity": "external_state",
    "git_changed_file": "external_state",
    "work_item_current": "external_state",
    "external_memory_candidate": "external_state",
    "vector_rank": "semantic",
    "llm_rerank": "enrichment",
}


def reason_stage(code: Column, named: Column | None = None) -> Column:
    """The stage of a reason code; a code that is not known has the stage named with it, or null."""
    known = F.element_at(F.create_map(*(F.lit(x) for pair in STAGES.items() for x in pair)), code)
    return known if named is None else F.coalesce(known, named)
