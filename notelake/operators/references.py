"""Paths that files name, what became of recorded material, and the passages of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions.text import excerpt, resolve_path
from notelake.operators.sizes import broadcast_if_small
from notelake.sources.shared import saved

#: Endings that make a link target a file, and characters that make it a pattern.
SUFFIXES = (".md", ".py", ".toml", ".yml", ".yaml", ".json", ".sh", ".cfg", ".ini")
_TARGET, _PATTERN = r"\]\(([^)\s]+)\)", r"[*?\[\]<>]"
#: Characters of a passage.
PASSAGE = 320


def path_references(text: Column) -> Column:
    """The distinct link targets of a Markdown text that are paths of files: with a slash and a known ending, no address and no pattern."""
    ending = "(" + "|".join(s.replace(".", r"\.") for s in SUFFIXES) + ")$"
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TARGET), 1))
    return F.filter(found, lambda x: F.contains(x, F.lit("/")) & ~F.contains(x, F.lit("://")) & ~F.startswith(x, F.lit("#")) & x.rlike(ending) & ~x.rlike(_PATTERN))


def broken_references(files: DataFrame, listing: DataFrame) -> DataFrame:
    """``(owner, file, reference)`` for what ``files(owner, file, text, roots)`` name and no root holds.

    ``roots`` is a list of folders in the order in which they are tried, most likely first; ``listing(root,
    path)`` holds the files below each. A reference is joined with the listing for one root at a time, and
    only what that root does not hold goes on to the next, so most references meet the listing once.
    References that leave a root by ``..`` are not below it. A null root is passed over.
    """
    each = files.select("owner", "file", "roots", F.explode(path_references(F.col("text"))).alias("reference"))
    held = listing.select("root", "path").distinct()
    most = each.agg(F.max(F.size("roots")).alias("n")).first()["n"] or 0
    for i in range(most):
        below = each.withColumn("root", F.get("roots", F.lit(i))).withColumn("path", resolve_path(F.lit("x"), F.col("reference")))
        each = below.join(held, ["root", "path"], "left_anti").select("owner", "file", "roots", "reference")
    return each.select("owner", "file", "reference")


def provenance_drift(records: DataFrame, recorded_files: DataFrame, files: DataFrame) -> DataFrame:
    """``(subject, state, drift, changed)``: what became of material whose origin is recorded.

    ``records(subject, tree_digest, upstream)``: upstream is current, ahead or unknown. ``recorded_files`` and
    ``files`` hold ``(subject, path, digest)`` as recorded and as they are. States: missing (material without
    record), incomplete (a record without digest: nothing can be said), orphaned (a record without
    material), recorded. Drift of the last: none, local, upstream, both. ``changed`` lists the files that
    were added, removed or altered here. Digests are compared file by file, so no tree is gathered.
    """
    old, new = recorded_files.select("subject", "path", F.col("digest").alias("was")), files.select("subject", "path", F.col("digest").alias("now"))
    moved = old.join(new, ["subject", "path"], "full_outer").filter(~F.col("was").eqNullSafe(F.col("now")))
    changed = moved.groupBy("subject").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    present = files.select("subject").distinct().withColumn("present", F.lit(True))
    known = records.filter("subject is not null").join(present, "subject", "full_outer").withColumn("recorded", F.col("upstream").isNotNull())
    judged = known.join(changed, "subject", "left")
    state = F.when(~F.col("recorded"), "missing").when(F.col("present").isNull(), "orphaned").when(F.col("tree_digest").isNull(), "incomplete").otherwise("recorded")
    local, ahead = F.col("paths").isNotNull(), F.col("upstream") == "ahead"
    drift = F.when(local & ahead, "both").when(local, "local").when(ahead, "upstream").otherwise("none")
    judged = judged.withColumn("state", state)
    whole = F.col("state") == "recorded"
    return judged.select("subject", "state", F.when(whole, drift).alias("drift"), F.when(whole, F.coalesce("paths", F.array().cast("array<string>"))).alias("changed"))


def hit_passages(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """``hits(query_id, owner, chunk_key, ...)`` with ``passage``, ``start_line``, ``end_line`` and ``moved``.

    ``chunks(owner, ordinal, chunk_key, text, start_line, end_line)`` are the chunks as they are now. A key
    that is still there is the passage; one that is not means the document changed since it was indexed:
    the opening chunk is shown and ``moved`` says so. Without chunks there is no passage; a hit
    without a key points at none and did not move.
    """
    # Only the hits' documents are cut and gathered: the owners go to the chunks, not the texts to the hits.
    hits = saved(hits, "hits")
    chunks = chunks.join(broadcast_if_small(hits.select("owner").distinct()), "owner", "left_semi")
    # One row an owner and key, and one for each opening: neither join can multiply the hits.
    now = chunks.groupBy("owner", "chunk_key").agg(F.min_by(F.struct("text", "start_line", "end_line"), "ordinal").alias("here"))
    opening = chunks.groupBy("owner").agg(F.min_by(F.struct("text", "start_line", "end_line"), "ordinal").alias("opening"))
    met = hits.join(now, ["owner", "chunk_key"], "left").join(opening, "owner", "left")
    shown = F.when(F.col("chunk_key").isNotNull(), F.coalesce("here", "opening"))
    made = met.withColumn("shown", shown)
    return made.select(
        *hits.columns,
        F.coalesce(excerpt(F.col("shown.text"), PASSAGE), F.lit("")).alias("passage"),
        F.col("shown.start_line").alias("start_line"),
        F.col("shown.end_line").alias("end_line"),
        (F.col("chunk_key").isNotNull() & F.col("here").isNull()).alias("moved"),
    )
