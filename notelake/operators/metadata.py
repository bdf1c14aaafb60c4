"""Filters, lookups and replacement of metadata rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions import text as T

ARCHIVE = "90_Archive"


def query_metadata(records: DataFrame, filters: DataFrame) -> DataFrame:
    """Records of each filter: AND across fields, any-of within a field, an empty list matches all.

    ``filters(query_id, types, owners, tags)`` holds arrays. Each filter is joined by the first field
    it names: type, owner or tag. A filter that names nothing returns every record, so its result has
    that size however it is made.
    """
    ok = (F.size("owners") == 0) | F.array_contains("owners", F.col("workspace"))
    ok = F.coalesce(ok, F.lit(False)) & ((F.size("tags") == 0) | F.array_contains("tags", F.col("tag")))
    typed = filters.filter(F.size("types") > 0).withColumn("type", F.explode(F.array_distinct("types")))
    by_type = records.join(typed, "type").filter(ok).select("query_id", "concept_id", "path")
    untyped = filters.filter(F.size("types") == 0)
    by_owner = untyped.filter(F.size("owners") > 0).withColumn("workspace", F.explode(F.array_distinct("owners")))
    owned = records.join(by_owner, "workspace").filter((F.size("tags") == 0) | F.array_contains("tags", F.col("tag")))
    by_tag = untyped.filter((F.size("owners") == 0) & (F.size("tags") > 0)).withColumn("tag", F.explode(F.array_distinct("tags")))
    tagged = records.join(by_tag, "tag")
    open_ = untyped.filter((F.size("owners") == 0) & (F.size("tags") == 0)).select("query_id", F.lit(1).alias("any"))
    whole = records.withColumn("any", F.lit(1)).join(F.broadcast(open_), "any")
    named = [x.select("query_id", "concept_id", "path") for x in (owned, tagged, whole)]
    return by_type.unionByName(named[0]).unionByName(named[1]).unionByName(named[2])


def exclude_archive(records: DataFrame, path: str = "path") -> DataFrame:
    """By location, not by type."""
    return records.filter(~F.startswith(F.col(path), F.lit(f"{ARCHIVE}/")))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key is not replaced, and all new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def vocabulary(records: DataFrame, column: str) -> DataFrame:
    """Distinct values with their use counts."""
    return records.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("uses"))


def scope_reduce(records: DataFrame, scopes: DataFrame, deep: bool, knowledge: tuple[str, ...] = ("knowledge", "map")) -> DataFrame:
    """Records of each scope of ``scopes(scope_id, owner)``; deep adds knowledge without an owner."""
    live = exclude_archive(records)
    own = live.join(scopes, live["workspace"] == scopes["owner"]).select("scope_id", "concept_id")
    if not deep:
        return own.distinct()
    free = live.filter(F.col("workspace").isNull() & F.col("type").isin(*knowledge)).select("concept_id")
    ids = scopes.select("scope_id").distinct()
    # Every scope gets the shared knowledge: the result itself has that many rows.
    return own.unionByName(ids.withColumn("k", F.lit(1)).join(free.withColumn("k", F.lit(1)), "k").select("scope_id", "concept_id")).distinct()


def stale(records: DataFrame, now: str) -> DataFrame:
    return records.filter(T.is_stale(F.col("stale_after"), now))


def duplicate_ids(records: DataFrame, key: str = "concept_id", path: str = "path") -> DataFrame:
    """Identities claimed by more than one path, with the paths in order."""
    held = records.groupBy(key).agg(F.array_sort(F.collect_set(path)).alias("paths"))
    return held.filter(F.size("paths") > 1)


def near_duplicate_tags(records: DataFrame, tag: str = "tag") -> DataFrame:
    """Spellings of one normalised tag, where there is more than one."""
    spelled = records.select(T.normalize_tag(F.col(tag)).alias("norm"), tag).distinct()
    return spelled.groupBy("norm").agg(F.array_sort(F.collect_list(tag)).alias("spellings")).filter(F.size("spellings") > 1)


def duplicate_numbers(records: DataFrame) -> DataFrame:
    """Holders of a number that another document of the same folder and series has too."""
    folder = F.array_join(F.slice(T.segments(F.col("path")), 1, F.size(T.segments(F.col("path"))) - 1), "/")
    numbered = records.select("concept_id", folder.alias("folder"), T.decision_series(F.col("path")).alias("series"), T.decision_number(F.col("path")).alias("number"))
    shared = Window.partitionBy("folder", "series", "number")
    return numbered.withColumn("holders", F.count("*").over(shared)).filter(F.col("series").isNotNull() & (F.col("holders") > 1))


def next_number(records: DataFrame) -> DataFrame:
    """Highest number plus one for each folder and series."""
    folder = F.array_join(F.slice(T.segments(F.col("path")), 1, F.size(T.segments(F.col("path"))) - 1), "/")
    return (
        records.select(folder.alias("folder"), T.decision_series(F.col("path")).alias("series"), T.decision_number(F.col("path")).alias("number"))
        .filter("series is not null").groupBy("folder", "series").agg((F.max("number") + 1).alias("next"))
    )
