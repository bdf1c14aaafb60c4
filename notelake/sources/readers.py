"""Scans of Markdown trees and of saved tracker pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _relative(root: str) -> Column:
    """Path below the root."""
    plain = F.regexp_replace("path", "^file:/+", "/")
    return F.substring(plain, len(root.rstrip("/").removeprefix("file://")) + 2, 1_000_000)


def _eligible(path: Column) -> Column:
    return ~F.exists(F.split(path, "/"), lambda s: F.startswith(s, F.lit(".")))


def _files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(root)


def scan_stats(spark: SparkSession, root: str) -> DataFrame:
    """``(path, size, modified_at)`` of every eligible note; contents are not read."""
    found = _files(spark, root).select(_relative(root).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))
    return found.filter(_eligible(F.col("path")))


def scan_markdown(spark: SparkSession, root: str) -> DataFrame:
    """``(path, frontmatter, body)`` of every eligible note; dot directories are left out."""
    found = _files(spark, root).select(_relative(root).alias("path"), F.decode("content", "UTF-8").alias("text")).filter(_eligible(F.col("path")))
    text = F.regexp_replace("text", "\r\n", "\n")
    block = r"(?s)\A---[ \t]*\n(.*?\n)?---[ \t]*(\n|\z)"
    has = text.rlike(block)
    return found.select("path", F.when(has, F.regexp_extract(text, block, 1)).alias("frontmatter"), F.when(has, F.regexp_replace(text, block, "")).otherwise(F.col("text")).alias("body"))


def field(name: str) -> Column:
    """A scalar front matter field as text; never retyped."""
    found = F.regexp_extract("frontmatter", rf"(?m)^{name}:[ \t]*[\"']?([^\n\"']*?)[\"']?[ \t]*$", 1)
    return F.when(found != "", found)


def store_problems(notes: DataFrame) -> DataFrame:
    """``(path, problem)``: unterminated front matter, missing and malformed identities."""
    uuid = "^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    problem = (
        F.when(F.col("frontmatter").isNull() & F.startswith("body", F.lit("---\n")), "unterminated_frontmatter")
        .when(F.col("frontmatter").isNotNull() & field("id").isNull(), "missing_id")
        .when(~field("id").rlike(uuid), "invalid_id")
    )
    return notes.select("path", problem.alias("problem")).filter("problem is not null")


def scan_untracked(notes: DataFrame) -> DataFrame:
    return notes.filter("frontmatter is null")


def load_work_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Items of saved collection pages, one row per id; the latest page wins."""
    pages = spark.read.schema(f"offset int, total int, _embedded struct<elements: array<{schema}>>").option("multiLine", True).json(path)
    each = pages.select("offset", F.explode("_embedded.elements").alias("e")).select("offset", "e.*")
    return each.groupBy("id").agg(F.max_by(F.struct(*[c for c in each.columns if c not in ("id", "offset")]), "offset").alias("x")).select("id", "x.*")


def work_relations(relations: DataFrame) -> DataFrame:
    """``(item, kind, other)`` from both ends of ``(from_id, to_id, type, reverse_type)``, one row each."""
    out = relations.select(F.col("from_id").alias("item"), F.col("type").alias("kind"), F.col("to_id").alias("other"))
    back = relations.select(F.col("to_id").alias("item"), F.col("reverse_type").alias("kind"), F.col("from_id").alias("other"))
    return out.unionByName(back).distinct()
