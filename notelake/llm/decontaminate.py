"""Benchmark decontamination with DataFrame functions only.

Short test items are searched inside documents of any length. An item with q distinct shingles is
contained when at least ``percent`` of them occur in the document, so of its
k = q - ceil(q * percent / 100) + 1 smallest shingle hashes (its bottom-k MinHash) at least one
occurs there. Items are partitioned by size, in powers of two: each partition has one bound, the
largest k-th hash of its items, and a document is sketched once per partition as its hashes up to
that bound. Matching sketch coordinates give candidate pairs with no miss, whatever the length of
the document; candidates are verified by exact containment of the shingles' words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.llm.common import Scratch, small

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACE = " \t\n\x0b\f\r"


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; null and texts of separators have none."""
    body = F.btrim(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), F.lit(_SPACE))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, "[\\x20\\x09-\\x0D]+"))


def _runs(words: str, n: int, make) -> Column:
    """``make(position, length)`` for each run of n words, or for the whole sequence if it is shorter."""
    size = F.size(words)
    last = F.greatest(size - n, F.lit(0))
    return F.when(size == 0, F.array()).otherwise(F.transform(F.sequence(F.lit(0), last), make))


def shingle_hashes(words: str, hashes: str, n: int) -> Column:
    """Hashes of the shingles of ``words``; ``hashes`` holds the words' own hashes."""
    whole = F.array(F.xxhash64(hashes))
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(n)]))
    return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).when(F.size(words) < n, whole).otherwise(runs)


def shingle_texts(words: str, n: int) -> Column:
    """The distinct shingles of ``words`` as texts."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def _hashed(df: DataFrame, n: int) -> DataFrame:
    df = df.withColumn("words", word_array(F.col("text")))
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    return df.withColumn("shingles", shingle_hashes("words", "hashes", n))


def contained_items(
    docs: DataFrame, items: DataFrame, ngram: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """One row per document and test item it contains: ids, ``n_shared`` and ``n_shingles``.

    ``n_shingles`` counts the item's distinct ``ngram``-word shingles (an item of fewer words is one
    shingle), ``n_shared`` those that occur in the document; pairs with
    100 * n_shared >= percent * n_shingles are returned. Null and empty texts contain nothing and are
    contained nowhere; null ids are left out; rows that share an id count as one document or item.
    Other columns are ignored. Empty tables give an empty result.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).filter("doc is not null")
    asked = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).filter("item is not null")

    own = Window.partitionBy("item")
    hashes = _hashed(asked, ngram).select("item", F.explode("shingles").alias("hash")).distinct()
    sized = hashes.select("item", "hash", F.count("*").over(own).alias("q"), F.row_number().over(own.orderBy("hash")).alias("place"))
    keep = F.col("q") - F.ceil(F.col("q") * percent / 100) + 1
    sketch = scratch.save(sized.filter(F.col("place") <= keep).select("item", "hash", "q", F.floor(F.log2("q")).cast("int").alias("size_class")))
    bounds = {r["size_class"]: r["bound"] for r in sketch.groupBy("size_class").agg(F.max("hash").alias("bound")).collect()}

    def upto(size_class: int, bound: int) -> Column:
        return F.transform(F.filter("shingles", lambda h: h <= bound), lambda h: F.struct(F.lit(size_class).alias("size_class"), h.alias("hash")))

    coordinates = F.concat(*(upto(k, b) for k, b in sorted(bounds.items()))) if bounds else upto(0, -(1 << 63))
    sketched = _hashed(rows, ngram).select("doc", F.size("shingles").alias("n"), F.explode(coordinates).alias("x")).select("doc", "n", "x.*")
    fits = F.col("n") * 100 >= F.col("q") * percent if percent else F.lit(True)
    met = sketched.join(small(sketch), ["size_class", "hash"]).filter(fits).select("doc", "item").distinct()
    pairs = scratch.save(met)

    texts = asked.withColumn("words", word_array(F.col("text"))).select("item", F.explode(shingle_texts("words", ngram)).alias("shingle")).distinct()
    texts = scratch.save(texts.withColumn("n_shingles", F.count("*").over(own)))
    wanted = scratch.save(pairs.select("doc").distinct())
    found = rows.join(small(wanted), "doc").withColumn("words", word_array(F.col("text")))
    found = found.select("doc", F.explode(shingle_texts("words", ngram)).alias("shingle"))
    shared = (
        found.join(small(texts), "shingle")
        .join(pairs, ["doc", "item"], "left_semi")
        .distinct()
        .groupBy("doc", "item", "n_shingles")
        .agg(F.count("*").alias("n_shared"))
    )
    return shared.filter(100 * F.col("n_shared") >= percent * F.col("n_shingles")).select(
        F.col("doc").alias(id_col), F.col("item").alias(item_col), "n_shared", "n_shingles"
    )


def decontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that contain no test item, with all their columns; rows with a null id stay."""
    id_col = options.get("id_col", "doc_id")
    hit = contained_items(docs, items, **options).select(id_col).distinct()
    return docs.join(hit, id_col, "left_anti").select(docs.columns)


#: The same in SQL: distinct shingles of both sides, counted where equal.
CONTAINED_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents WHERE doc_id IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM d WHERE len(w) > 0),
its AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM i WHERE len(w) > 0),
sized AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n_shingles FROM its)
SELECT doc_id, item_id, count(*) AS n_shared, n_shingles FROM ds JOIN sized USING (s)
GROUP BY doc_id, item_id, n_shingles HAVING 100 * count(*) >= 80 * n_shingles
"""
