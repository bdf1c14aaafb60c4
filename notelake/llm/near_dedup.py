"""MinHash near-duplicates by a join of signature coordinates.

Every text becomes the set of its distinct word shingles and a signature of ``COORDINATES``
coordinates, each the hash of ``MINIMA`` independent minima, so sets of similarity s agree on one with
probability s ** MINIMA. Documents are posted under each (coordinate, value) pair. At similarity 0.8 a
pair agrees on 13 of 32 coordinates on average, and on fewer than ``MATCHES`` in one case of 11,000.
A pair with that many common postings shares one among any ``COORDINATES - MATCHES + 1`` postings of
either side: the rarest ones are kept (prefix). Where two documents meet in a list, sizes that cannot
reach the threshold are skipped, and the collisions of all single minima are counted on one bit of
each: pairs that agree on fewer than ``LEAST_BITS`` of ``BITS`` are dropped inside the join. The pairs
above that match threshold are confirmed on the full sets.

Equal sets are one node from the start, and no list emits all its pairs: see ``lists.clusters``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelake.llm.common import Scratch, small, width
from notelake.llm.lists import clusters
from notelake.llm.textbytes import mix, shingle_set

COORDINATES, MINIMA = 32, 4
MATCHES = 4
BITS = COORDINATES * MINIMA
#: At similarity 0.8 a bit agrees with probability 0.9; four standard deviations below the mean.
LEAST_BITS = 101
_FACTORS = np.random.default_rng(20240607).integers(0, 1 << 31, BITS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLACES = np.arange(1, COORDINATES + 1, dtype=np.uint64)


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The coordinates of a set as signed 64-bit values, each telling its coordinate too, and its bits."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(BITS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(short), 1024):
        np.minimum(least, (short[at : at + 1024, None] * _FACTORS).min(axis=0), out=least)
    made = _PLACES
    for part in least.reshape(MINIMA, COORDINATES).astype(np.uint64):
        made = mix(made + part)
    bits = np.packbits((least * np.uint32(0x9E3779B1)) >> np.uint32(31))
    return made.view(np.int64), bits.view(np.int64)


def set_key(shingles: np.ndarray) -> int:
    """Name of a set: equal sets have equal names."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "big", signed=True)


def _features(ngram: int):
    def run(batches):
        for batch in batches:
            counts, keys, rows, bits = [], [], [], []
            for text in batch.column(2).to_pylist():
                shingles = shingle_set(text or b"", ngram)
                counts.append(len(shingles))
                keys.append(set_key(shingles) if len(shingles) else None)
                made, own = signature(shingles) if len(shingles) else (np.zeros(0, np.int64), np.zeros(2, np.int64))
                rows.append(made)
                bits.append(own)
            offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            values = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            both = np.array(bits, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(keys, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(values)), pa.array(both[:, 0]), pa.array(both[:, 1])],
                names=["id", "h", "n", "key", "sig", "s1", "s2"],
            )

    return run


#: Texts that a block of the confirming step holds, about; a task holds the sets of two blocks.
BLOCK = 2000


def _linked(ngram: int, percent: int):
    """The pairs whose full sets reach the threshold; the texts of a cell come before its pairs."""

    def run(batches):
        cell, sets = None, {}
        for batch in batches:
            linked, texts = [], batch.column("text")
            for at, (i, j, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in "ijab"), strict=True)):
                if cell != (i, j):
                    cell, sets = (i, j), {}
                if b is None:
                    sets[a] = shingle_set(texts[at].as_py(), ngram)
                    continue
                mine, other = sets[a], sets[b]
                common = len(np.intersect1d(mine, other, assume_unique=True))
                if 100 * common >= percent * (len(mine) + len(other) - common):
                    linked.append((a, b))
            made = np.array(linked, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], names=["src", "dst"])

    return run


def _cells(pairs: DataFrame, texts: DataFrame, blocks: int, scratch: Scratch) -> DataFrame:
    """Rows ``(i, j, a, b, text)``: each pair in the cell of its two blocks, behind the texts that the cell's pairs need.

    A text comes once a cell and not once a pair, so a group of n near copies costs n * blocks texts.
    """
    block = lambda key: F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    dealt = scratch.save(pairs.select(block("a").alias("i"), block("b").alias("j"), "a", "b"))
    needed = dealt.select("i", "j", F.col("a").alias("key")).union(dealt.select("i", "j", "b")).distinct().join(texts, "key")
    rows = needed.select("i", "j", F.col("key").alias("a"), F.lit(None).cast("bigint").alias("b"), "text")
    rows = rows.union(dealt.select("i", "j", "a", "b", F.lit(None).cast("binary")))
    return rows.repartition(width(pairs.sparkSession), "i", "j").sortWithinPartitions("i", "j", F.col("b").isNotNull())


def near_duplicates(docs: DataFrame, ngram: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` and ``kept``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A document's set holds its distinct
    ``ngram``-word shingles; a shorter text is one shingle. Documents are linked where
    100 * intersection >= percent * union. ``component_id`` is the smallest id reachable by links.

    Null or empty texts and texts of separators have an empty set and are linked with nothing. A row
    with a null id is linked with nothing, has a null component and is kept. Rows that repeat an id
    are rows of their own. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("binary").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    feats = scratch.save(rows.mapInArrow(_features(ngram), f"id {id_type}, h bigint, n bigint, key bigint, sig array<bigint>, s1 bigint, s2 bigint"))
    whole = ("n", "sig", "s1", "s2")
    nodes = scratch.save(feats.filter("n > 0 and id is not null").groupBy("key").agg(F.min(F.struct("id", "h")).alias("rep"), *(F.first(c).alias(c) for c in whole)))
    posts = scratch.save(_prefix_postings(nodes))
    wanted = scratch.save(nodes.join(posts.select("key").distinct(), "key", "left_semi").select("key", "rep.*"))
    texts = scratch.save(rows.join(small(wanted), ["id", "h"]).select("key", "text").dropDuplicates(["key"]))

    blocks = max(1, texts.count() // BLOCK)

    def confirm(pairs: DataFrame) -> DataFrame:
        return _cells(pairs, texts, blocks, scratch).mapInArrow(_linked(ngram, percent), "src bigint, dst bigint")

    sized = 100 * F.least("n", "n_b") >= percent * F.greatest("n", "n_b")
    differ = F.bit_count(F.col("s1").bitwiseXOR(F.col("s1_b"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("s2_b")))
    component = clusters(posts, confirm, scratch, sized & (differ <= BITS - LEAST_BITS), -differ)
    component = component if component is not None else nodes.select("key", F.col("key").alias("component"))

    grouped = nodes.select("key", "rep.id").join(component, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = grouped.groupBy("component").agg(F.min("id").alias("component_id"))
    named = grouped.join(least, "component").select("key", "component_id")
    out = feats.select("id", "n", F.when(F.col("id").isNotNull(), F.col("key")).alias("key")).join(named, "key", "left")
    own = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        own.alias("component_id"),
        F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"),
    )


def _prefix_postings(nodes: DataFrame) -> DataFrame:
    """The rarest coordinate-value pairs of each set that another set has too; ``place`` 1 is the commonest kept."""
    tokens = nodes.select("key", F.explode("sig").alias("token"))
    shared = tokens.withColumn("df", F.count("*").over(Window.partitionBy("token"))).filter("df > 1")
    own = Window.partitionBy("key")
    count = F.count("*").over(own)
    ranked = shared.select("token", "key", count.alias("count"), F.row_number().over(own.orderBy("df", "token")).alias("rank"))
    # Coordinates that no other set has come first in the order of rarity and need no posting.
    length = F.least("count", F.col("count") - MATCHES + 1)
    kept = ranked.withColumn("length", length).filter(F.col("rank") <= F.col("length"))
    return kept.select("token", "key", (F.col("length") - F.col("rank") + 1).alias("place")).join(nodes.select("key", "n", "s1", "s2"), "key")
