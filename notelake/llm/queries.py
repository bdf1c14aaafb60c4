"""The queries of this package and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.alignment import cross_tokenizer_alignment
from notelake.llm.bpe import bpe_digest, read_ranks
from notelake.llm.byte_cnn import quality
from notelake.llm.decontaminate import CONTAINED_SQL, contained_items
from notelake.llm.embedding_dedup import near_vectors
from notelake.llm.line_dedup import line_digest, without_repeated_lines
from notelake.llm.near_dedup import near_duplicates
from notelake.llm.pseudonyms import with_pseudonyms
from notelake.llm.substring_dedup import near_duplicate_passages
from notelake.llm.suffix_dedup import suffix_digest, without_repeated_bytes
from notelake.llm.suffix_tree_lm import suffix_tree_scores
from notelake.llm.toxicity import toxicity
from notelake.llm.whitening import whitened

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Key of the registered query; production jobs pass their own.
PSEUDONYM_KEY = b"registered query"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_passages(table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_digest(without_repeated_bytes(table(spark, sf_dir, "documents")))


def op3_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(without_repeated_lines(table(spark, sf_dir, "documents")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = read_ranks(spark, public_tokenizers.path(VOCABULARY))
    return bpe_digest(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_pseudonyms(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op9_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_scores(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), ngram=2, percent=80)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = whitened(table(spark, sf_dir, "embeddings"), first=8)
    return made.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokenizer_alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_suffix_array_dedup, op3_fuzzy_line_dedup, op4_toxicity, op5_byte_level_bpe, op6_benchmark_decontamination, op7_embedding_near_dedup, op8_pii_pseudonyms, op9_suffix_tree_lm, op10_minhash_near_dedup, op11_embedding_whitening, op12_cross_tokenizer_alignment, op13_quality_classifier, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op6_benchmark_decontamination": CONTAINED_SQL}
