"""Folds over ranked spans against merges one by one, and encoding that runs nothing ahead."""

import random

import public_tokenizers
from notelake.llm import bpe
from notelake.llm.piece_spans import MASKED, Vocabulary

RNG = random.Random(17)


def test_encoding_runs_no_job_ahead_of_its_rows(spark):
    """Nothing is gathered on the driver, whose memory had to hold the frequent words."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abab": 257}
    docs = spark.createDataFrame([(1, "abab ab b"), (2, None)], "doc_id int, text string")
    spark.sparkContext.setJobGroup("ahead", "encoding")
    coded = bpe.decode(bpe.encode(docs, ranks, r"\s?\S+"), ranks)
    assert not list(spark.sparkContext.statusTracker().getJobIdsForGroup("ahead"))
    assert {r.doc_id: (r.bpe_ids, bytes(r.bpe_bytes)) for r in coded.collect()} == {1: ([257, 32, 256, 32, 98], b"abab ab b"), 2: ([], b"")}


def test_words_of_all_sizes_and_vocabularies_out_of_order(spark):
    learnt = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    # Here "bcd" ranks before "cd": merges do not come in ascending order.
    other = {bytes([b]): b for b in range(256)} | {b"bcd": 256, b"cd": 257, b"ab": 258}
    words = ["".join(RNG.choice("abcdeéß ") for _ in range(n)) for n in (*range(1, 12), *range(MASKED - 3, MASKED + 4), 200)]
    assert Vocabulary(learnt).ordered and not Vocabulary(other).ordered
    for ranks in (learnt, other):
        made = bpe.word_ids(spark.createDataFrame([(w,) for w in words], "word string"), ranks).collect()
        assert [(r.word, r.ids) for r in made] == [(w, bpe.merge_long(w.encode(), ranks)) for w in words]
