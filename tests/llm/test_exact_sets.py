"""Words that polynomial hashes cannot tell apart, words that end in separators, runs of 50 words by brute force, long decodings."""

from collections import defaultdict

from pyspark.sql import functions as F

from notelake.llm import bpe
from notelake.llm.near_dedup import near_duplicates
from notelake.llm.substring_dedup import WORDS, near_duplicate_passages
from notelake.llm.textbytes import joined_word_prints, word_prints

SF = "/root/testdata/sf0.001"


def thue_morse(letters):
    return "".join(letters[i.bit_count() % 2] for i in range(4096))


def test_words_of_equal_polynomials_are_different(spark):
    one, other = thue_morse("ab"), thue_morse("ba")
    assert word_prints(one.encode())[0] != word_prints(other.encode())[0] and word_prints(one.upper().encode())[0] == word_prints(one.encode())[0]
    assert joined_word_prints([one.encode(), b"x", other.encode()])[0].tolist() == [*word_prints(one.encode()), *word_prints(b"x"), *word_prints(other.encode())]
    made = near_duplicates(spark.createDataFrame([(1, one), (2, other), (3, one + " ")], "doc_id int, text string"), 2, 80).collect()
    assert {r.doc_id: r.component_id for r in made} == {1: 1, 2: 2, 3: 1}


def test_passages_of_such_words_are_different(spark):
    ones, others = ([thue_morse(x) + str(i) for i in range(60)] for x in ("ab", "ba"))
    made = near_duplicate_passages(spark.createDataFrame([(1, " ".join(ones)), (2, " ".join(others)), (3, " ".join(ones))], "doc_id int, text string")).collect()
    assert {r.doc_id for r in made} == {1, 3}


def test_separators_at_the_ends_are_no_words(spark):
    long, short = (" ".join(f"w{i}" for i in range(n)) + "\n" for n in (60, 49))
    rows = [(1, "\t" + long), (2, "\t" + long), (3, short), (4, short)]
    made = near_duplicate_passages(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert {(r.doc_id, r.start_word, r.end_word) for r in made} == {(1, 0, 60), (2, 0, 60)}


def test_every_run_of_words_in_two_documents_is_within_a_passage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: word_prints((r.text or "").encode()).tolist() for r in docs.collect()}
    holders = defaultdict(set)
    for key, words in texts.items():
        for at in range(len(words) - WORDS + 1):
            holders[tuple(words[at : at + WORDS])].add(key)
    covered = defaultdict(set)
    for r in near_duplicate_passages(docs).collect():
        covered[r.doc_id].update(range(r.start_word, r.end_word))
    wanted = missed = 0
    for key, words in texts.items():
        for at in range(len(words) - WORDS + 1):
            if len(holders[tuple(words[at : at + WORDS])]) > 1:
                wanted += 1
                missed += not covered[key].issuperset(range(at, at + WORDS))
    print("runs", wanted, "missed", missed)
    assert wanted and missed <= 0.02 * wanted


def test_decoding_has_no_end(spark, monkeypatch):
    # A row holds an array of less than 2 GB, so of less than 2 ** 29 ids.
    assert bpe._FAN**bpe._LEVELS >= 1 << 29
    monkeypatch.setattr(bpe, "_FAN", 3)
    rows = spark.range(1).select(F.expr("transform(sequence(0, 242), i -> i % 2)").alias("bpe_ids"))
    assert bytes(bpe.decode(rows, {b"a": 0, b"b": 1}).first().bpe_bytes) == b"ab" * 121 + b"a"
