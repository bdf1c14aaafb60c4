"""Scores added up beside a chunk against the joins, with ties, repeated searches, scopes and small blocks."""

import random

import pytest

from notelake.operators import postings, retrieval, scoring, search

WORDS = "alert crash red fish blue café tree leaf river stone".split()


def drawn(n, seed=3):
    draw = random.Random(seed)
    texts = [" ".join(draw.choices(WORDS, range(10, 0, -1), k=draw.randint(0, 9))) for _ in range(n)]
    return [(i // 3, f"c{i:03d}", texts[i % (n // 2)]) for i in range(n)]  # each text twice: ties


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()))


@pytest.fixture
def small_blocks(monkeypatch):
    for name in ("WORDS", "CELLS", "PARTS"):
        monkeypatch.setattr(scoring, name, 16)


@pytest.mark.parametrize("limit", [None, 1, 4])
def test_search_equals_the_joins(spark, monkeypatch, small_blocks, limit):
    chunks = spark.createDataFrame(drawn(120), "owner int, chunk string, text string")
    asked = spark.createDataFrame([(7, "red fishes"), (8, "stone, crashed alerts"), (9, "none"), (10, "café")], "query_id int, text string")
    by_query = chunks.selectExpr("chunk", "owner % 2 + 7 AS query_id")
    for scope in (None, chunks.filter("owner % 2 = 0").select("chunk"), by_query):
        made = [rows(retrieval.bm25_search(chunks, asked, "chunk", {"text": "text"}, limit, scope)), rows(postings.search_index(postings.index_of(chunks, {"text": "text"}), asked, limit, scope))]
        with monkeypatch.context() as joined:
            joined.setattr(retrieval, "INLINE_STEMS", 0)
            expected = rows(retrieval.bm25_search(chunks, asked, "chunk", {"text": "text"}, limit, scope))
        assert made == [expected] * 2 and expected


def test_documents_equal_the_joins_and_no_pairs_are_shuffled(spark, monkeypatch, small_blocks, tmp_path):
    chunks = spark.createDataFrame([(o, k, f"{t} see ref-{o % 5}", 0, 0, 0) for o, k, t in drawn(120)], "owner int, chunk_key string, text string, ordinal int, start_line int, end_line int")
    asked = spark.createDataFrame([(7, "red fishes"), (8, "stone ref-3"), (9, "none"), (10, "ref-9 café")], "query_id int, text string")
    archived, over = spark.createDataFrame([(i,) for i in range(0, 40, 3)], "owner int"), spark.createDataFrame([(i, i + 1) for i in range(0, 40, 4)], "old int, new int")
    index = postings.index_of(chunks.selectExpr("owner", "chunk_key AS chunk", "text"), {"text": "text"})
    read = postings.write_index(index, str(tmp_path / "index"))
    found = lambda held: rows(search.search_documents(held, asked, chunks, archived, over, 4))
    made = [found(index), found(read)]
    monkeypatch.setattr(postings, "PUSHED_STEMS", 0)
    assert made == [found(read)] * 2 and len(made[0]) > 8
    assert "hashpartitioning" not in index.postings._jdf.queryExecution().executedPlan().toString()


def test_a_task_passes_on_what_can_reach_the_limit(spark):
    chunks = spark.range(2000).selectExpr("id", "'red fish' AS text").coalesce(1)
    held = chunks.select("id", scoring.counted(scoring.weighted_words({"text": "text"})).alias("held")).select("id", "held.len", "held")
    asked = scoring.asked_of([{"query_id": 1, "token": "red", "df": 2000}], 2000, 4000)
    made = scoring.scored(held, asked, spark.range(1).schema["id"].dataType, ["id"], "id", 5)
    assert [r.id for r in made.collect()] == [0, 1, 2, 3, 4]


def test_word_search_counts_each_word(spark, small_blocks):
    chunks = spark.createDataFrame([(1, "red red fish"), (2, "Red fish fish"), (3, "fish"), (4, None)], "id int, text string")
    asked = spark.createDataFrame([(1, "red fish red"), (2, "fishes")], "query_id int, text string")
    made = retrieval.tf_search(chunks, asked, "id", {"text": "text"}, 2)
    assert sorted((r.query_id, r.id, r.score, r["rank"]) for r in made.collect()) == [(1, 1, 3, 1), (1, 2, 3, 2)]


def test_repeated_keys_are_one_chunk(spark):
    chunks = spark.createDataFrame([(1, "red fish"), (1, "red"), (2, "")], "id int, text string")
    assert sorted((r.id, r.token, r.n) for r in retrieval.build_postings(chunks, "id", {"text": "text"}).collect()) == [(1, "fish", 1), (1, "red", 2)]


def test_phrases_in_the_tasks_equal_the_joins(spark, monkeypatch, small_blocks):
    chunks = spark.createDataFrame([(k, t) for _, k, t in drawn(120)], "chunk string, text string")
    phrases = spark.createDataFrame([(1, "red fish"), (1, "fish alerts"), (2, "alert crashed alert"), (3, "Red, fish"), (4, "nowhere"), (5, "")], "phrase_id int, phrase string")
    made = rows(retrieval.phrase_match(chunks, phrases, "chunk", "text"))
    monkeypatch.setattr(retrieval, "INLINE_STEMS", 0)
    assert made == rows(retrieval.phrase_match(chunks, phrases, "chunk", "text")) and {r[1] for r in made} == {1, 2, 3}
