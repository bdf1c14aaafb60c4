"""Folded words and stems against a table of known stems, and the kept index against one built anew."""

import pytest
from pyspark.sql import functions as F

from notelake.functions.words import porter, stem_tokens, word_count, words
from notelake.operators import postings, retrieval

STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan
falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic
differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit
sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop
adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog
effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil alerts alert alert alert crashed crash crashing crash ies ie yes ye say sai by by is is""".split()


def test_known_stems():
    assert {w: porter(w) for w in STEMS[::2]} == dict(zip(STEMS[::2], STEMS[1::2]))
    assert porter("a" * 62 + "ing") == "a" * 62 + "ing"


def test_words_of_all_scripts(spark):
    texts = ["Café ÉCOLE naïve", "größe Ñandú", "Привет, мир! привет", "été x_y-z 3.14", "", None, "  --  ", "日本語 한국어", "alerts' ALERT alerted"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    made = df.select("i", words(F.col("text")).alias("w"), word_count(F.col("text")).alias("n"), stem_tokens(F.col("text"))).orderBy("i").collect()
    assert [r.w for r in made] == [["cafe", "ecole", "naive"], ["große", "nandu"], ["привет", "мир", "привет"], ["ete", "x", "y", "z", "3", "14"], [], [], [], ["日本語", "한국어"], ["alerts", "alert", "alerted"]]
    assert [r.n for r in made] == [len(r.w) for r in made]
    assert made[8].stems == ["alert"] * 3 and made[4].stems == []


def test_search_meets_other_forms(spark):
    chunks = spark.createDataFrame([(1, "Alerts crashed the café"), (2, "nothing here"), (3, None)], "id int, text string")
    asked = spark.createDataFrame([(1, "alert crashing"), (2, "CAFE"), (3, "...")], "query_id int, text string")
    found = retrieval.bm25_search(chunks, asked, "id", {"text": "text"})
    assert sorted((r.query_id, r.id) for r in found.collect()) == [(1, 1), (2, 1)]
    phrases = spark.createDataFrame([(1, "alert crash"), (2, "crash alert"), (3, "")], "phrase_id int, phrase string")
    assert [tuple(r) for r in retrieval.phrase_match(chunks, phrases, "id", "text").collect()] == [(1, 1)]


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()))


def same_index(one, other):
    return all(rows(a) == rows(b) for a, b in zip(one[:4], other[:4], strict=True))


def test_any_sequence_of_replacements_equals_a_new_index(spark, tmp_path):
    schema, fields = "owner int, chunk int, title string, part string", {"title": "title", "text": "part"}
    state = {(1, 10): ("One", "red fish"), (1, 11): ("One", "blue fishes"), (2, 20): ("Two", "red red"), (3, 30): (None, "")}
    frame = lambda held: spark.createDataFrame([(*k, *v) for k, v in held.items()], schema)
    index = postings.index_of(frame(state), fields)
    steps = [
        ([1], {(1, 10): ("One", "green"), (1, 12): ("One", "fish")}),
        ([2, 9], {}),
        ([4, 3], {(4, 40): ("Four", "fish red"), (3, 30): ("Three", None)}),
        ([], {(1, 99): ("not", "named")}),
        ([4, 4, None], {(4, 41): ("Four", "last")}),
    ]
    for n, (owners, fresh) in enumerate(steps):
        named = spark.createDataFrame([(o,) for o in owners], "owner int")
        index = postings.write_index(postings.replace_chunks(index, named, frame(fresh), fields), str(tmp_path / str(n)))
        state = {k: v for k, v in state.items() if k[0] not in owners} | {k: v for k, v in fresh.items() if k[0] in owners}
        assert same_index(index, postings.index_of(frame(state), fields)), n
    asked = spark.createDataFrame([(1, "fishes"), (2, "last green one")], "query_id int, text string")
    kept = postings.search_index(index, asked, 5)
    anew = retrieval.bm25_search(frame(state), asked, "chunk", fields, 5)
    assert rows(kept) == rows(anew) and kept.count() == 4
    assert "In(token" in kept._jdf.queryExecution().toString()


@pytest.mark.parametrize("most", [0, 10_000])
def test_many_asked_stems_are_joined(spark, monkeypatch, most):
    monkeypatch.setattr(postings, "PUSHED_STEMS", most)
    index = postings.index_of(spark.createDataFrame([(1, 1, "a b"), (2, 2, "c")], "owner int, chunk int, part string"), {"text": "part"})
    made = postings.search_index(index, spark.createDataFrame([(1, "b c")], "query_id int, text string"), scope=spark.createDataFrame([(2,)], "chunk int"))
    assert [(r.chunk, r["rank"]) for r in made.collect()] == [(2, 1)]
