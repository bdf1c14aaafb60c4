"""Small cases and brute-force versions of the training-data operators."""

import base64
import collections
import hashlib
import random
import re
import struct

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from notelake.llm import bpe, decontaminate, edits, embedding_dedup, line_dedup, lists, near_dedup, pseudonyms, substring_dedup, suffix_dedup, suffix_tree_lm, toxicity
from notelake.llm.common import Scratch, connected_components
from notelake.llm.suffix_groups import suffix_order

SCHEMA = "doc_id bigint, text string, n int, component string"
EDGE = [(1, None, 1, "x"), (2, "", 2, None), (3, " \t\n", 3, "x"), (None, "some words in a row here and more", 4, "x"), (5, "one", 5, "y"), (5, "one", 5, "y")]
RNG = random.Random(3)
WORDS = ["w%d" % i for i in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


BASE = prose(120)
LONG = prose(6000)
CORPUS = [
    *EDGE,
    (10, BASE, 1, "a"),
    (11, BASE, 1, "a"),
    (12, BASE.replace("w1 ", "changed ", 1) + " tail", 1, "a"),
    (13, prose(50) + " " + BASE[:400] + " " + prose(60), 1, "b"),
    (14, LONG, 1, None),
    (15, LONG + " end", 1, None),
    *[(20 + i, prose(40), 1, "c") for i in range(20)],
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(CORPUS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def test_components_of_a_chain_and_a_star(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)], "src int, dst int")
    made = {r.node: r.component for r in connected_components(edges, Scratch(spark, "t")).collect()}
    assert all(made[i] == 1 for i in range(1, 41)) and all(made[100 + i] == 100 for i in range(30)) and len(made) == 70


def test_suffix_order_equals_sorting():
    for _ in range(500):
        x = [RNG.randrange(RNG.randint(1, 4)) for _ in range(RNG.randint(0, 30))]
        assert suffix_order(np.array(x, np.int64)).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


@pytest.mark.parametrize("block", [2, 2000])
def test_near_duplicates_equal_brute_force(docs, empty, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(lists, "BLOCK", block)
    for n in (2, 5):
        sets = []
        for d, t, *_ in CORPUS:
            w = split(t)
            k = min(n, len(w))
            sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
        root = list(range(len(CORPUS)))
        find = lambda x: x if root[x] == x else find(root[x])
        for i, a in enumerate(sets):
            for j in range(i):
                b = sets[j]
                if a and b and None not in (CORPUS[i][0], CORPUS[j][0]) and 100 * len(a & b) >= 80 * len(a | b):
                    root[find(i)] = find(j)
        least = {}
        for i, (d, *_) in enumerate(CORPUS):
            if d is not None:
                least[find(i)] = min(d, least.get(find(i), d))
        expected = sorted((str(d), len(sets[i]), str(least.get(find(i)))) for i, (d, *_) in enumerate(CORPUS))
        made = near_dedup.near_duplicates(docs, n).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in made) == expected
    assert near_dedup.near_duplicates(empty).count() == 0


def test_suffix_dedup_equals_brute_force(docs, empty):
    texts = [(t or "").encode() for _, t, *_ in CORPUS]
    seen = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    expected = []
    for (d, *_), t in zip(CORPUS, texts, strict=True):
        mark = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                mark[i : i + 200] = b"\1" * 200
        expected.append((str(d), len(t), sum(mark), hashlib.sha256(bytes(b for b, m in zip(t, mark, strict=True) if not m)).hexdigest()))
    made = suffix_dedup.suffix_digest(suffix_dedup.without_repeated_bytes(docs)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256) for r in made) == sorted(expected)
    assert suffix_dedup.without_repeated_bytes(empty).count() == 0


def test_periodic_text_is_removed_whole(spark):
    made = suffix_dedup.without_repeated_bytes(spark.createDataFrame([(1, "ab" * 500), (2, "short")], "doc_id int, text string"))
    assert sorted((r.doc_id, r.n_removed) for r in made.collect()) == [(1, 1000), (2, 0)]


def test_passages_found_and_clean_documents_left_alone(docs, empty):
    made = substring_dedup.near_duplicate_passages(docs).collect()
    assert {r.doc_id for r in made} == {10, 11, 12, 13, 14, 15}
    assert substring_dedup.near_duplicate_passages(empty).count() == 0


def test_line_dedup_keeps_first_occurrence(spark, empty):
    line = "the quick brown fox jumps over the lazy dog while nobody looks at the old grey barn"
    near = line.replace("lazy", "lasy")
    rows = [(1, f"{line}\nonly here\n\n"), (2, f"other\n{line.upper()}!\n--"), (3, near), (4, None), (None, line), (5, ""), (6, "only here")]
    made = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.without_repeated_lines(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert made[1] == (f"{line}\nonly here\n\n", 0) and made[2] == ("other\n--", 1) and made[6] == ("", 1)
    assert made[4] == (None, 0) and made[5] == ("", 0) and made[None] == (line, 0)
    assert made[3] == ("", 1)
    assert line_dedup.without_repeated_lines(empty).count() == 0


def test_line_dedup_keeps_lines_of_rows_that_share_an_id(spark):
    rows = [(5, "alpha line with enough words\nunique words nobody else holds"), (5, "other start of a text\nalpha line with enough words"), (9, "x" * 30_000)]
    made = sorted(r.text for r in line_dedup.without_repeated_lines(spark.createDataFrame(rows, "doc_id int, text string")).collect())
    assert sum("unique words nobody else holds" in t for t in made) == 1 and sum("alpha line" in t for t in made) == 1 and sum("other start" in t for t in made) == 1


def test_edits_within_a_bound_equal_the_table():
    for _ in range(3000):
        a = "".join(RNG.choice("abc") for _ in range(RNG.randint(0, 90)))
        b = list(a) if RNG.random() < 0.8 else [RNG.choice("abc") for _ in range(RNG.randint(0, 90))]
        for _ in range(RNG.randint(0, 25)):
            at = RNG.randint(0, len(b))
            b[at : at + RNG.randint(0, 1)] = RNG.choice(["", "a", "b", "cc"])
        b = "".join(b)
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        for most in (0, 3, 10, 17, 30):
            assert edits.within(a, b, most) == (row[-1] <= most), (a, b, most, row[-1])


def test_toxicity_learns_folds_and_holds_out(spark, docs, empty):
    rng = random.Random(1)
    rows = [(i, prose(60, rng) + (" zmoronz idiotic" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    rows += [(1000, prose(30) + " ZM0R0NZ 1diotic", None), (1001, None, None), (1002, "", None)]
    made = spark.createDataFrame(rows, "doc_id int, text string, toxic int")
    scored = {r.doc_id: r for r in toxicity.toxicity(made.select("doc_id", "text"), made.select("doc_id", "toxic")).collect()}
    assert all(scored[i].predicted == int(i % 4 == 0) for i in range(400))
    assert scored[1000].predicted == 1 and scored[1001].score == scored[1002].score < 0.5
    assert {r.score for r in toxicity.toxicity(docs, made.select("doc_id", "toxic").limit(0)).collect()}
    assert toxicity.toxicity(empty, made.select("doc_id", "toxic")).count() == 0


def test_bpe_equals_the_library_and_round_trips(spark, empty):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(spark, path)
    assert ranks == {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "  two  spaces\n\n\tand more ", "it's 1234 café 你好 \U0001f600\U0001f600!?", "x" * 300, "aaaa \u0085b\x1cc", prose(30), "<|endoftext|>"]
    made = bpe.bpe_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), ranks, public_tokenizers.PATTERN).collect()
    for r in made:
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()), texts[r.doc_id]
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert bpe.bpe_digest(empty, ranks, public_tokenizers.PATTERN).count() == 0
    clash = spark.createDataFrame([(1, "some text", 7, {"a": 1}), (1, "some text", 7, {"a": 1}), (None, None, None, None)], "ranks int, text string, word int, bpe_ids map<string,int>")
    coded = bpe.encode(clash, ranks, public_tokenizers.PATTERN).collect()
    assert [(r.ranks, r.word) for r in coded if r.ranks] == [(1, 7)] * 2 and all(r.bpe_ids == library.encode_ordinary(r.text or "") for r in coded)


def test_bpe_of_long_words_equals_the_library(spark):
    ranks = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = ["".join(RNG.choice("abcdeéñ") for _ in range(n)) for n in (1, 2, 3, 50, 700, 1500, 3000, 100_000)] + ["ab" * 900, "a" * 1999, "the" * 5000]
    made = bpe.word_ids(spark.createDataFrame([(w,) for w in words], "word string"), ranks).collect()
    assert len(made) == len(words)
    for r in made:
        assert (bpe.merge_long(r.word.encode(), ranks) if r.ids is None else r.ids) == library.encode_ordinary(r.word), len(r.word)
    texts = [" ".join(words), words[-1], "x"]
    coded = bpe.encode(spark.createDataFrame([(t,) for t in texts], "text string"), ranks, public_tokenizers.PATTERN).collect()
    assert all(r.bpe_ids == library.encode_ordinary(r.text) for r in coded)


def test_contained_items_equal_brute_force(spark, docs, empty):
    words = BASE.split()
    items = [(1, " ".join(words[5:30])), (2, " ".join(words[40:60]) + " quite other words follow here now"), (3, "w1 w2"), (4, None), (5, ""), (None, BASE), (6, prose(20))]
    shingles = lambda t: {tuple(w[i : i + min(5, len(w))]) for w in [split(t)] for i in range(max(len(w) - 4, 1))} if split(t) else set()
    expected = set()
    for d, t, *_ in CORPUS:
        for i, q in items:
            if d is not None and i is not None and shingles(q) and 100 * len(shingles(q) & shingles(t)) >= 80 * len(shingles(q)):
                expected.add((d, i))
    table = spark.createDataFrame(items, "item_id int, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contained_items(docs, table).collect()} == expected
    assert decontaminate.contained_items(empty, table).count() == 0 and decontaminate.contained_items(docs, table.limit(0)).count() == 0
    left = decontaminate.decontaminated(docs, table)
    assert left.columns == docs.columns and left.count() == sum(1 for d, *_ in CORPUS if d not in {x for x, _ in expected})


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((300, 16))
    vectors = [*base.tolist(), *(base[:60] + 0.05 * rng.standard_normal((60, 16))).tolist(), *base[:5].tolist()]
    rows = [(i, v, i % 3 if i % 50 else None) for i, v in enumerate(vectors)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0, None], 1), (904, [1.0, 2.0], 1), (905, [2.0, 4.0], 1), (None, base[1].tolist(), 1)]
    made = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id int, embedding array<float>, label int")).collect()}
    good = [(i, np.array(v, np.float32).astype(float), l) for i, v, l in rows if i is not None and l is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = collections.defaultdict(set)
    for i, v, l in good:
        for j, w, m in good:
            if i != j and l == m and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
                links[i].add(j)
    for i, *_ in rows:
        reach, todo = {i}, [i]
        while todo:
            todo += [x for x in links[todo.pop()] if x not in reach and not reach.add(x)]
        assert made[i] == (len(links[i]), min(reach, key=lambda x: (x is None, x)) if i is not None else None), i


def test_pseudonyms_keep_format_and_turn_back(spark):
    text = "Card 4111 1111 1111 1111, mail Jane.Doe9@mail.example.com, on 2024-02-29 or 31/12/1999, ip 10.0.0.255, ssn 123-45-6789, call +1 (456) 555-2186, iban DE89 3704 0044 0532 0130 00, not 4111111111111112 nor 2024-13-40."
    p = pseudonyms.Permutation(b"k")
    made, kinds = pseudonyms.pseudonymise(text, p)
    assert sorted(kinds) == sorted(["card", "email", "date", "date", "ip", "ssn", "phone", "iban"])
    assert len(made) == len(text) or "ip" in kinds
    assert pseudonyms.pseudonymise(made, p, back=True)[0] == text
    assert pseudonyms.pseudonymise(text, pseudonyms.Permutation(b"other"))[0] != made
    card = re.search(r"[0-9][0-9 ]{18}", made)[0]
    assert pseudonyms.luhn(card.replace(" ", "")) and "4111111111111112" in made and "2024-13-40" in made
    rows = spark.createDataFrame([(1, text), (2, "4111 1111 1111 1111"), (3, None), (4, "")], "doc_id int, text string")
    out = {r.doc_id: r for r in pseudonyms.with_pseudonyms(rows, b"k").collect()}
    assert out[2].text == card and out[3].text is None and out[4].text == "" and out[1].text == made


def test_suffix_tree_scores(spark, docs, empty):
    made = suffix_tree_lm.suffix_tree_scores(docs).collect()
    assert len(made) == len(CORPUS)
    counts = collections.Counter()
    held = {r.doc_id: r.held_out for r in made}
    for d, t, *_ in CORPUS:
        if not held[d]:
            counts.update([*split(t), None])
    total, kinds = sum(counts.values()), len(counts)
    by = {(str(d)): t for d, t, *_ in CORPUS}
    for r in made:
        tokens = [*split(by[str(r.doc_id)]), None]
        base = sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[w] > 0 for w in tokens), total)
        assert abs(r.base_score - base) < 1e-6 and r.score < 0
    assert suffix_tree_lm.suffix_tree_scores(empty).count() == 0
