"""Alignment against whole texts, compared token by token."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from notelake.llm.alignment import Tokenizers, byte_letters, cross_tokenizer_alignment, read_file

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(texts):
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letter = byte_letters()
    rows, linked = [], []
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(letter[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            rows.append([0, 0, 0, 0, ""])
            linked.append(Counter())
            continue
        spans = []
        for ids, parts in ((ids_a, bytes_a), (ids_b, bytes_b)):
            at, here = 0, []
            for i, p in zip(ids, parts):
                here.append((i, at, at + len(p)))
                at += len(p)
            spans.append(here)
        links, j = Counter(), 0
        for i, begin, end in spans[0]:
            while spans[1][j][2] <= begin:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][1] < end:
                links[i, spans[1][k][0]] += 1
                k += 1
        shared = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, begin = [], 0
        for end in shared:
            groups.append("|".join(",".join(str(i) for i, s, e in side if s >= begin and e <= end) for side in spans)) if len(text) < 3000 else None
            begin = end
        rows.append([len(ids_a), len(ids_b), len(shared), sum(links.values()), hashlib.sha256(";".join(groups).encode()).hexdigest() if len(text) < 3000 else None])
        linked.append(links)
    counts = Counter(p for links in linked for p in links)
    highest = defaultdict(int)
    for (i, _), n in counts.items():
        highest[i] = max(highest[i], n)
    return [(r[0], r[1], r[2], r[3], sum(n for p, n in links.items() if counts[p] == highest[p[0]]), sum(n * counts[p] for p, n in links.items()), r[4]) for r, links in zip(rows, linked)]


def same(made, want):
    assert len(made) == len(want)
    for got, one in zip(made, want, strict=True):
        assert got[:6] == one[:6] and one[6] in (None, got[6]), (got, one)


ODD = [
    "", None, " ", "  ", "a", " a", "a ", "a  b", "\n", "a\n b", "a \n b\t", "a  b", "x　 y", "▁", "a▁b c", "x ▁", "<|endoftext|> and <s> </s> <unk>", "<0x41> 41", "é ́ e", "﻿ x", "\x1c y\x1c z",
    "\x00 a", "​ b", "aaaaaaaaaa aaa!!!!!!!", "한국어 中文 \U0001f600 \U0001f469‍\U0001f469", "tab\tand  spaces   here ", "don't we'll I'M", "1234567 3.14", "a" * 700 + " " + "b" * 300, "x" * 50 + " " * 40 + "y",
]


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)


def collected(df):
    return [tuple(r)[1:8] for r in df.orderBy("doc_id").collect()]


@pytest.mark.parametrize("hot", [1_000_000, 3, 0])
def test_odd_texts(spark, hot):
    same(collected(cross_tokenizer_alignment(table(spark, ODD), A, B, hot_pairs=hot)), brute(ODD))


@pytest.mark.parametrize("hot", [1_000_000, 50])
def test_driver_table(spark, hot):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").select("text").collect()]
    same(collected(cross_tokenizer_alignment(docs, A, B, hot_pairs=hot)), brute(texts))


def test_groups_and_repeated_rows(spark):
    rows = [(1, "The cat sat.", "x"), (1, "The cat sat.", "x"), (None, "The dog", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, groups string").withColumnRenamed("groups", "row")
    made = cross_tokenizer_alignment(df, A, B, keep_groups=True).collect()
    assert sorted(r.doc_id or 0 for r in made) == [0, 1, 1]
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in made)
    assert {r.count_sum for r in made if r.doc_id == 1} == {brute(["The cat sat."] * 2 + ["The dog"])[0][5]}
    assert cross_tokenizer_alignment(df.limit(0), A, B).collect() == []


def test_identity_map():
    t = Tokenizers(read_file(None, A), read_file(None, B))
    assert all(t.b_bytes[b] == t.a_bytes[a] for a, b in enumerate(t.same) if b >= 0) and (t.same >= 0).sum() > 10_000
