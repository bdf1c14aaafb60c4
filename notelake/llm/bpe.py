"""Byte-level BPE encoding and decoding.

Texts are split by the tokenizer's pattern into words, and each distinct word of a partition is told
once, ahead of the first text that holds it, with the merges that it can take: its spans that are
pieces, ranked. Spark folds each word over its ranked merges (a higher-order fold), and the texts, which
follow as numbers of words, take their words' ids in order. All of this is narrow: nothing is shuffled or
sent to the driver, and a partition folds each word once. Words of more than ``MASKED`` bytes, and all words
where merges do not come in order of rank, are folded as arrays: each step merges the adjacent pair of
lowest rank until none is left, with the ranks of all pairs at hand in a literal map cut into buckets.
Decoding looks up each id's bytes in a literal array and joins them, as strings of one character for each byte.
"""

from __future__ import annotations

import base64
import json
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.piece_spans import MERGES, Vocabulary
from notelake.llm.textbytes import small_parts

#: Distinct words that a task remembers; beyond them it starts anew and words may be folded again.
REMEMBERED = 2_000_000
#: New words in a row.
TOLD = 4096
#: Bytes of text in a batch, about.
PART = 1 << 20
#: Bytes of a word that is folded as an array; longer ones take the same merges from a heap.
LONGEST = 2000
_BUCKETS = 1 << 16
#: Pieces are joined in runs of 64 ** 4, and 64 runs hold 64 ** 5 ids, twice as many as an array of a row can hold (2 GB).
_FAN, _LEVELS = 64, 5


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """A vocabulary file of lines ``base64 rank``; Spark reads it from wherever it lies."""
    path = path if ":" in path else f"file://{path}"
    rows = spark.read.text(path).filter("value != ''").collect()
    return {base64.b64decode(a): int(b) for a, b in (r["value"].split(" ") for r in rows)}


def _literal(ranks: dict[bytes, int]) -> Column:
    """The ranks as one literal: buckets of maps by the CRC of the piece, whose bytes are characters."""
    buckets: list[dict[str, int]] = [{} for _ in range(_BUCKETS)]
    for piece, rank in ranks.items():
        key = piece.decode("latin-1")
        buckets[zlib.crc32(key.encode()) % _BUCKETS][key] = rank
    return F.from_json(F.lit(json.dumps(buckets, ensure_ascii=False)), "array<map<string,int>>")


def _rank(ranks: Column, piece: Column) -> Column:
    return F.element_at(F.get(ranks, (F.crc32(piece.cast("binary")) % _BUCKETS).cast("int")), piece)


_NONE = 1 << 30
#: Characters that are no bytes: the word's ends, whose pairs have no rank, and what stands between pieces.
_END, _CUT = "\u0100", "\u0101"


def _fold(ranks: Column, b: Column) -> Column:
    """The pieces of a word, given as a string of one character for each byte, between two ends.

    The state holds the pieces, as a string with a cut between two, and the rank of each piece with its
    successor. A step takes out the cut of the pair of lowest rank, the leftmost of equals, and ranks
    the two pairs that the merged piece is part of.
    """
    ranked = lambda x: F.coalesce(_rank(ranks, x), F.lit(_NONE))
    rest = F.lit(1 << 30)
    cut, nothing = F.lit(_CUT), F.lit("")
    places = F.sequence(F.lit(1), F.length(b) - 1)
    start = F.struct(F.array_join(F.split(b, ""), _CUT).alias("t"), F.transform(places, lambda i: ranked(F.substring(b, i, F.lit(2)))).alias("r"))

    def merged(r: Column, m: Column, left: Column, right: Column) -> Column:
        before = F.concat(F.replace(F.substring_index(left, _CUT, -2), cut, nothing), F.substring_index(right, _CUT, 1))
        behind = F.concat(F.substring_index(left, _CUT, -1), F.replace(F.substring_index(right, _CUT, 2), cut, nothing))
        return F.struct(F.concat(left, right).alias("t"), F.concat(F.slice(r, F.lit(1), m - 2), F.array(ranked(before), ranked(behind)), F.slice(r, m + 2, rest)).alias("r"))

    def step(s: Column, _: Column) -> Column:
        t, r = s["t"], s["r"]
        least = F.array_min(r)
        at = F.array(F.array_position(r, least).cast("int"))
        parted = lambda m: F.get(F.transform(F.array(F.call_function("substring_index", t, cut, m)), lambda left: merged(r, m, left, F.substring(t, F.length(left) + 2, rest))), F.lit(0))
        return F.when(least == _NONE, s).otherwise(F.get(F.transform(at, parted), F.lit(0)))

    pieces = lambda s: F.filter(F.split(s["t"], _CUT), lambda p: p != _END)
    return F.aggregate(F.sequence(F.lit(1), F.length(b) - 2), start, step, pieces)


def _folded(rows: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """The rows with arrays ``cuts`` and ``ids`` in place of ``merges``, one entry for each of their ``words``.

    A cut is a number with a bit for each place where a piece of the word starts or ends. A merge takes place
    if the pieces are its two parts then, and clears the bit between. Words without merges have ids instead.
    Null words and words of more than ``LONGEST`` bytes, whose fold would copy long arrays at each merge,
    have neither: see ``merge_long``.
    """
    stepwise = lambda table, b: F.transform(_fold(table, F.concat(F.lit(_END), b, F.lit(_END))), lambda p: _rank(table, p))
    known = lambda table, b: F.get(F.transform(F.array(_rank(table, b)), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(stepwise(table, b))), F.lit(0))
    made = lambda table, w: F.get(F.transform(F.array(F.decode(F.encode(w, "UTF-8"), "ISO-8859-1")), lambda b: known(table, b)), F.lit(0))
    one = lambda table, w, m: F.when(m.isNull() & F.octet_length(w).between(1, LONGEST), made(table, w))
    # One lambda binds the map, so that the plan holds the literal once.
    ids = F.get(F.transform(F.array(_literal(ranks)), lambda table: F.zip_with("words", "merges", lambda w, m: one(table, w, m))), F.lit(0))
    # Two to the power of n + 1, less one, without leaving 64 bits: the bits of the places 0 to n.
    every = lambda w: F.shiftleft(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.octet_length(w)) - 1, 1).bitwiseOR(F.lit(1))
    step = lambda s, m: F.when(s.bitwiseAND(m["span"]) == m["parts"], s - m["cut"]).otherwise(s)
    cuts = F.zip_with("words", "merges", lambda w, m: F.aggregate(m, every(w), step))
    return rows.withColumns({"cuts": cuts, "ids": ids}).drop("merges")


def word_ids(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """The rows of ``words(word, ...)`` with an array ``ids``, in the same order of rows.

    Null words and words of more than ``LONGEST`` bytes have null: see ``merge_long``.
    """
    vocabulary, names = Vocabulary(ranks), words.columns
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in words.schema.fields)

    def spanned(batches):
        for batch in batches:
            each = np.arange(batch.num_rows + 1, dtype=np.int32)
            some = batch.column("word")
            merges = vocabulary.merges(some.to_pylist())
            yield batch.append_column("words", pa.ListArray.from_arrays(each, some)).append_column("merges", pa.ListArray.from_arrays(each, merges))

    def named(batches):
        for batch in batches:
            lists, cuts = batch.column("ids").flatten(), batch.column("cuts").flatten()
            flat, sizes = _word_ids(batch.column("word").to_pylist(), lists, cuts, vocabulary, lambda word: [])
            absent = lists.is_null().to_numpy(zero_copy_only=False) & cuts.is_null().to_numpy(zero_copy_only=False)
            offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32), mask=np.append(absent, False))
            ids = pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], ids], names=[*names, "ids"])

    return _folded(words.mapInArrow(spanned, f"{fields}words array<string>, merges array<{MERGES}>"), ranks).mapInArrow(named, f"{fields}ids array<int>")


def _word_ids(words: list[str | None], lists: pa.Array, cuts: pa.Array, vocabulary: Vocabulary, otherwise) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words in order, and how many each has; ``otherwise`` gives those of words that were not folded."""
    by_cuts = cuts.is_valid().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(by_cuts)
    flat, counts = vocabulary.cut([words[i].encode() for i in at.tolist()], cuts.drop_null().to_numpy()) if len(at) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    if len(at) == len(words):
        return flat, counts
    sizes = np.zeros(len(words), np.int64)
    sizes[at] = counts
    rest = {i: otherwise(words[i]) if (ids := lists[i].as_py()) is None else ids for i in np.flatnonzero(~by_cuts).tolist()}
    for i, ids in rest.items():
        sizes[i] = len(ids)
    starts = np.cumsum(sizes) - sizes
    made = np.zeros(int(sizes.sum()), np.uint32)
    made[np.repeat(starts[at] - (np.cumsum(counts) - counts), counts) + np.arange(len(flat))] = flat
    for i, ids in rest.items():
        made[starts[i] : starts[i] + len(ids)] = ids
    return made, sizes


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a long word: merges in order of rank and place from a heap over linked pieces."""
    import heapq

    if word in ranks:
        return [ranks[word]]
    end = list(range(1, len(word) + 1))
    before = list(range(-1, len(word) - 1))
    alive = bytearray(b"\1" * len(word))
    heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(len(word) - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= len(word) or end[j] != stop:
            continue
        alive[j], end[i] = 0, stop
        if stop < len(word):
            before[stop] = i
            if (rank := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (rank, i, end[stop]))
        h = before[i]
        if h >= 0 and (rank := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (rank, h, stop))
    return [ranks[word[i : end[i]]] for i in range(len(word)) if alive[i]]


def _told(pattern: str, kept: int, vocabulary: Vocabulary):
    """Rows of many new words with their merges, then the texts of the batch as numbers of words; an empty word forgets all."""

    def run(batches):
        found = regex.compile(pattern).findall
        numbers: dict[str, int] = {}
        for batch in (part for batch in batches for part in small_parts(batch, kept, PART)):
            fresh = []
            if len(numbers) > REMEMBERED:
                numbers = {}
                fresh.append("")
            known, coded = len(numbers), []
            for text in batch.column(kept).to_pylist():
                coded.append(np.array([numbers.setdefault(w, len(numbers)) for w in found(text)], "<u4").tobytes() if text else b"")
            fresh += islice(numbers, known, None)
            # One row for many words: a row of its own costs more than a word's fold.
            cuts = np.array([*range(0, len(fresh), TOLD), len(fresh)], np.int32)
            told, texts = len(cuts) - 1, len(coded)
            words, merges = pa.ListArray.from_arrays(cuts, pa.array(fresh, pa.string())), pa.ListArray.from_arrays(cuts, vocabulary.merges(fresh))
            columns = [pa.concat_arrays([pa.nulls(told, c.type), c]) for c in batch.columns[:kept]]
            columns += [pa.concat_arrays([c, pa.nulls(texts, c.type)]) for c in (words, merges)]
            columns.append(pa.concat_arrays([pa.nulls(told, pa.binary()), pa.array(coded, pa.binary())]))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:kept], "words", "merges", "coded"])

    return run


class _Dictionary:
    """Ids of the words told so far, by number."""

    def __init__(self):
        self.parts, self.sizes, self.flat = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], None

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.parts.append(flat)
        self.sizes.append(sizes)
        self.flat = None

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        if self.flat is None:
            self.parts, self.sizes = [np.concatenate(self.parts)], [np.concatenate(self.sizes)]
            self.flat, self.size = self.parts[0], self.sizes[0]
            self.start = np.cumsum(self.size) - self.size
        sizes = self.size[numbers]
        ends = np.cumsum(sizes)
        return self.flat[np.arange(ends[-1]) + np.repeat(self.start[numbers] - ends + sizes, sizes)]


def _taken(ranks: dict[bytes, int], kept: int, vocabulary: Vocabulary):
    """The texts with the ids of their words; rows come in the order of ``_told``."""

    def run(batches):
        known = _Dictionary()
        for batch in batches:
            words, coded, made = batch.column("words"), batch.column("coded"), []
            for row, x in enumerate(coded):
                if x.is_valid:
                    made.append(known.ids(np.frombuffer(x.as_py(), "<u4")).tobytes() if len(x.as_py()) else b"")
                    continue
                told, lists, bits = words[row].as_py(), batch.column("ids")[row].values, batch.column("cuts")[row].values
                if told[0] == "":
                    known, told, lists, bits = _Dictionary(), told[1:], lists[1:], bits[1:]
                known.add(*_word_ids(told, lists, bits, vocabulary, lambda word: merge_long(word.encode(), ranks)))
            texts = np.flatnonzero(coded.is_valid().to_numpy(zero_copy_only=False))
            rest = [c.take(pa.array(texts)) for c in batch.columns[:kept]]
            offsets = np.cumsum([0, *map(len, made)]) // 4
            ids = pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(np.frombuffer(b"".join(made), "<u4").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*rest, pa.array(made, pa.binary()), ids], names=[*batch.schema.names[:kept], "bpe_packed", "bpe_ids"])

    return run


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` with ``bpe_ids``, the token ids of the whole text in order, and ``bpe_packed``.

    ``bpe_packed`` holds the ids as little-endian unsigned 32-bit integers. Each match of ``pattern``
    is encoded separately and without special tokens, by the lowest-ranked pair of neighbours first,
    the leftmost of equals. Null and empty texts have no ids. Every row is kept, with the columns
    ``keep`` (default: all); only columns with the names of the two new ones are replaced.
    """
    spare = [c for c in (docs.columns if keep is None else keep) if c not in ("bpe_ids", "bpe_packed")]
    inner = [f"c{i}" for i in range(len(spare))]
    plain = docs.select(*(F.col(f"`{c}`").alias(i) for c, i in zip(spare, inner, strict=True)), F.col(text_col).cast("string").alias("__text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in plain.schema.fields[:-1])
    vocabulary = Vocabulary(ranks)
    told = plain.mapInArrow(_told(pattern, len(inner), vocabulary), f"{fields}words array<string>, merges array<{MERGES}>, coded binary")
    made = _folded(told, ranks).mapInArrow(_taken(ranks, len(inner), vocabulary), f"{fields}bpe_packed binary, bpe_ids array<int>")
    return made.select(*(F.col(i).alias(c) for i, c in zip(inner, spare, strict=True)), "bpe_packed", "bpe_ids")


def decode(rows: DataFrame, ranks: dict[bytes, int], ids_col: str = "bpe_ids") -> DataFrame:
    """The rows with a column ``bpe_bytes``: the tokens' bytes concatenated; no ids give no bytes."""
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.decode("latin-1")
    table = F.from_json(F.lit(json.dumps(pieces, ensure_ascii=False)), "array<string>")
    nothing, run = F.lit(b""), _FAN ** (_LEVELS - 1)
    ids = F.coalesce(F.col(ids_col), F.array().cast("array<int>"))
    runs = F.sequence(F.lit(0), F.greatest(F.floor((F.size(ids) - 1) / run).cast("int"), F.lit(0)))
    joined = lambda t, some: F.encode(F.array_join(F.transform(some, lambda i: F.get(t, i)), ""), "ISO-8859-1")
    parts = F.get(F.transform(F.array(table), lambda t: F.transform(runs, lambda k: joined(t, F.slice(ids, k * run + 1, F.lit(run))))), F.lit(0))
    return rows.withColumn("bpe_bytes", F.aggregate(parts, nothing, lambda all_, x: F.concat(all_, x)))


def bpe_digest(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_tokens``, SHA-256 of the ids and SHA-256 of the bytes decoded from them."""
    coded = decode(encode(docs, ranks, pattern, text_col, [id_col]), ranks)
    return coded.select(
        id_col,
        F.size("bpe_ids").cast("long").alias("n_tokens"),
        F.sha2("bpe_packed", 256).alias("ids_sha256"),
        F.sha2("bpe_bytes", 256).alias("decoded_sha256"),
    )
