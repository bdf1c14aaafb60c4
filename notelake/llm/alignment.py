"""Token alignment between two tokenizers of the same texts.

Tokenizer A is a byte-level BPE of the tokenizers library, tokenizer B a sentencepiece model with byte
fallback. Both cut space+text into tokens; where both end at the same byte a group ends, and tokens whose
bytes overlap are linked. Neither tokenizer joins across a space that follows a visible letter, so texts
are cut there into pieces, and each distinct piece is encoded and aligned once per worker; texts in which
a piece does not give its bytes back are encoded whole.

Identity-map fast path: an array holds for each A id the B id of the same bytes. Links along it are
counted in vectors of A's vocabulary; only other pairs go through a shuffle of pairs.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.common import Scratch
from notelake.llm.textbytes import small_parts

#: Bytes of text handled at once, pieces a worker remembers (twice), longest piece it remembers, bytes encoded in one call.
PART_BYTES, REMEMBERED, LONGEST, CALL_BYTES = 1 << 20, 200_000, 256, 1 << 14
#: Pairs outside the identity map whose counts are broadcast at most (20 bytes each); the rarer ones are joined.
HOT_PAIRS = 1_000_000
#: Distinct pairs a task holds before it hands on partial counts.
HELD_PAIRS = 2_000_000
#: A link is one number: the A id times 2**_SHIFT plus the B id.
_SHIFT = 24
_LOW = (1 << _SHIFT) - 1
#: A cut goes before a space behind anything but white space, controls and invisible characters.
_CUT = re.compile(r"(?<=[^\s\u180e\u200b\u2060\ufeff\x00-\x20\x7f-\xa0])(?= )")
_OPEN_END = re.compile(r"[\s\u180e\u200b\u2060\ufeff\x00-\x20\x7f-\xa0]\Z")


def byte_letters() -> dict[str, int]:
    """The byte behind each letter of byte-level BPE: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers with the bytes of their tokens and the identity map."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        letter = byte_letters()
        names = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.a_bytes[i] = bytes(letter[c] for c in name)
        piece = self.b.id_to_piece
        self.b_bytes = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(t) for t in tokens]) for tokens in (self.a_bytes, self.b_bytes))
        # A piece goes before a byte of the same value, a lower id before a higher one; names of control tokens stand for no bytes.
        usable = [i for i in range(len(self.b_bytes)) if not (self.b.is_control(i) or self.b.is_unknown(i))]
        by_bytes = {self.b_bytes[i]: i for i in sorted(usable, key=lambda i: (self.b.is_byte(i), i), reverse=True)}
        self.same = np.array([by_bytes.get(t, -1) if t else -1 for t in self.a_bytes])
        self.space = self.b.piece_to_id("▁")
        # Ids as text with what follows them in groups: first A's with "," and "|", then B's with "," and ";".
        self.labels = [f"{i}{mark}" for size, marks in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for mark in marks for i in range(size)]
        self.label_size = np.array([len(x) for x in self.labels])

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of both for a string that begins with the space B adds."""
        return self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:]) if len(text) > 1 else [self.space]

    def exact(self, text: bytes, a: list[int], b: list[int]) -> bool:
        return b"".join(map(self.a_bytes.__getitem__, a)) == text and b"".join(map(self.b_bytes.__getitem__, b)) == text


class Aligner:
    """Alignments of the pieces one worker has met."""

    kept: dict[tuple, Aligner] = {}

    def __init__(self, tokenizers: Tokenizers):
        self.t = tokenizers
        # Pieces met lately, and those before them, which move up when they are met again.
        self.known: dict[str, tuple[bytes, bytes, int, int] | None] = {}
        self.before: dict[str, tuple[bytes, bytes, int, int] | None] = {}

    @classmethod
    def of(cls, files) -> Aligner:
        """This worker's aligner for the broadcast files; pieces stay known from task to task."""
        a_file, b_file = files.value
        key = (hashlib.md5(a_file).digest(), hashlib.md5(b_file).digest())
        if key not in cls.kept:
            cls.kept = {key: cls(Tokenizers(a_file, b_file))}
        return cls.kept[key]

    def learn(self, pieces: list[str]) -> None:
        """Align new pieces: those with closed ends many in one call, others one by one."""
        closed = [p for p in pieces if not _OPEN_END.search(p)]
        for p in set(pieces).difference(closed):
            self._one(p)
        size, begin = 0, 0
        for i, p in enumerate(closed):
            size += len(p)
            if size >= CALL_BYTES or i + 1 == len(closed):
                self._many(closed[begin : i + 1])
                size, begin = 0, i + 1

    def _one(self, piece: str) -> None:
        a, b = self.t.encode(piece)
        raw = piece.encode()
        self.known[piece] = self._aligned([raw], a, b)[0] if self.t.exact(raw, a, b) else None

    def _many(self, pieces: list[str]) -> None:
        a, b = self.t.encode("".join(pieces))
        raw = [p.encode() for p in pieces]
        if self.t.exact(b"".join(raw), a, b):
            self.known.update(zip(pieces, self._aligned(raw, a, b), strict=True))
        else:
            for p in pieces:
                self._one(p)

    def _aligned(self, raw: list[bytes], a: list[int], b: list[int]) -> list[tuple[bytes, bytes, int, int]]:
        """Links, groups as text, A tokens and groups of each of the pieces that ``a`` and ``b`` cut."""
        a, b = np.array(a), np.array(b)
        a_end, b_end = np.cumsum(self.t.a_size[a]), np.cumsum(self.t.b_size[b])
        ends = np.cumsum([len(r) for r in raw])
        here = b_end[np.searchsorted(b_end, a_end)] == a_end
        stops = a_end[here]
        both = np.sort(np.concatenate([a_end[~here], b_end]))
        links = (a[np.searchsorted(a_end, both)] << _SHIFT) | b[np.searchsorted(b_end, both)]
        a_stop, b_stop = np.flatnonzero(here) + 1, np.searchsorted(b_end, stops) + 1
        # In the text of the groups A's tokens of a group stand behind B's of the groups before, B's behind A's of the same group.
        a_count, b_count = np.diff(a_stop, prepend=0), np.diff(b_stop, prepend=0)
        labels = np.empty(len(a) + len(b), np.int64)
        n_a, n_b = len(self.t.a_bytes), len(self.t.b_bytes)
        labels[np.arange(len(a)) + np.repeat(b_stop - b_count, a_count)] = a + n_a * here
        last = np.zeros(len(b), np.int64)
        last[b_stop - 1] = n_b
        labels[np.arange(len(b)) + np.repeat(a_stop, b_count)] = 2 * n_a + b + last
        text = "".join(map(self.t.labels.__getitem__, labels.tolist())).encode()
        groups_at = np.searchsorted(stops, ends, "right")
        tokens = a_stop[groups_at - 1]
        text_at = np.cumsum(self.t.label_size[labels])[tokens + b_stop[groups_at - 1] - 1].tolist()
        packed, out, x, y, z, g = links.tobytes(), [], 0, 0, 0, 0
        for p, q, r, h in zip((8 * np.searchsorted(both, ends, "right")).tolist(), text_at, tokens.tolist(), groups_at.tolist(), strict=True):
            out.append((packed[x:p], text[y : q - 1], r - z, h - g))
            x, y, z, g = p, q, r, h
        return out

    def texts(self, texts: list[str | None]) -> list[list[tuple[bytes, bytes, int, int]]]:
        """The aligned pieces of each text; none for null, empty and texts whose tokens do not give their bytes back."""
        cut = [_CUT.split(" " + t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.before = {}, self.known
        fresh = {p for pieces in cut for p in pieces}.difference(self.known)
        again = fresh.intersection(self.before)
        self.known.update((p, self.before.pop(p)) for p in again)
        fresh -= again
        self.learn(list(fresh))
        out = []
        for text, pieces in zip(texts, cut, strict=True):
            found = [self.known[p] for p in pieces]
            if None in found:
                whole = " " + text
                a, b = self.t.encode(whole)
                found = self._aligned([whole.encode()], a, b) if self.t.exact(whole.encode(), a, b) else []
            out.append(found)
        for p in fresh:
            if len(p) > LONGEST:
                del self.known[p]
        return out


def _digest(found: list[tuple[bytes, bytes, int, int]], keep: bool) -> tuple[str, str | None]:
    """SHA-256 of the groups, piece by piece, and the groups if they are kept."""
    if not found:
        return "", "" if keep else None
    hashed = hashlib.sha256()
    for i in range(0, len(found), 100_000):
        hashed.update((b";" if i else b"") + b";".join([f[1] for f in found[i : i + 100_000]]))
    return hashed.hexdigest(), b";".join([f[1] for f in found]).decode() if keep else None


_LINKED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, same_ids binary, same_links binary, pairs binary, pair_links binary"


def _decoded(value: bytes | None) -> str | None:
    """Text of UTF-8 bytes; other bytes are no text, as no tokens give them back."""
    try:
        return value.decode() if value else None
    except UnicodeDecodeError:
        return None


def read_file(spark: SparkSession, path: str) -> bytes:
    """A vocabulary file's bytes: through Spark where the path names a store, else from the local file."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])
    with open(path, "rb") as file:
        return file.read()


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> DataFrame:
    """One row per document: ``id``, counts of tokens, groups and links, the groups' SHA-256 and, if asked for, the groups.

    ``same_ids`` and ``same_links`` hold the distinct A ids linked along the identity map (32-bit) and
    how often, ``pairs`` and ``pair_links`` the other distinct pairs (64-bit, A id times 2**24 plus B id)
    and how often.
    """
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast((read_file(spark, a_path), read_file(spark, b_path)))

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        aligner = Aligner.of(files)
        same = aligner.t.same
        for batch in batches:
            for part in small_parts(batch, 1, PART_BYTES):
                rows = []
                for found in aligner.texts([_decoded(v) for v in part.column(1).to_pylist()]):
                    links = np.frombuffer(b"".join([f[0] for f in found]), np.int64)
                    distinct, times = np.unique(links, return_counts=True)
                    a = distinct >> _SHIFT
                    along = same[a] == distinct & _LOW
                    n_a, n_groups = sum([f[2] for f in found]), sum([f[3] for f in found])
                    times = times.astype(np.int32)
                    rows.append((n_a, len(links) + n_groups - n_a, n_groups, len(links), *_digest(found, keep_groups), a[along].astype(np.int32).tobytes(), times[along].tobytes(), distinct[~along].tobytes(), times[~along].tobytes()))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.binary()] * 4
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["id", *(f.split()[0] for f in _LINKED.split(", "))])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {_LINKED}")


def pair_counts(linked: DataFrame, same: np.ndarray) -> DataFrame:
    """``(a, b, docs, along)``: in how many documents each id pair is linked, and whether the identity map holds it.

    A task counts pairs along the map in one vector of the vocabulary's length, others by sorting; what
    it hands on is at most that vector and ``HELD_PAIRS`` pairs at a time.
    """

    def run(batches):
        vector = np.zeros(len(same), np.int64)
        codes, counts, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def settled():
            every = np.concatenate([codes, *waiting])
            distinct, at = np.unique(every, return_inverse=True)
            return distinct, np.bincount(at, np.concatenate([counts, np.ones(len(every) - len(codes), np.int64)]), len(distinct)).astype(np.int64)

        def rows(a, b, docs, along):
            return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(docs), pa.array(np.full(len(a), along))], names=["a", "b", "docs", "along"])

        held = 0
        for batch in batches:
            ids, pairs = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("same_ids", "pairs"))
            np.add.at(vector, np.frombuffer(b"".join(ids), np.int32), 1)
            waiting.append(np.frombuffer(b"".join(pairs), np.int64))
            held += len(waiting[-1])
            if held > HELD_PAIRS:
                codes, counts = settled()
                waiting, held = [], 0
                if len(codes) > HELD_PAIRS:
                    yield rows(codes >> _SHIFT, codes & _LOW, counts, False)
                    codes, counts = codes[:0], counts[:0]
        codes, counts = settled()
        yield rows(codes >> _SHIFT, codes & _LOW, counts, False)
        met = np.flatnonzero(vector)
        yield rows(met, same[met], vector[met], True)

    made = linked.select("same_ids", "pairs").mapInArrow(run, "a int, b int, docs long, along boolean")
    return made.groupBy("a", "b", "along").agg(F.sum("docs").alias("docs")).select("a", "b", "docs", "along")


def _hot(pairs: DataFrame, most: int) -> Column:
    """Whether a pair is frequent: counts from the least power of two on that no more than ``most`` pairs reach."""
    sizes = {r["power"]: r["n"] for r in pairs.groupBy(F.floor(F.log2("docs")).alias("power")).agg(F.count("*").alias("n")).collect()}
    least, total = 64, 0
    while least and total + sizes.get(least - 1, 0) <= most:
        least -= 1
        total += sizes.get(least, 0)
    return F.col("docs") >= F.lit(2**least) if least < 63 else F.lit(False)


def cross_tokenizer_alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """One row per document: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256`` and, if asked for, ``groups``.

    A pair's count is the number of documents that hold it linked. ``n_best`` counts the links whose pair
    has its A id's highest count, ties included; ``count_sum`` adds up the counts of all links. Counts of
    pairs along the identity map are two vectors; those of the most frequent other pairs, ``hot_pairs`` at
    most, are broadcast with them, and documents join the rest, in which no pair is frequent. Null and
    empty texts, texts that are not UTF-8 and those whose tokens do not give their bytes back have zeros
    and an empty digest. Repeated rows and null ids are rows of their own and each counts as a document;
    other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "alignment")
    same = Tokenizers(read_file(spark, a_path), read_file(spark, b_path)).same
    linked = scratch.save(aligned(docs, a_path, b_path, id_col, text_col, keep_groups).withColumn("row", F.monotonically_increasing_id()))
    counts = scratch.save(pair_counts(linked, same))
    highest = counts.groupBy("a").agg(F.max("docs").alias("highest"))  # a row per A id at most
    judged = counts.join(F.broadcast(highest), "a").select("a", "b", "docs", "along", (F.col("docs") == F.col("highest")).alias("best"))
    code = F.shiftleft(F.col("a").cast("long"), _SHIFT) + F.col("b")
    others = judged.filter("not along").select(code.alias("code"), "docs", "best")
    frequent = _hot(counts.filter("not along"), hot_pairs)

    along = judged.filter("along").toArrow()
    docs_of, best_of = np.zeros(len(same), np.int64), np.zeros(len(same), bool)
    docs_of[along["a"].to_numpy()], best_of[along["a"].to_numpy()] = along["docs"].to_numpy(), along["best"].to_numpy()
    hot = others.filter(frequent).toArrow()
    order = np.argsort(hot["code"].to_numpy())
    sent = spark.sparkContext.broadcast((docs_of, best_of, *(hot[c].to_numpy()[order] for c in ("code", "docs", "best"))))
    rare = others.filter(~frequent)

    def scores(batches):
        docs_of, best_of, codes, docs, best = sent.value
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("same_ids", "same_links", "pairs", "pair_links")]
            out = []
            for ids, times, pairs, links in zip(*columns, strict=True):
                ids, times, pairs, links = np.frombuffer(ids, np.int32), np.frombuffer(times, np.int32).astype(np.int64), np.frombuffer(pairs, np.int64), np.frombuffer(links, np.int32).astype(np.int64)
                at = _places(codes, pairs)
                known = at >= 0
                at, met = at[known], links[known]
                out.append((int(times @ best_of[ids] + met @ best[at]), int(times @ docs_of[ids] + met @ docs[at])))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in carried), *(pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], [])))], names=[*carried, "n_best", "count_sum"])

    carried = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"]
    kinds = ", ".join(f"{c} {linked.schema[c].dataType.simpleString()}" for c in carried)
    made = linked.mapInArrow(scores, f"{kinds}, n_best long, count_sum long")
    if not rare.isEmpty():

        def left_over(batches):
            codes = sent.value[2]
            for batch in batches:
                for row, pairs, links in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("row", "pairs", "pair_links")), strict=True):
                    pairs, links = np.frombuffer(pairs, np.int64), np.frombuffer(links, np.int32)
                    rest = _places(codes, pairs) < 0
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(rest.sum(), row)), pa.array(pairs[rest]), pa.array(links[rest])], names=["row", "code", "links"])

        each = linked.select("row", "pairs", "pair_links").mapInArrow(left_over, "row long, code long, links int").join(rare, "code")
        more = each.groupBy("row").agg(F.sum(F.col("links") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("links") * F.col("docs")).alias("more_sum"))
        made = made.join(more, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    shown = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] + ["groups"] * keep_groups
    return made.select(F.col("id").alias(id_col), *shown)


def _places(codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted number stands in the sorted codes, -1 where it does not."""
    if not len(codes):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
    return np.where(codes[at] == wanted, at, -1)
