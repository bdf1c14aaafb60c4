"""Spans of words that are pieces of a byte-level vocabulary, found for many words at a time.

All functions run inside tasks on words that Spark has dealt out. A span is told by a polynomial hash
of its bytes and confirmed by its two parts, which are confirmed spans themselves, so no hash decides.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa

#: Bytes of a word whose places are the bits of one number.
MASKED = 62
#: Words whose spans are looked up at a time.
WORDS = 4096
_SLOTS = 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1
#: A merge as bits for places: those from the start to the end of its span; of these the three where its two parts start and end; the one between them.
MERGES = "array<struct<span:bigint,parts:bigint,cut:bigint>>"


def _merged(word: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """The pieces of a word once all merges of a rank under ``below`` have taken place, lowest and leftmost first."""
    pieces = [word[i : i + 1] for i in range(len(word))]
    while len(pieces) > 1:
        least, at = min((ranks.get(a + b, below), i) for i, (a, b) in enumerate(pairwise(pieces)))
        if least >= below:
            break
        pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
    return pieces


class Vocabulary:
    """The pieces of a vocabulary in order of rank.

    ``ordered`` tells that all bytes are pieces and each longer piece is two pieces once all merges of lower rank
    have taken place in it alone, as in vocabularies that were learnt merge by merge. Then a merge of lower rank
    cannot come up behind one of higher rank, as its span would have been these two pieces before, and merged:
    merges take place in ascending order of rank, and one pass over the spans in this order finds them all.
    """

    def __init__(self, ranks: dict[bytes, int]):
        pieces = sorted(ranks, key=ranks.get)
        parts = [_merged(p, ranks, ranks[p]) if len(p) > 1 else [p] for p in pieces]
        self.ordered = all(bytes([b]) in ranks for b in range(256)) and all(len(x) == min(2, len(p)) for p, x in zip(pieces, parts, strict=True))
        if not self.ordered:
            return
        number = {p: i for i, p in enumerate(pieces)}
        self.ids = np.array([ranks[p] for p in pieces], np.uint32)
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.split, self.left, self.right = (np.array([f(x) for x in parts], np.int64) for f in (lambda x: len(x[0]), lambda x: number[x[0]], lambda x: number[x[-1]]))
        self.single = np.array([number[bytes([b])] for b in range(256)], np.int32)
        self.longest = min(MASKED, int(self.size.max()))
        known: dict[int, int] = {}
        for i, piece in enumerate(pieces):
            h = 0
            for n, b in enumerate(piece[:MASKED], 1):
                h = (h * int(_BASE) + b + 1) & _MASK
                if n == len(piece):
                    known[h] = i
                elif n > 1:
                    known.setdefault(h, -1)
        keys = np.array(list(known), np.uint64)
        slots = self._slot(keys)
        order = np.argsort(slots, kind="stable")
        self.keys, self.numbers = keys[order], np.array(list(known.values()), np.int32)[order]
        self.begin = np.searchsorted(slots[order], np.arange((1 << _SLOTS) + 1)).astype(np.int32)
        self.most = int(np.diff(self.begin).max(initial=0))

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (((h ^ (h >> np.uint64(29))) * _BASE) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Of each hash the piece, -1 if longer pieces only begin so, -2 if none does."""
        slot = self._slot(h)
        at, end = self.begin[slot], self.begin[slot + 1]
        made = np.full(len(h), -2, np.int32)
        left = np.flatnonzero(at < end)
        for _ in range(self.most):
            e = at[left]
            hit = self.keys[e] == h[left]
            made[left[hit]] = self.numbers[e[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
            if not len(left):
                break
        return made

    def _spans(self, words: list[bytes]):
        """Numbers of the pieces by size and first byte, -1 for none, and places and numbers of those of two bytes at least."""
        codes = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.repeat(np.cumsum(sizes), sizes)
        table = np.full((min(self.longest, int(sizes.max(initial=1))) + 1, len(codes)), -1, np.int32)
        table[1] = self.single[codes]
        values = codes.astype(np.uint64) + np.uint64(1)
        at, h, found = np.arange(len(codes)), values, []
        for size in range(2, len(table)):
            inside = at + size <= ends[at]
            at = at[inside]
            h = h[inside] * _BASE + values[at + size - 1]
            got = self._find(h)
            going, piece = got > -2, got >= 0
            here, x = at[piece], got[piece]
            cut = self.split[x]
            good = self.size[x] == size
            here, x, cut = here[good], x[good], cut[good]
            good = (table[cut, here] == self.left[x]) & (table[size - cut, here + cut] == self.right[x])
            table[size, here[good]] = x[good]
            found.append((here[good], x[good]))
            at, h = at[going], h[going]
            if not len(at):
                break
        places, numbers = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
        return sizes, table, places, numbers.astype(np.int64)

    def merges(self, words: list[str | None]) -> pa.Array:
        """The merges that each word can take, in ascending order of rank and place; null for words that are not folded over them."""
        coded = [w.encode() if w else b"" for w in words]
        taken = [i for i, w in enumerate(coded) if 0 < len(w) <= MASKED] if self.ordered else []
        counts, parts = np.zeros(len(words), np.int64), []
        for some in (taken[i : i + WORDS] for i in range(0, len(taken), WORDS)):
            sizes, _, places, numbers = self._spans([coded[i] for i in some])
            starts = np.cumsum(sizes) - sizes
            word = np.searchsorted(starts, places, side="right") - 1
            key = np.sort((word << 38) | (numbers << 6) | (places - starts[word]))
            counts[some] = np.bincount(key >> 38, minlength=len(some))
            parts.append(((key >> 6) & 0xFFFFFFFF, key & 63))
        x, i = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))
        one = np.int64(1)
        last, cut = one << (i + self.size[x]) if len(x) else x, one << (i + self.split[x]) if len(x) else x
        first = one << i
        fields = [pa.array(c) for c in ((last - first) | last, first | last | cut, cut)]
        null = np.ones(len(words) + 1, bool)
        null[taken] = False
        offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32), mask=np.append(null[:-1], False))
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, names=["span", "parts", "cut"]))

    def cut(self, words: list[bytes], cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order and the number of each, from the bits for the places where pieces start or end."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for a in range(0, len(words), WORDS):
            sizes, table, _, _ = self._spans(words[a : a + WORDS])
            starts = np.cumsum(sizes) - sizes
            within = np.arange(sizes.sum()) - np.repeat(starts, sizes)
            bits = (np.repeat(cuts[a : a + WORDS], sizes) >> within) & 1
            at = np.flatnonzero(bits)
            ids.append(self.ids[table[np.diff(np.append(at, len(bits))), at]])
            counts.append(np.add.reduceat(bits, starts))
        return np.concatenate(ids), np.concatenate(counts)
