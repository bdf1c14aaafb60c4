"""Vectorised work on the bytes of a text: words, their fingerprints, shingles, windows.

All functions take one text as ``bytes`` and run inside tasks on rows that Spark has dealt out.
Fingerprints are polynomial hashes modulo 2**64 over mixed byte values, finished with a bijective
mixer, so any span of a text has its fingerprint from two prefix sums. Such hashes collide by
construction on long periodic strings, so words of more than ``LONG`` bytes are named by a digest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a word up to which its fingerprint is the polynomial one.
LONG = 64
_BASE = 0x9E3779B97F4A7C15
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
_power = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse; tables grow on demand."""
    global _power, _inverse
    if len(_power) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("_power", _BASE), ("_inverse", pow(_BASE, -1, 1 << 64))):
            table = np.full(size, np.uint64(base))
            table[0] = 1
            globals()[name] = np.cumprod(table, dtype=np.uint64)
    return _power[:n], _inverse[:n]


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of byte codes times powers; entry i covers the first i bytes."""
    power, _ = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[codes] * power[: len(codes)], out=sums[1:])
    return sums


def span_prints(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of the spans [start, end)."""
    _, inverse = powers(len(sums))
    length = (ends - starts).astype(np.uint64)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + length * np.uint64(_BASE))


def word_spans(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``."""
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = ~_SEPARATOR[codes]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _prints_of_words(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of the words [start, end); those of long words are digests of their bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    prints = span_prints(prefix_sums(codes), starts, ends)
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        prints[i] = int.from_bytes(hashlib.blake2b(codes[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return prints


def word_prints(text: bytes) -> np.ndarray:
    """One fingerprint for each word of the text, A-Z lower-cased."""
    codes = _LOWER[np.frombuffer(text, np.uint8)]
    return _prints_of_words(codes, *word_spans(codes))


def joined_word_prints(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words of all texts in order, and the number of words before each text and in all."""
    codes = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    starts, ends = word_spans(codes)
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    before = np.searchsorted(starts, at)
    return _prints_of_words(codes, starts, ends), before


def run_prints(values: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of all runs of ``n`` values, from prefix sums; none if there are fewer."""
    power, inverse = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[:-1], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * inverse[: max(0, len(values) + 1 - n)])


def sequence_prints(words: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of all runs of ``n`` words, in order; shorter texts give their whole sequence."""
    if not len(words):
        return words
    n = min(n, len(words))
    total = np.full(len(words) - n + 1, np.uint64(n), np.uint64)
    for i in range(n):
        total = mix(total * np.uint64(_BASE) + words[i : len(words) - n + 1 + i])
    return total


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Sorted fingerprints of the distinct ``n``-word shingles of the text."""
    return np.unique(sequence_prints(word_prints(text), n))


def small_parts(batch: pa.RecordBatch, column: int, size: int) -> list[pa.RecordBatch]:
    """The batch in parts of about ``size`` bytes in that column; a longer text is a part of its own."""
    at = np.cumsum(np.append(0, pc.binary_length(batch.column(column)).fill_null(0).to_numpy())) // size
    cuts = [0, *(np.flatnonzero(np.diff(at[:-1])) + 1).tolist(), batch.num_rows]
    return [batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
