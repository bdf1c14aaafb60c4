"""Words of a text for lexical search: Unicode letters and digits without diacritics, and their stems."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Combining marks, which are dropped, and what separates words.
_MARKS = "".join(map(chr, range(0x300, 0x370)))
_BETWEEN = r"[^\p{L}\p{N}\p{Co}]+"
#: A word with the marks it may hold, for counting words without cutting the text.
_WORD = r"[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\x{300}-\x{36f}]*"


def _plain_letters() -> tuple[str, str]:
    """Small letters with marks and, at the same places, the letters they are without them."""
    marked, plain = [], []
    for c in map(chr, range(0xC0, 0x2000)):
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and c == c.lower() and base.isalpha() and all(unicodedata.category(m) == "Mn" for m in marks):
            marked.append(c)
            plain.append(base)
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _plain_letters()


def folded(column: Column) -> Column:
    """Lower-cased text without diacritics."""
    return F.translate(F.lower(F.coalesce(column.cast("string"), F.lit(""))), _MARKED + _MARKS, _PLAIN)


def words(column: Column) -> Column:
    """Runs of letters, digits and private-use characters, folded; none in a null text."""
    return F.array_remove(F.split(folded(column), _BETWEEN), "")


def word_count(column: Column) -> Column:
    """How many ``words`` a text has, without building them."""
    return F.regexp_count(F.coalesce(column.cast("string"), F.lit("")), F.lit(_WORD))


#: Endings of the Porter stemmer by step, each with what replaces it.
PLURALS = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
SECOND = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
THIRD = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
SHORTEST, LONGEST = 3, 64


def _shape(part: str) -> str:
    """v for each vowel, c for each consonant; y is a vowel behind a consonant."""
    shape = ""
    for letter in part:
        shape += "v" if letter in "aeiou" or (letter == "y" and shape.endswith("c")) else "c"
    return shape


def _measure(part: str) -> int:
    return len(re.findall("v+c", _shape(part)))


def _short_end(part: str) -> bool:
    """Consonant, vowel, consonant other than w, x or y."""
    return _shape(part).endswith("cvc") and part[-1] not in "wxy"


def _replaced(word: str, endings: tuple[tuple[str, str], ...], allowed: Callable[[str], bool]) -> str:
    """The longest ending that fits is replaced if what stands before it is allowed."""
    for end, other in sorted(endings, key=lambda e: -len(e[0])):
        if word.endswith(end) and word != end:
            before = word[: len(word) - len(end)]
            return before + other if allowed(before) else word
    return word


def _without_tense(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    end = next((e for e in ("ed", "ing") if word.endswith(e)), None)
    if end is None or "v" not in _shape(word[: -len(end)]):
        return word
    word = word[: -len(end)]
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if len(word) > 1 and word[-1] == word[-2] and word[-1] in "bcdfghjkmnpqrtvwxy":
        return word[:-1]
    return word + "e" if _measure(word) == 1 and _short_end(word) else word


def porter(word: str) -> str:
    """The Porter stem of a folded word; words of fewer than 3 letters or more than 64 bytes stay."""
    if len(word.encode()) > LONGEST or len(word.encode()) < SHORTEST:
        return word
    word = _replaced(word, PLURALS, lambda before: True)
    word = _without_tense(word)
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(word, SECOND, lambda before: _measure(before) > 0)
    word = _replaced(word, THIRD, lambda before: _measure(before) > 0)
    word = _without_fourth(word)
    if word.endswith("e"):
        before = word[:-1]
        if _measure(before) > 1 or (_measure(before) == 1 and not _short_end(before)):
            word = before
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def _without_fourth(word: str) -> str:
    if word.endswith("ion"):
        before = word[:-3]
        return before if before.endswith(("s", "t")) and _measure(before) > 1 else word
    return _replaced(word, tuple((e, "") for e in FOURTH), lambda before: _measure(before) > 1)


#: Words that a worker remembers in each of two generations, about: those met since the last change, and those before it.
MEMORY = 100_000
_known: dict[str, str] = {}
_before: dict[str, str] = {}


def stem_dictionary(dictionary: pa.Array) -> list[str]:
    """The stems of distinct words, remembered by the worker; words that go on occurring stay remembered."""
    global _known, _before
    made = []
    for word in dictionary.to_pylist():
        stem = _known.get(word)
        if stem is None:
            stem = _before.get(word)
            if len(_known) >= MEMORY:
                _known, _before = {}, _known
            stem = _known[word] = porter(word) if stem is None else stem
        made.append(stem)
    return made


def _stems_of(tokens: pa.Array) -> pa.Array:
    """Stems of lists of words: each distinct word of a batch is looked up once."""
    coded = tokens.flatten().dictionary_encode()
    flat = pa.array(stem_dictionary(coded.dictionary), pa.string()).take(coded.indices)
    sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    del coded
    pa.default_memory_pool().release_unused()  # what a batch of long texts took is not kept by each worker
    return pa.ListArray.from_arrays(pa.array([0, *sizes.cumsum().tolist()], pa.int32()), flat)


def stems(tokens: Column) -> Column:
    """The stems of an array of words, in order.

    Runs on Arrow batches in the task that holds the words: each distinct word of a batch is stemmed
    once and remembered by the worker, so no words are shuffled for it.
    """
    return F.arrow_udf(_stems_of, "array<string>")(tokens)


def stem_tokens(column: Column) -> Column:
    """Stemmed words of a text, in order."""
    return stems(words(column)).alias("stems")
