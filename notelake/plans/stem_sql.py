"""SQL twins of the stemmed words: the stemmer's steps as regular expressions over distinct words."""

from __future__ import annotations

from notelake.functions.words import FOURTH, SECOND, THIRD

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: The first vowels of a word: y is one only behind a consonant.
_FIRST = f"({_C}{_V}|[aeiou]+)"
#: Conditions on what stands before an ending: measure above 0, above 1, exactly 1; a vowel; consonant-vowel-consonant at the end.
_ABOVE_0, _ABOVE_1, _ONE = f"^{_FIRST}{_C}", f"^{_FIRST}{_C}{_V}{_C}", f"^{_FIRST}{_C}({_V})?$"
_VOWEL, _SHORT = f"^({_C}[aeiouy]|[aeiou])", "(^|[aeiou])y[aeiou][^aeiouwxy]$|[^aeiouy][aeiouy][^aeiouwxy]$"


def _cut(n: int) -> str:
    return f"left(w, length(w) - {n})"


def _endings(pairs, condition: str) -> str:
    """The longest ending that fits decides; the condition is about what stands before it."""
    arms = [
        f"WHEN ends_with(w, '{end}') THEN CASE WHEN regexp_matches({_cut(len(end))}, '{condition}') THEN {_cut(len(end))} || '{other}' ELSE w END"
        for end, other in sorted(pairs, key=lambda e: -len(e[0]))
    ]
    return f"CASE WHEN NOT stemmed THEN w {' '.join(arms)} ELSE w END"


_STEPS = (
    f"CASE WHEN NOT stemmed THEN w WHEN ends_with(w, 'sses') AND length(w) > 4 THEN {_cut(2)} WHEN ends_with(w, 'ies') AND length(w) > 3 THEN {_cut(2)} WHEN ends_with(w, 'ss') THEN w WHEN ends_with(w, 's') THEN {_cut(1)} ELSE w END",
    f"""CASE WHEN NOT stemmed THEN w WHEN ends_with(w, 'eed') THEN CASE WHEN regexp_matches({_cut(3)}, '{_ABOVE_0}') THEN {_cut(1)} ELSE w END
      WHEN ends_with(w, 'ed') AND regexp_matches({_cut(2)}, '{_VOWEL}') THEN {_cut(2)} || '#' WHEN ends_with(w, 'ing') AND regexp_matches({_cut(3)}, '{_VOWEL}') THEN {_cut(3)} || '#' ELSE w END""",
    f"""CASE WHEN NOT stemmed OR NOT ends_with(w, '#') THEN w WHEN regexp_matches(w, '(at|bl|iz)#$') THEN {_cut(1)} || 'e'
      WHEN regexp_matches(w, '(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|yy)#$') THEN {_cut(2)}
      WHEN regexp_matches({_cut(1)}, '{_ONE}') AND regexp_matches({_cut(1)}, '{_SHORT}') THEN {_cut(1)} || 'e' ELSE {_cut(1)} END""",
    f"CASE WHEN stemmed AND ends_with(w, 'y') AND regexp_matches({_cut(1)}, '{_VOWEL}') THEN {_cut(1)} || 'i' ELSE w END",
    _endings(SECOND, _ABOVE_0),
    _endings(THIRD, _ABOVE_0),
    f"CASE WHEN stemmed AND ends_with(w, 'ion') THEN CASE WHEN regexp_matches(w, '[st]ion$') AND regexp_matches({_cut(3)}, '{_ABOVE_1}') THEN {_cut(3)} ELSE w END ELSE {_endings([(e, '') for e in FOURTH], _ABOVE_1)} END",
    f"CASE WHEN stemmed AND ends_with(w, 'e') AND (regexp_matches({_cut(1)}, '{_ABOVE_1}') OR (regexp_matches({_cut(1)}, '{_ONE}') AND NOT regexp_matches({_cut(1)}, '{_SHORT}'))) THEN {_cut(1)} ELSE w END",
    f"CASE WHEN stemmed AND ends_with(w, 'll') AND regexp_matches({_cut(1)}, '{_ABOVE_1}') THEN {_cut(1)} ELSE w END",
)


def words(text: str) -> str:
    """SQL for the list of folded words of a text."""
    return rf"regexp_extract_all(strip_accents(lower(coalesce({text}, ''))), '[\p{{L}}\p{{N}}\p{{Co}}]+')"


def stems(sources: dict[str, str], name: str = "stems") -> str:
    """Common table expressions up to ``name(token, stem)`` over the words of the text columns ``{table: column}``."""
    every = " UNION ".join(f"SELECT unnest({words(column)}) AS token FROM {table}" for table, column in sources.items())
    made = "SELECT token, token AS w, strlen(token) BETWEEN 3 AND 64 AS stemmed FROM " + f"(SELECT DISTINCT token FROM ({every}))"
    for step in _STEPS:
        made = f"SELECT token, {step} AS w, stemmed FROM ({made})"
    return f"{name} AS MATERIALIZED (SELECT token, w AS stem FROM ({made}))"
