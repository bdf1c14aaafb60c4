"""Format-preserving pseudonyms for personal numbers, dates and addresses.

A value is recognised by its form, validated (check digits, calendar, ranges) and replaced by another
valid value of the same form: its digits or letters are a number below some bound, and a keyed
Feistel network with cycle walking permutes the numbers below that bound. Equal values of one kind
get equal pseudonyms in every document, different values different ones, and the key turns them back.
"""

from __future__ import annotations

import hashlib
import re
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_FIRST_DAY = date(1900, 1, 1).toordinal()
_DAYS = date(2100, 1, 1).toordinal() - _FIRST_DAY

#: Fixed forms. Each alternative is one kind; those that need it are validated below.
_FORMS = re.compile(
    r"""(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?=@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}))
      | (?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
      | (?P<date>(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})(?![0-9]|[./-][0-9]))
      | (?P<ip>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))
      | (?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9]))
      | (?P<card>(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]))
      | (?P<phone>(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9]))""",
    re.X,
)


class Permutation:
    """Keyed permutations of the numbers below a bound, one for each kind of value and bound."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, kind: str, bound: int, turn: int, half: int, bits: int) -> int:
        seed = f"{kind}|{bound}|{turn}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(seed, key=self.key, digest_size=32).digest(), "big") & ((1 << bits) - 1)

    def apply(self, kind: str, value: int, bound: int, back: bool = False) -> int:
        bits = max(1, ((bound - 1).bit_length() + 1) // 2)
        mask = (1 << bits) - 1
        while True:
            left, right = value >> bits, value & mask
            if back:
                for turn in reversed(range(ROUNDS)):
                    left, right = right ^ self._round(kind, bound, turn, left, bits), left
            else:
                for turn in range(ROUNDS):
                    left, right = right, left ^ self._round(kind, bound, turn, right, bits)
            value = left << bits | right
            if value < bound:
                return value


def _luhn_sum(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total


def luhn(digits: str) -> bool:
    return _luhn_sum(digits) % 10 == 0


def _refill(form: str, digits: str) -> str:
    """The form with its ASCII digits replaced in order."""
    left = iter(digits)
    return "".join(next(left) if "0" <= c <= "9" else c for c in form)


def _digits(form: str) -> str:
    return "".join(c for c in form if "0" <= c <= "9")


def _card(form: str, p: Permutation, back: bool) -> str | None:
    digits = _digits(form)
    if not luhn(digits) or len(set(digits)) == 1:
        return None
    shifted = _luhn_sum(digits + "0") % 10
    made, size = digits, len(digits) - 2
    # The sum with places shifted stays too: a longer run of digits around a card is as valid as before.
    while True:
        body = digits[0] + str(p.apply("card", int(made[1:-1]), 10**size, back)).zfill(size)
        made = next(body + c for c in "0123456789" if luhn(body + c))
        if _luhn_sum(made + "0") % 10 == shifted:
            return _refill(form, made)


def _iban(form: str, p: Permutation, back: bool) -> str | None:
    plain = form.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    account = _digits(plain[4:])
    if not account:
        return None
    tail = _refill(plain[4:], str(p.apply("iban" + plain[:2], int(account), 10 ** len(account), back)).zfill(len(account)))
    check = 98 - number(tail + plain[:2] + "00") % 97
    made = iter(plain[:2] + f"{check:02d}" + tail)
    return "".join(" " if c == " " else next(made) for c in form)


def _date(form: str, p: Permutation, back: bool) -> str | None:
    """Year first, else day first, else month first: the first reading that is a calendar day."""
    parts = list(map(int, re.split("[-/.]", form)))
    for order in ((0, 1, 2),) if form[4] == "-" else ((2, 1, 0), (2, 0, 1)):
        try:
            day = date(*(parts[i] for i in order)).toordinal() - _FIRST_DAY
        except ValueError:
            continue
        if not 0 <= day < _DAYS:
            return None
        # Readings that the pseudonym itself would be read by otherwise are walked over.
        while True:
            day = p.apply(f"date{form[4] == '-'}{order}", day, _DAYS, back)
            made = date.fromordinal(day + _FIRST_DAY)
            fields = dict(zip(order, (f"{made.year:04d}", f"{made.month:02d}", f"{made.day:02d}"), strict=True))
            if order != (2, 0, 1) or made.day > 12:
                break
        return re.sub("[0-9]+", lambda m, f=iter((fields[0], fields[1], fields[2])): next(f), form)
    return None


def _ip(form: str, p: Permutation, back: bool) -> str | None:
    parts = list(map(int, form.split(".")))
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in form.split(".")):
        return None
    value = p.apply("ip", int.from_bytes(bytes(parts), "big"), 1 << 32, back)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _ssn(form: str, p: Permutation, back: bool) -> str | None:
    area, group, serial = map(int, form.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    value, serial = divmod(p.apply("ssn", value, 898 * 99 * 9999, back), 9999)
    area, group = divmod(value, 99)
    area += 1
    return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(form: str, p: Permutation, back: bool) -> str | None:
    digits = _digits(form)
    head, body = digits[:-10], digits[-10:]
    return _refill(form, head + str(p.apply("phone" + head, int(body), 10**10, back)).zfill(10))


def _email(form: str, p: Permutation, back: bool) -> str | None:
    """Lower-case letters, capitals and digits each keep their places."""
    made = list(form)
    for first, size in (("a", 26), ("A", 26), ("0", 10)):
        at = [i for i, c in enumerate(form) if first <= c < chr(ord(first) + size)]
        if at:
            value = 0
            for i in at:
                value = value * size + ord(form[i]) - ord(first)
            value = p.apply("email" + first, value, size ** len(at), back)
            for i in reversed(at):
                value, d = divmod(value, size)
                made[i] = chr(ord(first) + d)
    return "".join(made)


_KINDS = {"email": _email, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "card": _card, "phone": _phone}
#: What scanning goes on behind when no end of a card or IBAN form is valid.
_FIRST_GROUP = re.compile("[A-Za-z0-9]+")
#: Characters of an IBAN without spaces, by country.
_IBAN_SIZES = {
    country: size
    for size, countries in {
        15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
_MAY_HOLD = re.compile("[0-9@]")


def _ends(kind: str, form: str) -> list[int]:
    """Ends of the values that may start a form, in the order in which they are tried.

    A card ends behind 19 to 13 digits, the longest first; an IBAN at its country's length, else with
    the form. Shorter ones end where a space or dash follows.
    """
    if kind not in ("card", "iban"):
        return [len(form)]
    places = [i + 1 for i, c in enumerate(form) if c not in " -"]
    sizes = range(19, 12, -1) if kind == "card" else [_IBAN_SIZES.get(form[:2], 0)]
    shorter = [places[n - 1] for n in sizes if 0 < n < len(places) and form[places[n - 1]] in " -"]
    return [len(form), *shorter] if kind == "card" else [*shorter, len(form)]


def _find(text: str, at: int, permutation: Permutation, back: bool) -> tuple[str, int, int, str, bool] | None:
    """Kind, start, end and pseudonym of the next value, and whether a form failed before it was found."""
    failed = False
    while match := _FORMS.search(text, at):
        kind, start = match.lastgroup, match.start()
        for end in _ends(kind, match[0]):
            made = _KINDS[kind](match[0][:end], permutation, back)
            if made is not None:
                return kind, start, start + end, made, failed
            failed = True
        at = start + _FIRST_GROUP.match(match[0]).end() if kind in ("card", "iban") else match.end()
    return None


def pseudonymise(text: str, permutation: Permutation, back: bool = False) -> tuple[str, list[str]]:
    """The text with its values replaced (or turned back) and the kinds replaced, in order."""
    kinds: list[str] = []
    if not _MAY_HOLD.search(text):
        return text, kinds

    parts, at = [], 0
    while found := _find(text, at, permutation, back):
        kind, start, end, made, unsure = found
        lead = max(0, at - 1)
        # Beside a failed form the pseudonym could be read otherwise; such values are walked over.
        while unsure:
            again = _find(text[lead:start] + made + text[end:], at - lead, permutation, back)
            if again and again[:3] == (kind, start - lead, start - lead + len(made)):
                break
            made = _KINDS[kind](made, permutation, back)
        kinds.append(kind)
        parts += [text[at:start], made]
        at = end
    return "".join([*parts, text[at:]]), kinds


def _run(key: bytes, back: bool):
    def run(batches):
        permutation = Permutation(key)
        for batch in batches:
            texts, kinds = [], []
            for text in batch.column(1).to_pylist():
                made, found = (None, []) if text is None else pseudonymise(text, permutation, back)
                texts.append(made)
                kinds.append(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in kinds], pa.int64()), pa.array(kinds, pa.list_(pa.string())), pa.array(texts, pa.string())],
                names=["id", "n_replaced", "kinds", "text"],
            )

    return run


def with_pseudonyms(docs: DataFrame, key: bytes, back: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_replaced``, ``kinds`` and ``text`` with pseudonyms.

    Kinds: email (local part), iban, date, ip, ssn, card, phone. With ``back`` pseudonyms made with
    the same key are turned back. A null text stays null with nothing replaced; an empty one stays
    empty. Repeated rows and ids are rows of their own; other columns are ignored; no shuffle is used.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(_run(key, back), f"id {kind}, n_replaced bigint, kinds array<string>, text string")
    return made.withColumnRenamed("id", id_col)
