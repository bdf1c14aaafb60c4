"""Values that are followed or preceded by other digits or capitals."""

import random

import pytest

from notelake.llm import pseudonyms

P = pseudonyms.Permutation(b"k")


@pytest.mark.parametrize(
    ("text", "kept", "kinds"),
    [
        ("4111111111111111 123", " 123", ["card"]),
        ("4111 1111 1111 1111 12/27", " 12/27", ["card"]),
        ("4111-1111-1111-1111-123", "-123", ["card"]),
        ("ES9121000418450200051332 EUR", " EUR", ["iban"]),
        ("DE89 3704 0044 0532 0130 00 EUR", " EUR", ["iban"]),
        ("2024 4111 1111 1111 1111", "", ["card"]),
        ("4111111111111112 4111111111111111", "", ["card"]),
    ],
)
def test_value_is_replaced_and_the_rest_kept(text, kept, kinds):
    made, found = pseudonyms.pseudonymise(text, P)
    assert found == kinds and made != text and made.endswith(kept) and len(made) == len(text)
    assert pseudonyms.pseudonymise(made, P, back=True)[0] == text


def test_turns_back_beside_other_numbers():
    rng = random.Random(4)
    shown = 0
    for _ in range(400):
        body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        card = next(body + c for c in "0123456789" if pseudonyms.luhn(body + c))
        if rng.random() < 0.5:
            card = " ".join(card[i : i + 4] for i in range(0, 16, 4))
        text = f"{rng.choice(['', '2024 ', '77 '])}{card} {rng.choice(['123', '12/27', '7 of 9'])}"
        made, kinds = pseudonyms.pseudonymise(text, P)
        shown += card in made
        assert len(kinds) == 1 and pseudonyms.pseudonymise(made, P, back=True)[0] == text
    # A longer or earlier reading of the digits that is valid itself is taken instead; the card never stays whole.
    assert shown == 0


def test_equal_cards_get_equal_pseudonyms_whatever_follows():
    made = {pseudonyms.pseudonymise("4111111111111111" + rest, P)[0][:16] for rest in ("", " 123", " 12/27", " 9")}
    assert len(made) == 1
