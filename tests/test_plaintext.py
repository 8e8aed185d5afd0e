from __future__ import annotations

import unicodedata

from hypothesis import given
from hypothesis import strategies as st

from strandkg.functions.plaintext import plain_form, readings

CASES = {
    "Ｑíｎｇ１２": "Qíng12",
    "éǎ": "éǎ",
    "a​b­c﻿": "abc",
    "a b　c\td": "a b c d",
    "⻓⻔⽔金": "长门水金",
    "Ⅳ级Ⅱ": "IV级II",
    "ΖΑ37K": "ZA37K",
    "КР56E": "KP56E",
    "стaнция": "станция",
    "３６．５": "36.5",
    "⾭川⻘": "青川青",
    "⼾口": "户口",
    "Shàgúankа\u030cng": "Shàgúankǎng",
    "Та\u0301onyо\u0300u": "Táonyòu",
    "а\u0300b": "àb",
    "стaнци\u0438\u0306": "станций",
    "e\u0301": "é",
}
PLAIN = ["（，。）", "39℃", "m³/s", "α", "станция", "🌊🌧", "a\nb", "", "μm"]


def test_cases():
    assert {k: plain_form(k) for k in CASES} == CASES
    assert [plain_form(x) for x in PLAIN] == PLAIN
    assert plain_form(None) is None


def test_readings_and_choice():
    assert readings("оса1") == []  # one script only
    word = "cоp"  # Latin c and p, Cyrillic о
    assert readings(word) == ["cop", "сор"]
    assert plain_form(word) == "cop"
    assert plain_form(f"({word})", lambda found: found[-1]) == "(сор)"


def test_plain_characters_of_every_radical_block_are_unified():
    """No radical or compatibility character is left, and none becomes a variant that stands in no ordinary text."""
    for c in (*range(0x2F00, 0x2FD6), 0x2ED3, 0x2ED8, *range(0xF900, 0xFA0E)):
        out = plain_form(chr(c))
        assert len(out) == 1 and 0x4E00 <= ord(out) <= 0x9FFF and out not in "靑戶"


@given(st.text(alphabet="aаοoАAΑсcрpxх1Ⅳ\u0300\u0301\u030c\u0306éйάα℃ 青⾭\u200b．３", max_size=12))
def test_idempotent_on_look_alikes(text):
    once = plain_form(text)
    assert plain_form(once) == once and unicodedata.normalize("NFC", once) == once


@given(st.text(max_size=60))
def test_idempotent_and_composed(text):
    once = plain_form(text)
    assert plain_form(once) == once
    assert unicodedata.normalize("NFC", once) == once or unicodedata.normalize("NFC", text) == text
