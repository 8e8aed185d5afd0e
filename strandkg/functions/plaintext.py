"""One plain written form for strings that print alike.

Letters and digits become half width, accented letters single composed characters, Chinese characters their unified
code, grades Latin letters; invisible characters go, other spaces become U+0020, and the letters of a word that mixes
scripts are brought to one script where look-alikes allow it. Full-width Chinese punctuation, symbols such as U+2103 or
U+00B3, single Greek letters, words wholly in one script and emoji stay as they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

# CJK radicals supplement to unified ideographs (Unicode EquivalentUnifiedIdeograph), the ones in use as characters.
RADICALS = dict(
    zip(
        "⺁⺄⺆⺈⺊⺋⺌⺎⺏⺒⺓⺔⺖⺗⺘⺙⺛⺝⺞⺟⺠⺡⺢⺣⺤⺥⺨⺩⺫⺬⺭⺮⺯⺰⺱⺲⺳⺵⺶⺷⺸⺹⺺⺼⺽⺾⺿⻀⻁⻂⻃⻄⻅⻆⻇⻈⻉⻊⻋⻌⻍⻎⻏⻐⻑⻒⻓⻔⻖⻗⻘⻙⻚⻛⻜⻝⻟⻠⻡⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻲⻳",
        "厂乙冂刂卜㔾小兀尣巳幺彑忄㣺扌攵旡月歺母民氵氺灬爫爫犭王罒示礻竹糸纟罓罒㓁罓羊羊羊耂耂月臼艹艹艹虎衤覀西见角𧢲讠贝足车辶辶辶阝钅長镸长门阝雨青韦页风飞食飠𩙿饣马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龜亀龟",
        strict=True,
    )
)

# Radicals whose decomposition is a variant form out of ordinary use, to the ordinary character.
VARIANT_RADICALS = {0x2F3E: "户", 0x2FAD: "青"}

# Letters of other scripts that print like a Latin letter.
GREEK_LATIN = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναιρυκχγ", "ABEZHIKMNOPTYXovaipukxy", strict=True))
CYRILLIC_LATIN = dict(zip("АВЕКМНОРСТУХІЈЅаеорсухіјѕһԁԛԝ", "ABEKMHOPCTYXIJSaeopcyxijshdqw", strict=True))

INVISIBLE = [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0x3164, 0xFEFF, 0xFFA0]
SPACES = [0x09, 0x0B, 0x0C, 0x0D, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTROLS = [c for c in [*range(0x20), *range(0x7F, 0xA0)] if c not in SPACES and c != 0x0A]


def _table() -> dict[int, str]:
    out = {c: "" for c in [*INVISIBLE, *CONTROLS]} | {c: " " for c in SPACES}
    widths = [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]
    forms = [*range(0x2160, 0x2180), *range(0x2F00, 0x2FD6), *range(0xF900, 0xFB00), *range(0xFB00, 0xFB07), *range(0x1D400, 0x1D800), *range(0x2F800, 0x2FA20), 0x2E9F, 0x2EF3, 0x212A, 0x212B]
    for c in [*widths, *forms]:
        if (to := unicodedata.normalize("NFKC", chr(c))) != chr(c):
            out[c] = to
    return out | {ord(k): v for k, v in RADICALS.items()} | VARIANT_RADICALS


TABLE = _table()
# The characters of which a string that isn't plain has one at least: wider than TABLE, never narrower.
_RANGES = [(0x00, 0x09), (0x0B, 0x1F), (0x7F, 0xA0), (0xAD, 0xAD), (0x300, 0x52F), (0x61C, 0x61C), (0x115F, 0x1160), (0x1680, 0x1680), (0x17B4, 0x17B5), (0x180E, 0x180E), (0x2000, 0x200F), (0x2028, 0x202F), (0x205F, 0x206F), (0x2126, 0x2126), (0x212A, 0x212B), (0x2160, 0x217F), (0x2E80, 0x2FD5), (0x3000, 0x3000), (0x3099, 0x309A), (0x3164, 0x3164), (0xF900, 0xFB06), (0xFEFF, 0xFEFF), (0xFF0E, 0xFF0E), (0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A), (0xFFA0, 0xFFA0), (0x1D400, 0x1D7FF), (0x2F800, 0x2FA1F)]
#: As a regular expression that Python and Java read alike.
SUSPECT = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _RANGES) + "]"
_suspect = re.compile(SUSPECT).search
_full_stop = re.compile("(?<=[0-9])．(?=[0-9])")
#: A word: letters and figures, with the combining marks that follow them.
WORD = re.compile(r"(?:[0-9A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02af\u0370-\u03ff\u0400-\u052f\u1e00-\u1eff][\u0300-\u036f]*)+")
foreign = re.compile(r"[\u0370-\u03ff\u0400-\u052f]").search


def script(letter: str) -> str | None:
    """``latin``, ``greek``, ``cyrillic``, or None for what is no letter of these."""
    c = ord(letter)
    if 0x370 <= c <= 0x3FF:
        return "greek"
    if 0x400 <= c <= 0x52F:
        return "cyrillic"
    return "latin" if letter.isalpha() and c < 0x1F00 else None


_to_latin = GREEK_LATIN | CYRILLIC_LATIN
_from_latin = {"greek": {v: k for k, v in GREEK_LATIN.items()}, "cyrillic": {v: k for k, v in CYRILLIC_LATIN.items()}}


def _in_script(word: str, target: str) -> str | None:
    """``word``, decomposed, with each look-alike of another script replaced, or None where a letter has none in ``target``; composed."""
    out = []
    for ch in word:
        if (s := script(ch)) is None or s == target:
            out.append(ch)
            continue
        latin = ch if s == "latin" else _to_latin.get(ch)
        to = latin if target == "latin" else _from_latin[target].get(latin)
        if to is None:
            return None
        out.append(to)
    return unicodedata.normalize("NFC", "".join(out))


def readings(word: str) -> list[str]:
    """The one-script readings of a word that mixes scripts, best first; empty for any other word.

    A word with digits is an identifier and reads as Latin first; any other reads in its most frequent script first, ties
    as Latin. Latin is always tried, as a word of Greek and Cyrillic look-alikes is most likely a Latin one. Two letters
    of which one is a small Greek letter are a symbol with an index, not a disguised word. Accents stay with their letter.
    """
    word = unicodedata.normalize("NFD", word)
    letters = [s for ch in word if (s := script(ch))]
    present = set(letters)
    if len(present) < 2 or len(letters) < 3 and any(script(ch) == "greek" and ch.islower() for ch in word):
        return []
    digits = any(ch.isdigit() for ch in word)
    order = sorted({*present, "latin"}, key=lambda s: (-(s == "latin" and digits), -letters.count(s), s != "latin", s))
    return [x for s in order if (x := _in_script(word, s)) is not None]


def plain_form(text: str | None, choose: Callable[[list[str]], str] | None = None) -> str | None:
    """The plain form of ``text``; None stays None.

    ``choose`` picks one of the one-script readings of a mixed word; without it the first is taken.
    """
    if not text or not _suspect(text):
        return text
    text = unrepaired(text)
    if not foreign(text):
        return text
    return WORD.sub(lambda m: m[0] if not (found := readings(m[0])) else choose(found) if choose else found[0], text)


def unrepaired(text: str) -> str:
    """All steps of the plain form but the last, which brings words to one script."""
    return unicodedata.normalize("NFC", _full_stop.sub(".", text.translate(TABLE))) if _suspect(text) else text
