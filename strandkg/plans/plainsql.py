"""SQL of the plain form and of tolerant JSON reading, for the queries' own SQL. It shares no rule with the operators: only letters that are fixed values are spelled out from the same tables."""

from __future__ import annotations

import unicodedata

from strandkg.functions.plaintext import CYRILLIC_LATIN, GREEK_LATIN, RADICALS

_N = iter(range(10**9))


def let(value: str, body: str) -> str:
    """``body`` with ``{v}`` standing for ``value``, computed once."""
    name = f"v{next(_N)}"
    return f"list_transform([{value}], lambda {name}: {body.replace('{v}', name)})[1]"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SPACES = "".join(map(chr, (0x09, 0x0D, 0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
_GONE = "".join(map(chr, (0xAD, *range(0x200B, 0x2010), *range(0x2060, 0x2065), 0xFEFF)))
_WIDE = "".join(map(chr, (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B))))
_CJK = "".join(chr(c) for c in (*range(0x2F00, 0x2FD6), *range(0xF900, 0xFA0E)) if c not in (0x2F3E, 0x2FAD)) + "".join(RADICALS)
_CJK_TO = "".join(RADICALS.get(ch) or unicodedata.normalize("NFKC", ch) for ch in _CJK)
_FROM = _SPACES + _WIDE + _CJK + "⼾⾭" + _GONE  # characters beyond those in _TO are removed
_TO = " " * len(_SPACES) + "".join(chr(ord(ch) - 0xFEE0) for ch in _WIDE) + _CJK_TO + "户青"
_GRADES = [("Ⅷ", "VIII"), ("Ⅶ", "VII"), ("Ⅵ", "VI"), ("Ⅸ", "IX"), ("Ⅳ", "IV"), ("Ⅲ", "III"), ("Ⅱ", "II"), ("Ⅰ", "I"), ("Ⅴ", "V"), ("Ⅹ", "X")]
_LATIN, _GREEK, _CYRILLIC = "A-Za-z\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{2af}\\x{1e00}-\\x{1eff}", "\\x{370}-\\x{3ff}", "\\x{400}-\\x{52f}"
_WORD = f"0-9{_LATIN}{_GREEK}{_CYRILLIC}\\x{{300}}-\\x{{36f}}"
_greek = dict(GREEK_LATIN.items())
_cyrillic = dict(CYRILLIC_LATIN.items())


def _mapped(word: str, table: dict[str, str]) -> str:
    return f"translate({word}, {_quoted(''.join(table))}, {_quoted(''.join(table.values()))})"


def _one_script(w: str) -> str:
    """A word brought to one script: identifiers and words of mostly Latin letters to Latin, others to the script of most of their letters, Latin where that can't be."""
    n = lambda letters: f"length(regexp_replace({w}, '[^{letters}]', '', 'g'))"
    latin = _mapped(_mapped(w, _greek), _cyrillic)
    back_c, back_g = {v: k for k, v in _cyrillic.items()}, {v: k for k, v in _greek.items()}
    cyrillic, greek = _mapped(_mapped(w, _greek), back_c), _mapped(_mapped(w, _cyrillic), back_g)
    only = lambda text, others: f"not regexp_matches({text}, '[{others}]')"
    is_latin, is_cyrillic, is_greek = only(latin, _GREEK + _CYRILLIC), only(cyrillic, _LATIN + _GREEK), only(greek, _LATIN + _CYRILLIC)
    la, gr, cy = n(_LATIN), n(_GREEK), n(_CYRILLIC)
    return f"""case when (({la} > 0)::int + ({gr} > 0)::int + ({cy} > 0)::int) < 2 or ({la} + {gr} + {cy} < 3 and regexp_matches({w}, '[\\x{{3b1}}-\\x{{3c9}}]')) then {w}
      when (regexp_matches({w}, '[0-9]') or ({la} >= {gr} and {la} >= {cy})) and {is_latin} then {latin}
      when {cy} >= {gr} and {cy} > 0 and {is_cyrillic} then {cyrillic}
      when {gr} > {cy} and {is_greek} then {greek}
      when {is_latin} then {latin} when {cy} > 0 and {is_cyrillic} then {cyrillic} when {gr} > 0 and {is_greek} then {greek} else {w} end"""


def plain(text: str) -> str:
    """The plain form of an expression."""
    base = f"translate({text}, {_quoted(_FROM)}, {_quoted(_TO)})"
    for odd, to in _GRADES:
        base = f"replace({base}, '{odd}', '{to}')"
    base = rf"nfc_normalize(regexp_replace({base}, '([0-9])．([0-9])', '\1.\2', 'g'))"
    words = f"list_transform(regexp_extract_all({{v}}, '[{_WORD}]+|[^{_WORD}]+'), lambda w: case when regexp_matches(w, '[{_GREEK}{_CYRILLIC}]') then {_one_script('w')} else w end)"
    return let(base, f"case when regexp_matches({{v}}, '[{_GREEK}{_CYRILLIC}]') then nfc_normalize(array_to_string({words}, '')) else {{v}} end")


def _read_once(text: str) -> str:
    cut = r"regexp_extract({v}, '(?s)[\{\[].*[\}\]]')"
    return let(f"trim({text}, chr(65279) || ' ' || chr(9) || chr(10) || chr(13))", f"case when json_valid({{v}}) then {{v}} when json_valid({cut}) then {cut} end")


def read_json(text: str) -> str:
    """The JSON text of a payload, whatever is around it, decoded again (twice at most) where it is a string; null where it can't be read."""
    out = _read_once(text)
    for _ in range(2):
        out = let(out, f"case when json_type({{v}}::json) = 'VARCHAR' then {_read_once('json_extract_string({v}::json, chr(36))')} else {{v}} end")
    return out


def decoded(value: str) -> str:
    """A part (JSON), read again where it is a string."""
    return let(value, f"case when json_type({{v}}) = 'VARCHAR' then ({read_json('json_extract_string({v}, chr(36))')})::json else {{v}} end")


def as_list(value: str) -> str:
    """A part as a list of JSON values: an object is a list of one."""
    return let(value, "case json_type({v}) when 'ARRAY' then json_extract({v}, '$[*]') when 'OBJECT' then [{v}] else [] end")
