"""Pieces shared by the DuckDB twins of the registered queries."""

from __future__ import annotations

from loomwright import vocab as V

WS = "[\\t-\\r\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
NOT_WS = "[^" + WS[1:]
CJK = "\\x{4e00}-\\x{9fa5}"
SENTENCE_END = "[。！？.?!\\n]+"

# Letters to characters, to turn the given Latin texts into texts with CJK words.
LATIN = "abcdefghijklmnopqrstuvwxyz"
SINIFIED = "什预怎么原热病状治何如科药疗检炎防因是症查痛有哪室些"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quoted(words) -> str:
    return "[" + ", ".join(quote(w) for w in words) + "]"


def strip(x: str) -> str:
    codes = " || ".join(f"chr({ord(c)})" for c in V.WHITESPACE)
    return f"trim({x}, {codes})"


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def sinified(x: str) -> str:
    return f"translate(lower({x}), '{LATIN}', '{SINIFIED}')"


def first_rule(x: str, rules, default: str) -> str:
    cases = " ".join(
        f"WHEN list_bool_or(list_transform({quoted(words)}, lambda w: contains({x}, w))) THEN {quote(name)}"
        for name, words in rules
    )
    return f"CASE {cases} ELSE {default} END"
