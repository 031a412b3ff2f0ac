"""Text column functions. Everything here is a built-in expression; nothing leaves the JVM.

White space, digits and word characters follow Unicode, so the character classes are spelt out instead of using the
ASCII shorthands of the regex engine.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwright import vocab as V

WS = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
NOT_WS = "[^" + WS[1:]
# one white-space character other than the plain space; the cheap class in front rejects ASCII text at once
RARE_WS = f"[^!-~ ](?<={WS})"
WORD = "[\\p{L}\\p{N}_]"
EDGE = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
CJK = "\\u4e00-\\u9fa5"
SENTENCE_END = "[。！？.?!\\n]+"

# a name of plain words with single spaces between them, as most are
PLAIN_NAME = f"^[!-~{CJK}]++(?: [!-~{CJK}]++)*+\\z"

FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
HALF_WIDTH = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literals(values) -> Column:
    """A bounded word list as an array literal."""
    values = list(values)
    if not values:
        return F.array().cast("array<string>")
    return F.expr(f"array({', '.join(_quoted(v) for v in values)})")


def mapping(table: dict[str, str]) -> Column:
    """A bounded lookup table as a map literal."""
    return F.expr(f"map({', '.join(_quoted(x) for pair in table.items() for x in pair)})")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(V.WHITESPACE))


def collapse(c: Column) -> Column:
    """Runs of white space become one space; the ends are trimmed. Single plain spaces are left alone."""
    return strip(F.regexp_replace(c, f" {WS}+|{RARE_WS}{WS}*", " "))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also inside array functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unify_newlines(c: Column) -> Column:
    return F.when(c.contains("\r"), F.regexp_replace(c, "\\r\\n?", "\n")).otherwise(c)


def any_in(text: Column, words) -> Column:
    """True when any of a bounded list of words occurs in ``text``."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def first_rule(text: Column, rules, default: Column | None = None) -> Column:
    """Name of the first rule with a word occurring in ``text``."""
    out = None
    for name, words in rules:
        out = F.when(any_in(text, words), name) if out is None else out.when(any_in(text, words), name)
    return out.otherwise(default if default is not None else F.lit(None))


# --- line cleaning -------------------------------------------------------------------------------------------------

CUTOFF_LINE = f"(?i)^{WS}*(?:{'|'.join(V.CUTOFF_HEADINGS)}){WS}*$"
PAGE_MARK = f"(?i)page{WS}+\\p{{Nd}}+{WS}+of{WS}+\\p{{Nd}}+|第{WS}*\\p{{Nd}}+{WS}*页"
CAPTION = f"^(?:[图表]|(?i:Figure|Fig\\.?|Table|TAB\\.)){WS}*\\p{{Nd}}"
NOISE_CLASS = "".join("\\" + c for c in V.NOISE_PUNCTUATION)


def before_cutoff(lines: Column) -> Column:
    """Lines up to the first reference or acknowledgement heading."""

    def until(all_lines: Column, cut: Column) -> Column:
        return F.when(cut == 0, all_lines).otherwise(F.slice(all_lines, F.lit(1), F.greatest(cut - 1, F.lit(0))))

    def cut_at(all_lines: Column) -> Column:
        return F.array_position(F.transform(all_lines, lambda x: x.rlike(CUTOFF_LINE)), True).cast("int")

    return bind(lines, lambda ls: bind(cut_at(ls), lambda cut: until(ls, cut)))


def is_page_mark(line: Column) -> Column:
    return line.rlike(PAGE_MARK)


def is_caption(line: Column) -> Column:
    return strip(line).rlike(CAPTION)


def is_garbage(line: Column) -> Column:
    """Shorter than 6, blank, or more than 60% digits and punctuation among the visible characters."""
    visible = F.length(F.regexp_replace(F.replace(line, F.lit(" "), F.lit("")), f"(?:{RARE_WS})+", ""))
    noise = F.length(line) - F.length(F.regexp_replace(line, f"[\\p{{Nd}}{NOISE_CLASS}]+", ""))
    return (F.length(line) < 6) | (visible == 0) | (noise / F.greatest(visible, F.lit(1)) > 0.6)


def is_stray_short(line: Column) -> Column:
    """Shorter than 15 characters and without a domain keyword."""
    known = any_in(line, V.DOMAIN_KEYWORDS) | any_in(F.lower(line), V.DOMAIN_KEYWORDS)
    return (F.length(line) < 15) & ~known


def scrub_inline(line: Column) -> Column:
    """Remove citations, links and mail addresses from one line, then squeeze white space."""
    patterns = [
        ("[", f"\\[(?:[0-9,\\-]|{WS})+\\]"),
        ("(", "\\([A-Z][A-Za-z][^\\n]{0,40}?\\p{Nd}{4}\\)"),
        ("http", f"https?://{NOT_WS}+"),
        ("@", f"{EDGE}[\\p{{L}}\\p{{N}}_.\\-]+@[\\p{{L}}\\p{{N}}_.\\-]+\\.{WORD}+{EDGE}"),
    ]
    for needed, pattern in patterns:
        line = F.when(line.contains(needed), F.regexp_replace(line, pattern, "")).otherwise(line)
    return strip(F.regexp_replace(line, f" {WS}+|{RARE_WS}{WS}+", " "))


def clean_lines(text: Column) -> Column:
    """The whole line-cleaning job on one text; blank input gives an empty text."""
    lines = before_cutoff(F.split(unify_newlines(F.coalesce(text, F.lit(""))), "\n"))
    kept = F.filter(
        F.transform(lines, strip),
        lambda x: (x != "") & ~is_page_mark(x) & ~is_caption(x) & ~is_garbage(x) & ~is_stray_short(x),
    )
    return F.array_join(F.filter(F.transform(kept, scrub_inline), lambda x: x != ""), "\n")


def normalize_control(text: Column) -> Column:
    """Drop control characters except tab and line feed, then squeeze white space."""
    bare = F.regexp_replace(unify_newlines(F.coalesce(text, F.lit(""))), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")
    return collapse(bare)


def graph_clean(text: Column) -> Column:
    """Squeeze white space, then keep CJK, ASCII letters and digits and a punctuation list."""
    dropped = f"(?:[^a-z ](?<![{CJK}A-Z0-9，。！？、；：\"（）【】《》\\-.?!]))+"
    return strip(F.regexp_replace(collapse(text), dropped, ""))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END), strip), lambda x: x != "")


def cjk_runs(text: Column, low: int = 2, high: int = 4) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[{CJK}]{{{low},{high}}}"), F.lit(0))


# --- names, types, questions ---------------------------------------------------------------------------------------


def normalize_name(name: Column) -> Column:
    """Trim, full width to half width, single spaces; null becomes ''. Names that are so already are told by one pattern."""
    trimmed = strip(name)
    narrow = F.when(trimmed.rlike("[\\u3000\\uff01-\\uff5e]"), F.translate(trimmed, FULL_WIDTH, HALF_WIDTH)).otherwise(trimmed)
    return F.when(name.rlike(PLAIN_NAME), name).otherwise(F.coalesce(collapse(narrow), F.lit("")))


def is_valid_name(name: Column) -> Column:
    return (
        (F.length(name) >= V.NAME_MIN_LENGTH)
        & ~name.isin(V.NAME_BLACKLIST)
        & ~name.rlike(f"^(?:[\\p{{Nd}}.\\-]|{WS})+$")
    )


def _resolve(value: Column, names, aliases, default: str) -> Column:
    table = mapping({**aliases, **{n: n for n in names}})
    found = F.coalesce(F.element_at(table, F.coalesce(strip(value), F.lit(""))), F.lit(default))
    return F.when(value.isin(list(names)), value).otherwise(found)  # a set; the map is searched entry by entry


def resolve_entity_type(value: Column) -> Column:
    return _resolve(value, V.ENTITY_TYPES, V.ENTITY_TYPE_ALIASES, "Disease")


def resolve_relation_type(value: Column) -> Column:
    return _resolve(value, V.RELATION_TYPES, V.RELATION_TYPE_ALIASES, "BELONGS_TO")


def normalize_query(text: Column) -> Column:
    ascii_marks = F.translate(collapse(text), "？！，。", "?!,.")
    return strip(F.regexp_replace(ascii_marks, f"[^{CJK}a-zA-Z0-9 ?!,.]", ""))


def question_type(text: Column) -> Column:
    return first_rule(F.lower(text), V.QUESTION_TYPES, F.lit("other"))


def intent_fine(text: Column) -> Column:
    return first_rule(F.lower(text), V.INTENTS_FINE, F.lit("other"))


def intent_coarse(text: Column) -> Column:
    return first_rule(F.lower(text), V.INTENTS_COARSE, F.lit("general_query"))


def intent_pattern(text: Column) -> Column:
    out = None
    for name, pattern in V.INTENT_PATTERNS:
        hit = text.rlike("(?d)" + pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def query_keywords(text: Column, limit: int = 5) -> Column:
    kept = F.filter(cjk_runs(text), lambda w: ~w.isin(V.QUERY_STOPWORDS))
    return F.slice(F.array_distinct(kept), 1, limit)


def entity_type_by_keyword(word: Column) -> Column:
    name, words = V.TYPE_KEYWORDS_FALLBACK
    return first_rule(word, V.TYPE_KEYWORDS, F.when(any_in(word, words), name))


def match_known_entities(text: Column, known=None, hints=None) -> Column:
    """Known names occurring in the text; without one, the first 2-6 character run holding a hint letter."""
    known, hints = known or V.KNOWN_ENTITIES, hints or V.ENTITY_HINTS
    found = F.filter(literals(known), lambda k: F.instr(text, k) > 0)
    hinted = F.filter(cjk_runs(text, 2, 6), lambda w: any_in(w, hints))
    return F.when(F.size(found) > 0, found).otherwise(F.slice(hinted, 1, 1))


def add_care_terms(keywords: Column, n_entities: Column, confidence: Column, limit: int = 10) -> Column:
    """Append the domain terms, at most ten keywords, when the parse found no entity or is unsure."""
    missing = F.filter(literals(V.CARE_TERMS), lambda t: ~F.array_contains(keywords, t))
    return F.when(
        (n_entities == 0) | (confidence < 0.5), F.slice(F.concat(keywords, missing), 1, limit)
    ).otherwise(keywords)


def parse_confidence(n_model_entities: Column, model_intent: Column) -> Column:
    has_intent = F.coalesce(model_intent, F.lit("")) != ""
    base = F.when((n_model_entities > 0) | has_intent, 0.8).otherwise(0.5)
    bonus = F.when(n_model_entities > 0, 0.1).otherwise(0.0) + F.when(
        has_intent & (model_intent != "other"), 0.1
    ).otherwise(0.0)
    return F.least(F.lit(1.0), base + bonus)


def entity_tag_name(raw: Column) -> Column:
    """``name`` of ``name[tag]``; the whole text when there is no tag."""
    raw = strip(F.coalesce(raw, F.lit("")))
    tagged = raw.contains("[") & raw.contains("]")
    return F.when(tagged, strip(F.substring_index(raw, "[", 1))).otherwise(raw)


def entity_tag_type(raw: Column, tags=None) -> Column:
    """Type of ``name[tag]``; null for other tags and untagged names."""
    tags = tags or {"疾病": "DISEASE", "症状": "SYMPTOM"}
    tag = F.regexp_extract(raw, "^[^\\[]*\\[([^\\]]*)\\]?", 1)
    table = mapping(tags)
    return F.when(raw.contains("[") & raw.contains("]"), F.element_at(table, tag))


def table_to_text(tables: Column) -> Column:
    """ARRAY<ARRAY<ARRAY<STRING>>> to bar-separated lines, a blank line between tables, empty tables skipped."""

    def row_text(row):
        cells = F.transform(row, lambda c: F.coalesce(strip(c), F.lit("")))
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    filled = F.filter(tables, lambda t: F.size(t) > 0)
    blocks = F.transform(filled, lambda t: F.array_join(F.transform(t, row_text), "\n"))
    return strip(F.array_join(blocks, "\n\n"))


def duration_text(ms: Column) -> Column:
    """Whole seconds below a minute, else minutes with one decimal, both rounded half-even on the binary value."""
    ms = ms.cast("bigint")
    seconds = F.concat(F.format_string("%.0f", F.rint(ms / 1000)), F.lit("秒"))
    tenths, rest = F.floor(ms / 6000), ms % 6000
    # at 3000 the decimal value is a tie; whether the double lies above or below it shows in its 52 fraction bits
    bits = ((ms / 60000 - F.floor(ms / 60000)) * float(2**52)).cast("bigint").cast("decimal(20,0)")
    over = bits * 20 - F.floor((ms % 60000) / 3000).cast("decimal(20,0)") * F.lit(2**52).cast("decimal(17,0)")
    up = (rest > 3000) | ((rest == 3000) & ((over > 0) | ((over == 0) & (tenths % 2 == 1))))
    rounded = tenths + F.when(up, 1).otherwise(0)
    minutes = F.concat(F.floor(rounded / 10).cast("string"), F.lit("."), (rounded % 10).cast("string"), F.lit("分钟"))
    return F.when(ms < 60000, seconds).otherwise(minutes)


def grade_from_output(text: Column) -> Column:
    """Score of the outermost {...} in a model output, mapped to 0 / 0.5 / 1; null when there is none."""
    score = F.get_json_object(F.regexp_extract(text, "(?s)\\{.*\\}", 0), "$.score").try_cast("double")
    return F.when(score.isNull(), None).when(score <= 0.25, 0.0).when(score <= 0.75, 0.5).otherwise(1.0)


# --- steps and cards -----------------------------------------------------------------------------------------------


def sections_to_steps(sections: Column, max_steps: int = 7, max_chars: int = 30) -> Column:
    """ARRAY<STRUCT<heading, content>> to short steps.

    A section gives its sentences, long ones cut, then its heading unless that text is a step already. A sentence
    (or heading) is taken whole while fewer than ``max_steps`` steps exist.
    """

    def units(section):
        parts = F.filter(F.transform(F.split(strip(section["content"]), "[。！？；\\n]+"), strip), lambda x: x != "")
        piece = F.lit(f"(?s){WS}*({NOT_WS}.{{0,{max_chars - 1}}})")
        body = F.transform(
            parts,
            lambda s: F.struct(
                F.transform(F.regexp_extract_all(s, piece, F.lit(1)), strip).alias("texts"), F.lit(False).alias("head")
            ),
        )
        title = F.substring(strip(F.coalesce(section["heading"], F.lit(""))), 1, max_chars)
        head = F.array(F.struct(F.array(title).alias("texts"), F.lit(True).alias("head")))
        return F.when(title == "", body).otherwise(F.concat(body, head))

    def take(steps, unit):
        full = F.size(steps) >= max_steps
        repeated = unit["head"] & F.array_contains(steps, F.element_at(unit["texts"], 1))
        return F.when(full | repeated, steps).otherwise(F.concat(steps, unit["texts"]))

    return F.aggregate(F.flatten(F.transform(sections, units)), F.array().cast("array<string>"), take)


def sections_to_cards(sections: Column) -> Column:
    return F.transform(
        sections,
        lambda s: F.struct(
            strip(F.coalesce(s["heading"], F.lit(""))).alias("title"),
            strip(F.coalesce(s["content"], F.lit(""))).alias("content"),
        ),
    )
