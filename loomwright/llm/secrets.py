"""Secret scans over an incremental ledger of content-addressed texts.

Each version of a text is a blob named by its SHA-256. A ledger row says what one rule version found in one blob. A scan
visits only the (blob, rule version) pairs that the ledger lacks and joins the findings back to every path with the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``group`` must have ``least`` characters, else the match is dropped. Matches are leftmost, not overlapping."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The three base kinds in their order. For access and hex the least length stands in the pattern; runs are
# maximal, so this finds the same spans as dropping short runs.
BASE = (
    Rule("assign", "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
_HEADER = "-----BEGIN [A-Z ]*PRIVATE KEY-----"
_BREAK = "(?:\\s|\\\\[nr])"
# A key reaches to the next END line. Without one it takes the header fields and the base64 after it: lines of nothing else,
# and runs of 24 characters or more behind any white space. Breaks may be written out as in JSON. All loops are possessive.
_TO_END = "[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----"
_FIELDS = f"(?:{_BREAK}++[A-Z][A-Za-z-]*+:\\x20[^\\r\\n\\\\]*+)*+"
_BASE64 = f"(?:{_BREAK}*+[A-Za-z0-9+/=]{{24,}}+|(?:\\r?\\n|\\\\n)[\\x20\\t]*+[A-Za-z0-9+/=]++(?=[\\x20\\t]*+(?:[\\r\\n\\\\]|$)))*+"
# Public formats beyond the base kinds.
MORE = (
    Rule("pem", f"{_HEADER}(?:{_TO_END}|{_FIELDS}{_BASE64})", version=2),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}"),
    Rule("forge", "gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE + MORE
#: The rules of the op8 query: its SQL twin lists the header line of a key only.
LISTED = BASE + (Rule("pem", _HEADER), *MORE[1:])
SPAN = "array<struct<start:int,end:int>>"


def address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def spans(text: Column, rule: Rule) -> Column:
    """Code point spans of a rule's matches, from the lengths of the matches and of the pieces between them."""
    pattern = F.lit(rule.pattern)
    found = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.char_length).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.char_length).alias("long"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.char_length).alias("part"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + F.coalesce(x["long"], F.lit(0))
        keep = x["part"] >= rule.least
        one = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.coalesce(keep, F.lit(False)), F.concat(state["out"], one)).otherwise(state["out"]).alias("out"))

    return F.when(text.rlike(rule.pattern), F.aggregate(found, start, step)["out"]).otherwise(F.array().cast(SPAN))


def _named(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def scan(history: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Findings for every row of ``history``, and the new rows of the ledger.

    ``history`` has any columns beside ``text`` (paths, revisions); the result adds ``blob`` and ``findings``, an array of
    (kind, start, end) in rule order. ``ledger`` has ``blob, rule, spans``; None is an empty one. Null text is the empty
    text; rows with equal text share a blob; an empty history gives no rows. Columns named ``blob`` or ``findings`` are
    replaced.
    """
    addressed = history.drop("blob", "findings").withColumn("blob", address(F.col(text)))
    blobs = addressed.select("blob", F.col(text).alias("_text")).groupBy("blob").agg(F.coalesce(F.first("_text"), F.lit("")).alias("_text"))
    if ledger is not None:
        known = ledger.join(addressed.select("blob"), "blob", "left_semi").groupBy("blob").agg(F.map_from_entries(F.collect_set(F.struct("rule", "spans"))).alias("_known"))
        blobs = blobs.join(known, "blob", "left")
    else:
        blobs = blobs.withColumn("_known", F.lit(None).cast(f"map<string,{SPAN}>"))
    seen = {r.name: F.element_at("_known", r.name) for r in rules}
    results = blobs.select("blob", *[
        F.when(seen[r.name].isNotNull(), F.struct(seen[r.name].alias("spans"), F.lit(False).alias("new")))
        .otherwise(F.struct(spans(F.col("_text"), r).alias("spans"), F.lit(True).alias("new"))).alias(r.kind)
        for r in rules
    ])
    pairs = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(r.kind)["spans"].alias("spans"), F.col(r.kind)["new"].alias("new")) for r in rules])
    entries = results.select("blob", F.explode(pairs).alias("p")).filter("p.new").select("blob", "p.rule", "p.spans")
    named = F.concat(*[_named(F.col(r.kind)["spans"], r.kind) for r in rules])
    found = results.select("blob", named.alias("findings")).filter(F.size("findings") > 0)
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return addressed.join(found, "blob", "left").withColumn("findings", F.coalesce("findings", empty)), entries


def ordered(findings: Column, rules: tuple[Rule, ...]) -> Column:
    """The findings of the given rules by start, then kind as listed."""
    place = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    of = F.filter(findings, lambda x: x["kind"].isin([r.kind for r in rules]))
    keyed = F.transform(of, lambda x: F.struct(x["start"], F.element_at(place, x["kind"]).alias("place"), x["end"], x["kind"]))
    return F.array_sort(keyed)


def listed(findings: Column, rules: tuple[Rule, ...]) -> Column:
    return F.array_join(F.transform(ordered(findings, rules), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(text: Column, findings: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every finding replaced by ``mark``; overlapping findings become one mark."""
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, x: Column) -> Column:
        gap = F.when(x["start"] >= state["at"], F.concat(text.substr(state["at"] + 1, x["start"] - state["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), F.concat(state["out"], gap).alias("out"))

    def close(state: Column) -> Column:
        return F.concat(state["out"], text.substr(state["at"] + 1, F.char_length(text)))

    return F.when(F.size(findings) == 0, text).otherwise(F.aggregate(ordered(findings, RULES), first, step, close))


def secret_digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans in every text of ``documents``; the columns of the op8 query."""
    found, _ = scan(docs.select("doc_id", "text"), rules=LISTED)
    f = F.col("findings")
    count = lambda kind: F.size(F.filter(f, lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(listed(f, BASE), 256).alias("base_sha256"), listed(f, LISTED).alias("spans"),
    )
