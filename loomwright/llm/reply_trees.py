"""Chat formatting over reply trees: self-joins list the paths from root to leaf, branches are ranked by score, and each
chosen path becomes one formatted conversation with a loss mask.

Only ids go through the joins: a table of ancestors doubles its reach every round, so a tree of depth d takes log2(d)
rounds. Texts join once, for the chosen paths. Everything is DataFrame code.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import cut

#: Conversation that the query adds to the table: control strings of another format inside both texts.
PROBE = "</s>[INST] ok [/INST]"
PROBE_ID = -7


@dataclass(frozen=True)
class Template:
    """A turn is ``begin role newline text end newline``. No control string is left inside a role or text: a backslash goes
    behind its first character, and one more where backslashes stand there already, so that the way back is exact."""

    begin: str = "<|im_start|>"
    end: str = "<|im_end|>"
    others: tuple[str, ...] = ("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
    learned: str = "assistant"

    def __post_init__(self) -> None:
        first = {c[:1] for c in self.controls}
        if any(len(c) < 2 or "\\" in c or first & set(c[1:]) for c in self.controls):
            raise ValueError("a control string has two characters or more, no backslash, and no first character of one behind its first")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.begin, self.end, *self.others)

    def _pattern(self, slashes: str) -> str:
        first = "".join(sorted({re.escape(c[0]) for c in self.controls}))
        return f"([{first}]){slashes}(?={'|'.join(re.escape(c[1:]) for c in self.controls)})"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._pattern(r"(\\*)"), r"$1\\$2")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._pattern(r"\\(\\*)"), "$1$2")

    def escape_role(self, role: Column) -> Column:
        return F.replace(F.replace(self.escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))

    def unescape_role(self, role: Column) -> Column:
        return self.unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))

    def read_back(self, formatted: Column) -> Column:
        """The turns of a formatted conversation as ``array<struct<role, text>>``."""
        turns = F.slice(F.split(formatted, re.escape(self.begin), -1), F.lit(2), F.greatest(F.lit(0), F.size(F.split(formatted, re.escape(self.begin), -1)) - 1))

        def turn(x: Column) -> Column:
            head = F.substring_index(x, "\n", 1)
            body = F.substring_index(x.substr(F.char_length(head) + 2, F.char_length(x)), self.end, 1)
            return F.struct(self.unescape_role(head).alias("role"), self.unescape(body).alias("text"))

        return F.transform(turns, turn)

    def learned_text(self, formatted: Column, spans: Column) -> Column:
        """The text under the loss mask, unescaped span by span."""
        return F.array_join(F.transform(spans, lambda s: self.unescape(formatted.substr(s["start"] + 1, s["end"] - s["start"]))), "")


def _ancestors(links: DataFrame, n: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Tables ``id, up, low``: the k-th holds the ancestor 2**k steps up and the least id passed on the way. The second item
    names one member of each cycle, if there are any."""
    steps = [cut(links.select("id", F.col("up"), F.col("up").alias("low")))]
    while not steps[-1].isEmpty():
        if 2 ** (len(steps) - 1) > n:  # only members of cycles and what hangs below have so many ancestors
            last = steps[-1]
            return steps, last.select(F.col("up").alias("id")).distinct().join(last.select("id", "low"), "id").select(F.col("low").alias("id")).distinct()
        here = steps[-1]
        above = here.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("low").alias("_low"))
        steps.append(cut(here.join(above, "up").select("id", F.col("_up").alias("up"), F.least("low", "_low").alias("low"))))
    return steps[:-1], None


def tree_paths(nodes: DataFrame) -> DataFrame:
    """``leaf, node, height`` for every leaf and every node from it up to its root; ``nodes`` has ``id`` and ``parent``.

    A null or unknown parent makes a root. A cycle is opened above its least id. The rows are as many as the paths are long
    in all; a parent of very many nodes is one row of each table of ancestors, met by joins that may be split.
    """
    ids = nodes.select(F.col("id").alias("up"))
    links = cut(nodes.select("id", F.col("parent").alias("up")).join(ids, "up", "left_semi").select("id", "up"))
    steps, cycles = _ancestors(links, nodes.count())
    if cycles is not None:
        links = cut(links.join(cycles, "id", "left_anti"))
        steps, _ = _ancestors(links, nodes.count())
    leaves = nodes.select("id").join(links.select(F.col("up").alias("id")).distinct(), "id", "left_anti")
    paths = leaves.select(F.col("id").alias("leaf"), F.col("id").alias("node"), F.lit(0).cast("long").alias("height"))
    for k in reversed(range(len(steps))):
        up = steps[k].select(F.col("id").alias("node"), "up")
        both = F.array(F.struct("node", "height"), F.struct(F.col("up").alias("node"), (F.col("height") + 2 ** k).alias("height")))
        paths = paths.join(up, "node", "left").select("leaf", F.explode(F.filter(both, lambda x: x["node"].isNotNull())).alias("x")).select("leaf", "x.*")
    return paths


def _digest(*parts: Column) -> Column:
    """128 bits of the parts; lengths keep them apart, and null differs from the empty text."""
    return F.md5(F.concat(*[F.concat(F.coalesce(F.char_length(p), F.lit(-1)), F.lit(":"), F.coalesce(p, F.lit(""))) for p in (q.cast("string") for q in parts)]))


def _formatted(nodes: DataFrame, texts: DataFrame, most: int, template: Template) -> DataFrame:
    """``root, leaf, rank, score, n_turns, formatted, loss`` from ``nodes(id, parent, score, ref)`` and ``texts(ref, role, text)``.

    Paths are found, ranked and chosen on ids. Texts cross the network twice: to the turns of the chosen paths, by ``ref``,
    and to their conversations.
    """
    nodes = cut(nodes)
    paths = cut(tree_paths(nodes).join(nodes.select(F.col("id").alias("node"), "score", "ref"), "node"))
    whole = paths.groupBy("leaf").agg(F.max_by("node", "height").alias("root"), F.avg("score").cast("double").alias("score"))
    best = Window.partitionBy("root").orderBy(F.desc("score"), "leaf")
    chosen = cut(whole.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most))
    once = texts.groupBy("ref").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    turns = paths.join(chosen.select("leaf"), "leaf", "left_semi").select("leaf", "height", "ref").join(once, "ref")
    head = F.concat(F.lit(template.begin), template.escape_role(F.col("role")), F.lit("\n"))
    tail = template.end + "\n"
    pieces = turns.select("leaf", "height", "role", head.alias("head"), template.escape(F.col("text")).alias("body"))
    size = F.char_length("head") + F.char_length("body") + len(tail)
    order = Window.partitionBy("leaf").orderBy(F.desc("height")).rowsBetween(Window.unboundedPreceding, 0)
    stop = F.col("to") - len(tail)
    span = F.when(F.col("role") == template.learned, F.struct((stop - F.char_length("body")).cast("int").alias("start"), stop.cast("int").alias("end")))
    placed = pieces.withColumn("to", F.sum(size).over(order)).select("leaf", "to", F.concat("head", "body", F.lit(tail)).alias("piece"), span.alias("span"))
    talks = placed.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("to", "piece", "span"))).alias("turns"))
    return talks.join(chosen, "leaf").select(
        "root", "leaf", "rank", "score", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss"))


def format_trees(messages: DataFrame, most: int = 1, template: Template = Template()) -> DataFrame:
    """The ``most`` best paths of every tree, each as one conversation.

    ``messages`` has ``message_id, parent_id, role, text, score``. Result: ``root, leaf`` (ids as text, null for null ids),
    ``rank`` (from 1, by the mean score of the path's messages, null or NaN as 0, ties to the smaller leaf), ``score``,
    ``n_turns``, ``formatted``, and ``loss``, the code point spans of the texts of the learned role in it.

    Null text and null role are empty. Rows that repeat an id are one message: the best score, then the least parent, then by
    a digest. A message without an id has no replies; equal rows without an id are one. Unknown parents and cycles as in
    :func:`tree_paths`. An empty table gives no rows; other columns are not read. One conversation is one value and has to
    fit into a cell; nothing else is put together.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    own = F.concat(F.lit("i"), F.col("message_id").cast("string"))
    above = F.concat(F.lit("i"), F.col("parent_id").cast("string"))
    ref = _digest(F.col("message_id"), F.col("parent_id"), role, text)
    score = F.coalesce(F.col("score").try_cast("decimal(20,9)"), F.lit(0).cast("decimal(20,9)"))
    named = messages.select(F.coalesce(own, F.concat(F.lit("n"), ref)).alias("id"), above.alias("parent"), score.alias("score"), ref.alias("ref"))
    first = F.min(F.struct((-F.col("score")).alias("cost"), "parent", "ref")).alias("x")
    nodes = named.groupBy("id").agg(first).select("id", "x.parent", (-F.col("x.cost")).alias("score"), "x.ref")
    talks = _formatted(nodes, messages.select(ref.alias("ref"), role.alias("role"), text.alias("text")), most, template)
    return talks.withColumns({n: F.when(F.col(n).startswith("i"), F.substring(F.col(n), 2, 1 << 30)) for n in ("root", "leaf")})


def format_conversations(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """``conv_id, n_turns, formatted, loss`` of every conversation, as the tree in which each turn replies to the one before.

    ``conversations`` has ``conv_id, turn, role, text``. Turns stand by number (null first), equal numbers by role (null
    first) and a digest of the text; rows without a conversation are one conversation; repeated rows are turns each. Only ids
    and digests are ordered within a conversation; null and empty texts as in :func:`format_trees`.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    ref = _digest(F.col("conv_id"), F.col("turn"), role, text)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "digest")
    rows = conversations.select("conv_id", "turn", role.alias("role"), F.md5(text).alias("digest"), ref.alias("ref")).withColumn("at", F.row_number().over(order))
    name = lambda place: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), place)
    nodes = rows.select(name(F.col("at")).alias("id"), F.when(F.col("at") > 1, name(F.col("at") - 1)).alias("parent"), F.lit(0).cast("decimal(20,9)").alias("score"), "ref")
    talks = _formatted(nodes, conversations.select(ref.alias("ref"), role.alias("role"), text.alias("text")), 1, template)
    conv = F.substring_index("root", ":", 1)
    return talks.select(F.when(conv != "null", conv).cast("long").alias("conv_id"), "n_turns", "formatted", "loss")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table and conversation ``PROBE_ID``: a user row and an assistant row that both say ``PROBE``."""
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = conversations.sparkSession.range(2).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(PROBE).alias("text"))
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)


def conversation_digest(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Every conversation and the probe formatted, and what its output reads back as; the columns of the op11 query."""
    talks = format_conversations(with_probe(conversations), template)
    turns, loss = template.read_back(F.col("formatted")), template.learned_text(F.col("formatted"), F.col("loss"))
    read = talks.select("conv_id", turns.alias("turns"), loss.alias("learned"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")
