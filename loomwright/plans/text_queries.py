"""Text and chunking queries over documents, conversations, pages and benchmark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright import vocab as V
from loomwright.functions import text as T
from loomwright.operators import chunking as C
from loomwright.operators import dictionary as D
from loomwright.plans import sqlkit as S
from loomwright.plans.registry import all_sql, query
from loomwright.sources.splits import spread

c = F.col


def sinified(col):
    return F.translate(F.lower(col), S.LATIN, S.SINIFIED)


def noisy(t):
    """Documents with page marks, captions, numbers, citations, links and a reference section added."""
    return spread(t.documents.select("doc_id", "text", "n_chars", "source")).select(
        "doc_id",
        F.concat(
            c("text"), F.lit("\r\nPage "), c("doc_id"), F.lit(" of "), c("n_chars"), F.lit("\nFigure "), c("doc_id"),
            F.lit(" overview of all\n第 "), c("doc_id"), F.lit(" 页\nshort risk\n12.5, 13.7 (44)\nSee [1,2-3] (Smith and others 2020) at https://a.b/c?d mail "),
            c("source"), F.lit("@example.org now  ok\n\n References \nlast "), c("source"),
        ).alias("text"),
    )


NOISY = """(SELECT doc_id, text || chr(13) || chr(10) || 'Page ' || doc_id || ' of ' || n_chars || chr(10) || 'Figure ' || doc_id
 || ' overview of all' || chr(10) || '第 ' || doc_id || ' 页' || chr(10) || 'short risk' || chr(10) || '12.5, 13.7 (44)' || chr(10)
 || 'See [1,2-3] (Smith and others 2020) at https://a.b/c?d mail ' || source || '@example.org now  ok' || chr(10) || chr(10)
 || ' References ' || chr(10) || 'last ' || source AS text FROM documents)"""
LINES = "string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))"
CUT = f"(?i)^{S.WS}*(?:{'|'.join(V.CUTOFF_HEADINGS)}){S.WS}*$"
PAGE = f"(?i)page{S.WS}+\\p{{Nd}}+{S.WS}+of{S.WS}+\\p{{Nd}}+|第{S.WS}*\\p{{Nd}}+{S.WS}*页"
CAPTION = f"^(?:[图表]|(?i:Figure|Fig\\.?|Table|TAB\\.)){S.WS}*\\p{{Nd}}"
NOISE = "".join("\\" + x for x in V.NOISE_PUNCTUATION)


def sql_garbage(x):
    visible = f"length(regexp_replace({x}, '{S.WS}+', '', 'g'))"
    return (
        f"(length({x}) < 6 OR {visible} = 0 OR "
        f"length(regexp_replace({x}, '[^\\p{{Nd}}{NOISE}]+', '', 'g')) / greatest({visible}, 1) > 0.6)"
    )


def sql_short(x):
    known = f"list_bool_or(list_transform({S.quoted(V.DOMAIN_KEYWORDS)}, lambda k: contains({x}, k) OR contains(lower({x}), k)))"
    return f"(length({x}) < 15 AND NOT {known})"


def sql_scrub(x):
    for p in (
        f"\\[(?:[0-9,\\-]|{S.WS})+\\]", "\\([A-Z][A-Za-z][^\\n]{0,40}?\\p{Nd}{4}\\)", f"https?://{S.NOT_WS}+",
        "\\b[\\p{L}\\p{N}_.\\-]+@[\\p{L}\\p{N}_.\\-]+\\.[\\p{L}\\p{N}_]+\\b",
    ):
        x = f"regexp_replace({x}, '{p}', '', 'g')"
    return S.strip(f"regexp_replace({x}, '{S.WS}{{2,}}', ' ', 'g')")


CUT_AT = f"list_position(list_transform(lines, lambda x: regexp_matches(x, '{CUT}')), true)"
KEPT = f"CASE WHEN coalesce({CUT_AT}, 0) = 0 THEN lines ELSE lines[1:{CUT_AT} - 1] END"


@query("tx1_cutoff", f"SELECT doc_id, array_to_string({KEPT}, chr(10)) AS text FROM (SELECT doc_id, {LINES} AS lines FROM {NOISY})")
def _(t):
    lines = F.split(T.unify_newlines(c("text")), "\n")
    return noisy(t).select("doc_id", F.array_join(T.before_cutoff(lines), "\n").alias("text"))


@query("tx2_5_line_flags", f"""
WITH l AS (SELECT doc_id, unnest(lines) AS raw, unnest(range(len(lines))) AS line_no FROM (SELECT doc_id, {LINES} AS lines FROM {NOISY})),
s AS (SELECT doc_id, CAST(line_no AS INT) AS line_no, {S.strip('raw')} AS line FROM l)
SELECT doc_id, line_no, regexp_matches(line, '{PAGE}') AS page_mark, regexp_matches(line, '{CAPTION}') AS caption,
 {sql_garbage('line')} AS garbage, {sql_short('line')} AS stray_short FROM s""")
def _(t):
    lines = F.split(T.unify_newlines(c("text")), "\n")
    line = T.strip(c("line"))
    return noisy(t).select("doc_id", F.posexplode(lines).alias("line_no", "line")).select(
        "doc_id", "line_no", T.is_page_mark(line).alias("page_mark"), T.is_caption(line).alias("caption"),
        T.is_garbage(line).alias("garbage"), T.is_stray_short(line).alias("stray_short"),
    )


@query("tx6_inline_scrub", f"""SELECT doc_id, {sql_scrub('raw')} AS line FROM (SELECT doc_id, unnest({LINES}) AS raw FROM {NOISY})
WHERE {sql_scrub('raw')} <> ''""")
def _(t):
    lines = F.split(T.unify_newlines(c("text")), "\n")
    scrubbed = noisy(t).select("doc_id", F.explode(lines).alias("line")).select("doc_id", T.scrub_inline(c("line")).alias("line"))
    return scrubbed.filter("line <> ''")


SQL_CLEAN = f"""array_to_string(list_filter(list_transform(list_filter(list_transform({KEPT}, lambda x: {S.strip('x')}),
 lambda x: x <> '' AND NOT regexp_matches(x, '{PAGE}') AND NOT regexp_matches(x, '{CAPTION}') AND NOT {sql_garbage('x')} AND NOT {sql_short('x')}),
 lambda x: {sql_scrub('x')}), lambda x: x <> ''), chr(10))"""


@query("tx7_clean_lines", f"SELECT doc_id, {SQL_CLEAN} AS text FROM (SELECT doc_id, {LINES} AS lines FROM {NOISY})")
def _(t):
    return noisy(t).select("doc_id", T.clean_lines(c("text")).alias("text"))


CLEANED = f"(SELECT *, {SQL_CLEAN} AS body FROM (SELECT *, {LINES} AS lines FROM documents))"


def cleaned(t):
    return spread(t.documents).withColumn("text", T.clean_lines(c("text")))


@query("tx8_control_chars", f"""SELECT page_id, {S.collapse("regexp_replace(regexp_replace(x, '\\r\\n?', chr(10), 'g'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')")} AS text
FROM (SELECT page_id, html || chr(13) || chr(7) || url AS x FROM pages)""")
def _(t):
    return t.pages.select("page_id", T.normalize_control(F.concat("html", F.lit("\r\x07"), "url")).alias("text"))


SQL_GRAPH_CLEAN = S.strip(f"regexp_replace({S.collapse('text')}, '[^{S.CJK}a-zA-Z0-9，。！？、；：\"（）【】《》\\-.?! ]', '', 'g')")


@query("tx9_graph_clean", f"SELECT doc_id, {SQL_GRAPH_CLEAN} AS text FROM documents")
def _(t):
    return spread(t.documents.select("doc_id", "text")).select("doc_id", T.graph_clean(c("text")).alias("text"))


SQL_SENTENCES = f"list_filter(list_transform(regexp_split_to_array(text, '{S.SENTENCE_END}'), lambda x: {S.strip('x')}), lambda x: x <> '')"


@query("tx10_sentences", f"SELECT doc_id, unnest({SQL_SENTENCES}) AS sentence, CAST(unnest(range(len({SQL_SENTENCES}))) AS INT) AS pos FROM documents")
def _(t):
    return spread(t.documents.select("doc_id", "text")).select("doc_id", F.posexplode(T.sentences(c("text"))).alias("pos", "sentence"))


@query("tx11_keywords", f"""
WITH w AS (SELECT item_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM
  (SELECT item_id, regexp_extract_all({S.sinified('text')}, '[{S.CJK}]{{2,4}}') AS ws FROM benchmark)),
g AS (SELECT item_id, word, count(*) AS n, min(pos) AS first_pos FROM w GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, first_pos) AS rn FROM g)
SELECT item_id, word, n, CAST(rn AS INT) AS place FROM r WHERE rn <= 10""")
def _(t):
    return D.top_keywords(t.benchmark.select("item_id", sinified(c("text")).alias("text")), "item_id", "text", 10)


@query("tx12_13_names", f"""
SELECT c_custkey, n AS name, (length(n) >= 2 AND n NOT IN ({', '.join(map(S.quote, V.NAME_BLACKLIST))}) AND NOT regexp_matches(n, '^(?:[\\p{{Nd}}.\\-]|{S.WS})+$')) AS valid
FROM (SELECT c_custkey, {S.collapse(f"translate({S.strip('raw')}, {S.quote(T.FULL_WIDTH)}, {S.quote(T.HALF_WIDTH)})")} AS n
 FROM (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN ' ' || CAST(c_custkey AS VARCHAR) || '　' WHEN c_mktsegment = 'BUILDING' THEN '患者'
  ELSE '　（' || c_name || '）　　Ａ１' END AS raw FROM customer))""")
def _(t):
    raw = (
        F.when(c("c_acctbal") < 0, F.concat(F.lit(" "), c("c_custkey").cast("string"), F.lit("　")))
        .when(c("c_mktsegment") == "BUILDING", "患者")
        .otherwise(F.concat(F.lit("　（"), c("c_name"), F.lit("）　　Ａ１")))
    )
    name = T.normalize_name(raw)
    return t.customer.select("c_custkey", name.alias("name"), T.is_valid_name(name).alias("valid"))


@query("tx14_table_text", f"""
SELECT l_orderkey, '| order | ' || l_orderkey || ' |' || chr(10) || string_agg('| ' || l_linenumber || ' |  |', chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) AS text
FROM lineitem GROUP BY l_orderkey""")
def _(t):
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    body = F.transform(rows, lambda r: F.array(r["l_linenumber"].cast("string"), F.lit(None).cast("string")))
    head = F.array(F.lit(" order"), c("l_orderkey").cast("string"))
    table = F.concat(F.array(head), c("body"))
    orders = t.lineitem.groupBy("l_orderkey").agg(body.alias("body"))
    return orders.select("l_orderkey", T.table_to_text(F.array(table, F.array().cast("array<array<string>>"))).alias("text"))


@query("tx15_normalize_query", f"""
SELECT conv_id, turn, {S.strip(f"regexp_replace(translate({S.collapse('x')}, '？！，。', '?!,.'), '[^{S.CJK}a-zA-Z0-9 ?!,.]', '', 'g')")} AS text
FROM (SELECT conv_id, turn, {S.sinified('text')} || '？' || text AS x FROM conversations)""")
def _(t):
    return t.conversations.select(
        "conv_id", "turn", T.normalize_query(F.concat(sinified(c("text")), F.lit("？"), c("text"))).alias("text")
    )


ZH = S.sinified("text")


@query("tx16_19_intents", f"""
SELECT conv_id, turn, {S.first_rule('lower(text)', V.QUESTION_TYPES, "'other'")} AS question_type,
 {S.first_rule(ZH, V.INTENTS_FINE, "'other'")} AS fine, {S.first_rule(ZH, V.INTENTS_COARSE, "'general_query'")} AS coarse,
 CASE {' '.join(f"WHEN regexp_matches({ZH}, {S.quote(p)}) THEN {S.quote(n)}" for n, p in V.INTENT_PATTERNS)} END AS pattern
FROM conversations""")
def _(t):
    zh = sinified(c("text"))
    return t.conversations.select(
        "conv_id", "turn", T.question_type(c("text")).alias("question_type"), T.intent_fine(zh).alias("fine"),
        T.intent_coarse(zh).alias("coarse"), T.intent_pattern(zh).alias("pattern"),
    )


@query("tx20_query_keywords", f"""
WITH w AS (SELECT conv_id, turn, list_filter(regexp_extract_all({ZH}, '[{S.CJK}]{{2,4}}'), lambda x: NOT list_contains({S.quoted(V.QUERY_STOPWORDS)}, x)) AS ws FROM conversations),
u AS (SELECT conv_id, turn, ws, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
d AS (SELECT conv_id, turn, word, min(pos) AS pos FROM u GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS rn FROM d)
SELECT conv_id, turn, string_agg(word, ' ' ORDER BY rn) AS keywords FROM r WHERE rn <= 5 GROUP BY ALL""")
def _(t):
    words = T.query_keywords(sinified(c("text")))
    return t.conversations.select("conv_id", "turn", F.array_join(words, " ").alias("keywords")).filter("keywords <> ''")


SQL_TYPE = S.first_rule(
    "word", V.TYPE_KEYWORDS, S.first_rule("word", [V.TYPE_KEYWORDS_FALLBACK], "NULL")
)


@query("tx21_keyword_entities", f"""
WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all({ZH}, '[{S.CJK}a-zA-Z0-9]{{2,8}}')) AS word FROM conversations)
SELECT conv_id, turn, word, {SQL_TYPE} AS type, 0.6::DOUBLE AS confidence FROM w WHERE {SQL_TYPE} IS NOT NULL""")
def _(t):
    words = F.regexp_extract_all(sinified(c("text")), F.lit(f"[{T.CJK}a-zA-Z0-9]{{2,8}}"), F.lit(0))
    return (
        t.conversations.select("conv_id", "turn", F.explode(words).alias("word"))
        .withColumn("type", T.entity_type_by_keyword(c("word")))
        .filter("type is not null")
        .withColumn("confidence", F.lit(0.6))
    )


DICT_SQL = """(SELECT p_partkey AS id, 'Colour' AS type, split_part(p_name, ' ', 1) AS name FROM part
 UNION ALL SELECT 0, 'Fragment', substr(text, 1, 4) FROM benchmark)"""


def name_dictionary(t):
    colours = t.part.select(F.lit("Colour").alias("type"), F.split("p_name", " ")[0].alias("name"))
    fragments = t.benchmark.select(F.lit("Fragment").alias("type"), F.substring("text", 1, 4).alias("name"))
    return colours.union(fragments).distinct()


@query("tx22_dictionary_match", f"""
WITH d AS (SELECT DISTINCT type, name FROM {DICT_SQL}),
m AS (SELECT doc_id, type, name, row_number() OVER (PARTITION BY doc_id, type ORDER BY length(name) DESC, name) AS rn
 FROM documents JOIN d ON contains(text, name))
SELECT doc_id, type, name FROM m WHERE rn = 1""")
def _(t):
    return D.longest_match(spread(t.documents.select("doc_id", "text")), name_dictionary(t), "doc_id", "text")


@query("tx23_dictionary_fallback", """
WITH d AS (SELECT DISTINCT substr(text, 1, 8) AS name, substr(text, 1, 4) AS synonym FROM benchmark),
direct AS (SELECT DISTINCT doc_id, name FROM documents JOIN d ON contains(text, name)),
other AS (SELECT DISTINCT doc_id, name FROM (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM direct)) x JOIN d ON contains(text, synonym))
SELECT doc_id, name, false AS by_synonym FROM direct UNION ALL SELECT doc_id, name, true FROM other""")
def _(t):
    names = t.benchmark.select(F.substring("text", 1, 8).alias("name"), F.substring("text", 1, 4).alias("synonym")).distinct()
    return D.match_with_synonyms(spread(t.documents.select("doc_id", "text")), names, "doc_id", "text")


WORDS_SQL = """(SELECT DISTINCT 'Part' AS type, unnest(string_split(p_name, ' ')) AS name FROM part
 UNION SELECT DISTINCT 'Item', unnest(list_filter(regexp_split_to_array(text, '[^\\pL]+'), lambda x: length(x) >= 6)) FROM benchmark)"""


def word_dictionary(t):
    """Every word of a part's name, and every word of six letters or more of the benchmark."""
    parts = t.part.select(F.lit("Part").alias("type"), F.explode(F.split("p_name", " ")).alias("name"))
    items = t.benchmark.select(F.lit("Item").alias("type"), F.explode(F.filter(F.split("text", "[^\\p{L}]+"), lambda x: F.length(x) >= 6)).alias("name"))
    return parts.union(items).distinct()


@query("tx22_dictionary_words", f"""
WITH m AS (SELECT doc_id, type, name, row_number() OVER (PARTITION BY doc_id, type ORDER BY length(name) DESC, name) AS rn FROM documents JOIN {WORDS_SQL} d ON contains(text, d.name))
SELECT doc_id, type, name FROM m WHERE rn = 1""")
def _(t):
    return D.longest_match(spread(t.documents.select("doc_id", "text")), word_dictionary(t), "doc_id", "text")


@query("tx23_synonym_words", """
WITH d AS (SELECT DISTINCT p_name AS name, unnest(string_split(p_name, ' ')) AS synonym FROM part),
direct AS (SELECT DISTINCT doc_id, name FROM documents JOIN d ON contains(text, name)),
other AS (SELECT DISTINCT doc_id, name FROM (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM direct)) x JOIN d ON contains(text, synonym))
SELECT doc_id, name, false AS by_synonym FROM direct UNION ALL SELECT doc_id, name, true FROM other""")
def _(t):
    names = t.part.select(c("p_name").alias("name"), F.explode(F.split("p_name", " ")).alias("synonym")).distinct()
    return D.match_with_synonyms(spread(t.documents.select("doc_id", "text")), names, "doc_id", "text")


@query("tx24_known_entities", f"""
WITH x AS (SELECT conv_id, turn, list_filter({S.quoted(['症状', '治疗', '检查'])}, lambda k: contains({ZH}, k)) AS found,
 list_filter(regexp_extract_all({ZH}, '[{S.CJK}]{{2,6}}'), lambda w: contains(w, '炎') OR contains(w, '病') OR contains(w, '症') OR contains(w, '瘤')) AS hinted FROM conversations)
SELECT conv_id, turn, array_to_string(CASE WHEN len(found) > 0 THEN found ELSE hinted[1:1] END, ' ') AS names FROM x""")
def _(t):
    names = T.match_known_entities(sinified(c("text")), known=["症状", "治疗", "检查"])
    return t.conversations.select("conv_id", "turn", F.array_join(names, " ").alias("names"))


SQL_KW = f"list_filter(regexp_extract_all({ZH}, '[{S.CJK}]{{2,4}}'), lambda x: NOT list_contains({S.quoted(V.QUERY_STOPWORDS)}, x))"


@query("tx25_26_bias_confidence", f"""
WITH x AS (SELECT conv_id, turn, turn % 3 AS n, {S.first_rule(ZH, V.INTENTS_FINE, "'other'")} AS intent, [role] AS kw FROM conversations),
y AS (SELECT *, least(1.0, 0.8 + CASE WHEN n > 0 THEN 0.1 ELSE 0 END + CASE WHEN intent <> 'other' THEN 0.1 ELSE 0 END)::DOUBLE AS confidence FROM x)
SELECT conv_id, turn, round(confidence, 4) AS confidence,
 array_to_string(CASE WHEN n = 0 OR confidence < 0.5 THEN list_concat(kw, {S.quoted(V.CARE_TERMS)})[1:10] ELSE kw END, ' ') AS keywords FROM y""")
def _(t):
    n = c("turn") % 3
    sure = T.parse_confidence(n, T.intent_fine(sinified(c("text"))))
    words = T.add_care_terms(F.array("role"), n, sure)
    return t.conversations.select(
        "conv_id", "turn", F.round(sure, 4).alias("confidence"), F.array_join(words, " ").alias("keywords")
    )


@query("tx28_29_tags_types", """
WITH x AS (SELECT p_partkey, p_name || CASE p_type WHEN 'ECONOMY' THEN '[疾病]' WHEN 'SMALL' THEN ' [症状] x' WHEN 'PROMO' THEN '[药物]' ELSE '' END AS raw,
 CASE p_type WHEN 'ECONOMY' THEN ' 手术 ' WHEN 'SMALL' THEN 'Gene' WHEN 'PROMO' THEN '别称' ELSE p_type END AS v FROM part)
SELECT p_partkey, CASE WHEN contains(raw, '[') THEN trim(split_part(raw, '[', 1)) ELSE raw END AS name,
 CASE regexp_extract(raw, '\\[([^\\]]*)\\]', 1) WHEN '疾病' THEN 'DISEASE' WHEN '症状' THEN 'SYMPTOM' END AS tag,
 CASE v WHEN ' 手术 ' THEN 'Surgery' WHEN 'Gene' THEN 'Gene' WHEN '别称' THEN 'Synonym' ELSE 'Disease' END AS entity_type,
 CASE v WHEN '别称' THEN 'HAS_SYNONYM' ELSE 'BELONGS_TO' END AS relation_type FROM x""")
def _(t):
    kind = c("p_type")
    suffix = F.when(kind == "ECONOMY", "[疾病]").when(kind == "SMALL", " [症状] x").when(kind == "PROMO", "[药物]").otherwise("")
    value = F.when(kind == "ECONOMY", " 手术 ").when(kind == "SMALL", "Gene").when(kind == "PROMO", "别称").otherwise(kind)
    raw = F.concat("p_name", suffix)
    return t.part.select(
        "p_partkey", T.entity_tag_name(raw).alias("name"), T.entity_tag_type(raw).alias("tag"),
        T.resolve_entity_type(value).alias("entity_type"), T.resolve_relation_type(value).alias("relation_type"),
    )


@query("tx27_merge_parses", f"""
WITH m AS (SELECT conv_id, turn, [role] AS entities, CASE WHEN role = 'user' THEN 'symptom' ELSE '' END AS intent, CAST([] AS VARCHAR[]) AS keywords FROM conversations WHERE turn % 2 = 0),
r AS (SELECT conv_id, turn, ['rule'] AS entities, {S.first_rule(ZH, V.INTENTS_FINE, "'other'")} AS intent, [role, 'rule', role] AS keywords FROM conversations)
SELECT conv_id, turn, coalesce(m.entities, r.entities) AS entities, coalesce(nullif(m.intent, ''), r.intent) AS intent,
 list_concat([r.keywords[1]], ['rule']) AS keywords,
 CASE WHEN m.intent = 'symptom' THEN 1.0 WHEN m.conv_id IS NOT NULL THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence
FROM r LEFT JOIN m USING (conv_id, turn)""")
def _(t):
    turns = t.conversations
    model = turns.filter("turn % 2 = 0").select(
        "conv_id", "turn", F.array("role").alias("entities"),
        F.when(c("role") == "user", "symptom").otherwise("").alias("intent"), F.array().cast("array<string>").alias("keywords"),
    )
    rules = turns.select(
        "conv_id", "turn", F.array(F.lit("rule")).alias("entities"), T.intent_fine(sinified(c("text"))).alias("intent"),
        F.array(c("role"), F.lit("rule"), c("role")).alias("keywords"),
    )
    return D.merge_parses(model, rules, ["conv_id", "turn"])


@query("tx30_31_steps_cards")
def _(t):
    content = F.translate(c("text"), ".", "。")
    sections = F.array(
        F.struct(c("source").alias("heading"), content.alias("content")), F.struct(c("lang").alias("heading"), F.lit("").alias("content"))
    )
    return t.documents.select("doc_id", T.sections_to_steps(sections).alias("steps"), T.sections_to_cards(sections).alias("cards"))


@query("tx32_durations", """
SELECT o_orderkey, CASE WHEN ms < 60000 THEN printf('%.0f', ms / 1000) || '秒' ELSE printf('%.1f', ms / 60000) || '分钟' END AS duration
FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS ms FROM orders)""")
def _(t):
    return t.orders.select("o_orderkey", T.duration_text(F.floor("o_totalprice")).alias("duration"))


@query("tx34_grades", """
WITH x AS (SELECT event_id, CASE event_type WHEN 'view' THEN '0.5' WHEN 'error' THEN 'none' ELSE CAST((event_id % 100) / 100 AS VARCHAR) END AS s, event_type FROM events)
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN try_cast(s AS DOUBLE) <= 0.25 THEN 0.0 WHEN try_cast(s AS DOUBLE) <= 0.75 THEN 0.5 ELSE 1.0 END::DOUBLE AS grade FROM x""")
def _(t):
    number = ((c("event_id") % 100) / 100).cast("string")
    score = F.when(c("event_type") == "view", '"0.5"').when(c("event_type") == "error", '"none"').otherwise(number)
    output = F.concat(F.lit('Sure:\n{"reason": "ok",\n "score": '), score, F.lit("}\nbye"))
    return t.events.select("event_id", T.grade_from_output(output).alias("grade"))


# --- chunking ------------------------------------------------------------------------------------------------------


def sql_windows(text, size, step):
    n = f"(CASE WHEN length({text}) <= {size} THEN 0 ELSE CAST(ceil((length({text}) - {size}) / {step}) AS BIGINT) END)"
    return f"list_transform(range(0, {n} + 1), lambda i: substr({text}, i * {step} + 1, {size}))"


BODY = S.strip("text")
SPLIT_LINES = f"list_filter(list_transform(string_split({BODY}, chr(10)), lambda x: {S.strip('x')}), lambda x: x <> '')"


@query("ch1_paragraphs", f"SELECT doc_id, unnest({SPLIT_LINES}) AS chunk, CAST(unnest(range(len({SPLIT_LINES}))) AS INT) AS chunk_index FROM documents")
def _(t):
    return C.chunk(spread(t.documents.select("doc_id", "text")), "paragraph", separator="\n")


@query("ch2_fixed", f"SELECT doc_id, unnest(w) AS chunk, CAST(unnest(range(len(w))) AS INT) AS chunk_index FROM (SELECT doc_id, {sql_windows(BODY, 1000, 900)} AS w FROM documents WHERE length({BODY}) > 0)")
def _(t):
    return C.chunk(spread(t.documents.select("doc_id", "text")), "fixed", size=1000, overlap=100)


def sql_blocks(pieces, source, size, last_fits, overlap, glue, tail="''", extra=0):
    """Greedy packing as SQL: the end of the block starting at each item, then the chain of starts."""
    miss = ">" if last_fits else ">="
    return f"""
WITH RECURSIVE p AS (SELECT doc_id, unnest(ps) AS piece, unnest(range(1, len(ps) + 1)) AS pos FROM (SELECT doc_id, {pieces} AS ps FROM {source})),
q AS (SELECT *, sum(length(piece) + {extra}) OVER (PARTITION BY doc_id ORDER BY pos) AS upto, count(*) OVER (PARTITION BY doc_id) AS n FROM p),
w AS (SELECT *, upto - length(piece) - {extra} + {size} AS bound FROM q),
e AS (SELECT w.doc_id, w.pos, w.n, greatest(w.pos + 1, coalesce(q.pos, w.n + 1)) AS stop
 FROM w ASOF LEFT JOIN q ON w.doc_id = q.doc_id AND q.upto {miss} w.bound),
b AS (SELECT doc_id, pos, stop, n, 0 AS k FROM e WHERE pos = 1
 UNION ALL SELECT e.doc_id, e.pos, e.stop, e.n, b.k + 1 FROM b JOIN e ON e.doc_id = b.doc_id AND e.pos = greatest(b.pos + 1, b.stop - {overlap}))
SELECT b.doc_id, CAST(k AS INT) AS chunk_index, {S.strip(f"string_agg(piece, {glue} ORDER BY p.pos)")} || {tail} AS chunk
FROM b JOIN p ON p.doc_id = b.doc_id AND p.pos >= b.pos AND p.pos < b.stop GROUP BY b.doc_id, k"""


PIECES = f"list_filter(regexp_extract_all({BODY}, '[^。！？.?!\\n]*[。！？.?!\\n]+|[^。！？.?!\\n]+$'), lambda x: {S.strip('x')} <> '')"
WORDS = f"list_filter(regexp_split_to_array(text, '{S.WS}+'), lambda x: x <> '')"


@query("ch3_sentence_blocks", sql_blocks(PIECES, "documents", 1000, True, 1, "''"))
def _(t):
    return C.chunk(spread(t.documents.select("doc_id", "text")), "smart", size=1000, overlap=1)


@query("ch4_word_blocks", sql_blocks(WORDS, "documents", 1000, True, 0, "' '", extra=1))
def _(t):
    return C.chunk(spread(t.documents.select("doc_id", "text")), "words", size=1000)


@query("ch5_extraction_paragraphs", sql_blocks(
    SQL_SENTENCES, f"(SELECT doc_id, {SQL_GRAPH_CLEAN} AS text FROM documents)", 1000, False, 0, "'。'", "'。'"))
def _(t):
    return C.chunk(spread(t.documents.select("doc_id", "text")).select("doc_id", T.graph_clean(c("text")).alias("text")), "extraction", size=1000)


CHUNKS = f"""(SELECT doc_id, source, lang, chunk_index, {S.strip('w')} AS chunk, doc_id || ':' || chunk_index AS chunk_id FROM
 (SELECT doc_id, source, lang, unnest(w) AS w, CAST(unnest(range(len(w))) AS INT) AS chunk_index FROM
  (SELECT doc_id, source, lang, {sql_windows('body', 1000, 900)} AS w FROM {CLEANED} WHERE length(body) > 0)) WHERE {S.strip('w')} <> '')"""


def chunk_rows(t):
    """Cleaned documents as chunk rows with their metadata; the input of the retrieval queries."""
    docs = cleaned(t).select("doc_id", "source", "lang", "text")
    return C.with_chunk_rows(C.chunk(docs, "fixed", size=1000, overlap=100), "doc_id")


@query("ch6_chunk_rows", f"SELECT doc_id, source, lang, chunk_index, chunk, chunk_id FROM {CHUNKS}")
def _(t):
    return chunk_rows(t)


CHUNK_TWINS = {"paragraph": "ch1_paragraphs", "fixed": "ch2_fixed", "smart": "ch3_sentence_blocks", "words": "ch4_word_blocks", "extraction": "ch5_extraction_paragraphs"}


@query("ud4_chunk_table", " UNION ALL BY NAME ".join(f"SELECT '{strategy}' AS strategy, * FROM ({all_sql()[name]})" for strategy, name in CHUNK_TWINS.items()))
def _(t):
    C.register_chunk_table(t.spark)
    docs = spread(t.documents.select("doc_id", "text"))
    cleaned = docs.select("doc_id", T.graph_clean(c("text")).alias("text"))
    parts = []
    for strategy, overlap in (("paragraph", 0), ("fixed", 100), ("smart", 1), ("words", 0), ("extraction", 0)):
        source = cleaned if strategy == "extraction" else docs
        parts.append(t.spark.sql(
            "SELECT :strategy AS strategy, * FROM chunk_table(TABLE({docs}), 'text', :strategy, 1000, :overlap, :separator)",
            args={"strategy": strategy, "overlap": overlap, "separator": "\n" if strategy == "paragraph" else ""}, docs=source))
    return reduce(DataFrame.unionByName, parts)
