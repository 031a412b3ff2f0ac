"""Source and build queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators import building as B
from loomwright.operators import chunking as C
from loomwright.plans import sqlkit as S
from loomwright.plans import text_queries as TQ
from loomwright.plans.registry import query
from loomwright.sources import corpus as CO
from loomwright.sources import stores as ST
from loomwright.sources.splits import spread

c = F.col
LINES = TQ.LINES


def files(t):
    """Documents as files: PDF text, JSON bodies of several shapes, plain text."""
    name = F.concat(F.lit("/in/uploads/"), c("doc_id").cast("string"), F.lit("/doc"))
    kind = F.when(c("lang") == "en", ".pdf").when(c("lang") == "fr", ".json").otherwise(".TXT")
    body = (
        F.when(c("doc_id") % 4 == 0, F.to_json(F.struct(F.lit("").alias("text"), c("text").alias("content")))).when(c("doc_id") % 4 == 1, F.to_json(F.struct("text")))
        .when(c("doc_id") % 4 == 2, F.concat(F.lit("{broken "), "text")).otherwise(F.to_json(F.struct(c("text").alias("body")))))
    value = F.when(c("lang") == "fr", body).when((c("lang") == "en") & (c("doc_id") % 5 == 0), F.concat(F.lit(" ERROR: "), "text")).otherwise(c("text"))
    return t.documents.select(F.concat(name, kind).alias("path"), value.alias("value"))


@query("src1_2_ingest", f"""WITH x AS (SELECT doc_id, lang, CASE WHEN lang = 'fr' AND doc_id % 4 = 2 THEN NULL ELSE {LINES} END AS lines, text FROM (SELECT doc_id, lang, {S.strip('text')} AS text FROM documents)),
y AS (SELECT doc_id, lang, text, {TQ.SQL_CLEAN} AS body FROM x)
SELECT '/in/uploads/' || doc_id || '/doc' || CASE lang WHEN 'en' THEN '.pdf' WHEN 'fr' THEN '.json' ELSE '.TXT' END AS path, CASE lang WHEN 'en' THEN 'pdf' WHEN 'fr' THEN 'json' ELSE 'txt' END AS source_type,
 CASE WHEN lang = 'en' AND doc_id % 5 = 0 THEN '' WHEN lang = 'fr' AND doc_id % 4 = 2 THEN '{{broken ' || {S.strip("text")} ELSE body END AS text FROM y""")
def _(t):
    return CO.ingest_documents(spread(files(t)))


@query("src3_assemble_pages", f"""WITH p AS (SELECT doc_id, unnest(lines) AS raw, unnest(range(len(lines))) AS n FROM (SELECT doc_id, {LINES} AS lines FROM documents)),
q AS (SELECT doc_id, n, {S.strip('raw')} AS raw FROM p)
SELECT CAST(doc_id AS VARCHAR) AS path, {S.strip("string_agg(CASE WHEN length(raw) < 50 AND n % 2 = 1 THEN 'ocr ' || n ELSE raw END, chr(10) || chr(10) ORDER BY n)")} AS text, count(*) FILTER (length(raw) < 50) AS sparse_pages FROM q GROUP BY doc_id""")
def _(t):
    pages = t.documents.select(c("doc_id").cast("string").alias("path"), F.posexplode(F.split(T.unify_newlines(c("text")), "\n")).alias("page_no", "text"))
    return CO.assemble_pages(pages.withColumn("ocr_text", F.when(c("page_no") % 2 == 1, F.concat(F.lit(" ocr "), c("page_no").cast("string"))).otherwise(" ")))


def _strip_tags(path: str, content: bytes) -> str:
    import re

    if path.endswith("1"):
        raise ValueError("unreadable")
    return re.sub(r"<[^>]*>", "", content.decode("utf-8"))


@query("src4_binary_extract", """SELECT url || '/' || page_id AS path, CASE WHEN page_id % 10 = 1 THEN 'ERROR: Line processing failed: unreadable' ELSE regexp_replace(html, '<[^>]*>', '', 'g') END AS text, page_id % 10 = 1 AS error FROM pages""")
def _(t):
    binary = t.pages.select(F.concat("url", F.lit("/"), c("page_id").cast("string")).alias("path"), c("html").cast("binary").alias("content"))
    return CO.extract_binary(binary, _strip_tags)


def shard_lines(t):
    path = F.concat(F.lit("/kg/uploads/f"), c("conv_id").cast("string"), F.lit("/t.pdf"))
    text = F.when(c("turn") % 4 == 3, F.concat(F.lit("ERROR: "), "role")).otherwise(c("text"))
    return t.conversations.select(c("turn").alias("pos"), F.when(c("turn") % 5 == 4, "no tab here").otherwise(F.concat(path, F.lit("\t"), text)).alias("value"))


SHARDS = "sh AS (SELECT '/kg/uploads/f' || conv_id || '/t.pdf' AS path, turn AS pos, CASE WHEN turn % 4 = 3 THEN 'ERROR: ' || role ELSE text END AS text FROM conversations WHERE turn % 5 <> 4)"


@query("src5_merge_shards", f"WITH {SHARDS} SELECT path, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS text, count(*) FILTER (starts_with(text, 'ERROR:')) AS errors FROM sh GROUP BY ALL")
def _(t):
    return CO.merge_shards(CO.parse_shards(shard_lines(t)))


@query("src5_dropped_lines", "SELECT count(*) AS dropped FROM conversations WHERE turn % 5 = 4")
def _(t):
    return CO.dropped_lines(CO.parse_shards(shard_lines(t)))


@query("src6_file_ids", f"WITH {SHARDS} SELECT path, pos, regexp_extract(path, 'uploads/([^/]*)/', 1) AS file_id FROM sh")
def _(t):
    return CO.file_ids(CO.parse_shards(shard_lines(t).filter("pos % 5 <> 4"))).select("path", "pos", "file_id")


@query("src6_all_file_ids", f"WITH {SHARDS} SELECT path, pos, regexp_extract(path, 'uploads/([^/]*)/', 1) AS file_id FROM sh")
def _(t):
    return CO.file_ids(CO.parse_shards(shard_lines(t)).filter("ok")).select("path", "pos", "file_id")


@query("src7_quarantine", f"WITH {SHARDS} SELECT path, pos, text, NOT starts_with(text, 'ERROR:') AS usable FROM sh")
def _(t):
    good, bad = CO.quarantine(CO.parse_shards(shard_lines(t)).filter("ok"))
    return good.withColumn("usable", F.lit(True)).unionByName(bad.withColumn("usable", F.lit(False))).select("path", "pos", "text", "usable")


@query("src8_triples", "SELECT p_partkey, p_name AS header, p_type AS relation, p_brand AS tail FROM part WHERE p_size % 2 = 0")
def _(t):
    line = F.when(c("p_size") % 2 == 0, F.concat_ws(", ", "p_name", "p_type", "p_brand")).otherwise(F.concat_ws(",", "p_name", "p_type"))
    return CO.triples_from_lines(t.part.select("p_partkey", line.alias("value")))


def import_documents(t):
    entities = F.array(F.struct(F.when(c("p_size") % 2 == 0, c("p_type")).otherwise("bad label").alias("type"), c("p_name").alias("name"), F.create_map(F.lit("brand"), c("p_brand")).alias("properties")))
    links = F.array(F.struct(c("p_name").alias("source"), c("p_brand").alias("target"), c("p_brand").alias("type"), F.create_map(F.lit("n"), c("p_size").cast("string")).alias("properties")))
    return t.part.select(F.to_json(F.struct(entities.alias("entities"), links.alias("relationships"))).alias("value"))


@query("src9_import", """SELECT 'node' AS kind, CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'Entity' END AS label, p_name AS a, p_brand AS b FROM part
UNION ALL SELECT 'edge', 'RELATED_TO', p_name, CAST(p_size AS VARCHAR) FROM part""")
def _(t):
    docs = import_documents(t)
    n = CO.import_entities(docs).select(F.lit("node").alias("kind"), "label", c("name").alias("a"), c("properties")["brand"].alias("b"))
    return n.union(CO.import_relationships(docs).select(F.lit("edge"), "predicate", "subject", c("properties")["n"]))


@query("src14_event_intake", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END AS task_id, '' AS session_id, event_type AS source, coalesce(CASE WHEN event_id % 2 = 0 THEN props END, '{}') AS params FROM events")
def _(t):
    none = F.lit(None).cast("string")
    raw = t.events.select("event_id", F.when(c("event_id") % 3 == 0, c("event_type")).alias("task_id"), none.alias("session_id"), c("event_type").alias("source"), F.when(c("event_id") % 2 == 0, c("props")).alias("params"))
    return ST.intake_events(raw)


@query("src15_questionnaire_intake", """SELECT event_id, '' AS task_id, '' AS session_id, event_type AS source, '[{"qid":"q1","value":' || (event_id % 7) || '}]' AS answers FROM events""")
def _(t):
    none = F.lit(None).cast("string")
    answers = F.array(F.struct(F.lit("q1").alias("qid"), (c("event_id") % 7).alias("value")))
    return ST.intake_questionnaires(t.events.select("event_id", none.alias("task_id"), none.alias("session_id"), c("event_type").alias("source"), answers.alias("answers")))


def store(t):
    rows = C.with_chunk_rows(C.chunk(t.documents.select("doc_id", "source", "lang", "text"), "fixed", size=1000, overlap=100), "doc_id")
    return rows.select("chunk_id", "doc_id", "chunk_index", "chunk", c("lang").alias("user_id"), c("source").alias("kb_id"))


CH = f"""ch AS (SELECT doc_id || ':' || chunk_index AS chunk_id, doc_id, chunk_index, {S.strip('w')} AS chunk, lang AS user_id, source AS kb_id FROM
 (SELECT doc_id, lang, source, unnest(w) AS w, CAST(unnest(range(len(w))) AS INT) AS chunk_index FROM (SELECT doc_id, lang, source, {TQ.sql_windows(TQ.BODY, 1000, 900)} AS w FROM documents WHERE length({TQ.BODY}) > 0)) WHERE {S.strip('w')} <> '')"""


@query("src17_upsert_chunks", f"WITH {CH} SELECT chunk_id, CASE WHEN chunk_index % 2 = 0 THEN 'new' ELSE chunk END AS chunk FROM ch")
def _(t):
    rows = store(t)
    return ST.upsert_chunks(rows, rows.filter("chunk_index % 2 = 0").withColumn("chunk", F.lit("new"))).select("chunk_id", "chunk")


@query("src18_delete_chunks", f"WITH {CH} SELECT chunk_id, (SELECT count(*) FROM ch WHERE kb_id = 'src1') AS deleted FROM ch WHERE kb_id <> 'src1'")
def _(t):
    rows = store(t)
    gone = c("kb_id") == "src1"
    return ST.delete_chunks(rows, gone).select("chunk_id").withColumn("deleted", ST.deleted_count(rows, gone).scalar())


@query("src19_reindex", f"""WITH {CH}, d AS (SELECT doc_id, lang, source, lower({TQ.BODY}) AS text FROM documents WHERE doc_id IN (SELECT doc_id FROM ch) AND lang <> 'en'),
r AS (SELECT doc_id, lang, source, unnest(w) AS w, CAST(unnest(range(len(w))) AS INT) AS i FROM (SELECT doc_id, lang, source, {TQ.sql_windows('text', 500, 450)} AS w FROM d))
SELECT doc_id || ':' || i AS chunk_id, {S.strip('w')} AS chunk, source AS kb_id FROM r WHERE {S.strip('w')} <> '' UNION ALL SELECT chunk_id, chunk, kb_id FROM ch WHERE user_id = 'en'""")
def _(t):
    docs = t.documents.select("doc_id", F.when(c("lang") == "en", "stranger").otherwise(c("lang")).alias("user_id"), F.lower("text").alias("text"))
    return ST.reindex(store(t), docs, size=500, overlap=50).select("chunk_id", "chunk", "kb_id")


@query("src20_manifest", "SELECT '/eeg/Subject' || s_suppkey || '_' || (s_nationkey % 2 + 1) || '.edf' AS path, 'Subject' || s_suppkey AS subject, CAST(s_nationkey % 2 + 1 AS INT) AS part, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS age FROM supplier")
def _(t):
    path = F.concat(F.lit("/eeg/Subject"), c("s_suppkey").cast("string"), F.lit("_"), (c("s_nationkey") % 2 + 1).cast("string"), F.lit(".edf"))
    known = t.supplier.filter("s_suppkey % 2 = 0").select(F.concat(F.lit("Subject"), c("s_suppkey").cast("string")).alias("subject"), c("s_nationkey").alias("age"))
    return ST.recording_manifest(t.supplier.select(path.alias("path")), known)


# --- whole lineages ------------------------------------------------------------------------------------------------


MERGED = f"(WITH {SHARDS}, m AS (SELECT path, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS text FROM sh GROUP BY ALL) SELECT path AS doc_id, {TQ.SQL_CLEAN} AS text FROM (SELECT path, {LINES} AS lines FROM m WHERE NOT starts_with({S.strip('text')}, 'ERROR:')))"


@query("ch7_prepare_corpus", f"""SELECT doc_id AS path, chunk_index, chunk, doc_id || '_chunk_' || chunk_index AS chunk_id FROM ({TQ.sql_blocks(TQ.WORDS, MERGED, 1000, True, 0, "' '", extra=1)})""")
def _(t):
    return B.prepare_corpus(shard_lines(t))


@query("ch7_stage_counts", f"SELECT (SELECT count(DISTINCT conv_id) FROM conversations WHERE turn % 5 <> 4) AS extracted, (SELECT count(*) FROM {MERGED}) AS cleaned, (SELECT count(*) FROM conversations WHERE turn % 5 = 4) AS dropped, (SELECT count(*) FROM ({TQ.sql_blocks(TQ.WORDS, MERGED, 1000, True, 0, "' '", extra=1)})) AS chunks")
def _(t):
    return B.stage_counts(shard_lines(t))


# Words and types the stand-in extractor looks for.
TERMS = {"the": "Disease", "tion": "Symptom", "und": "疾病", "que": "Medicine", "les": "nothing", "ing": "症状"}
PARAGRAPHS = TQ.sql_blocks(TQ.SQL_SENTENCES, f"(SELECT doc_id, {TQ.SQL_GRAPH_CLEAN} AS text FROM documents)", 1000, False, 0, "'。'", "'。'")
FOUND = f"""par AS ({PARAGRAPHS}), f AS (SELECT doc_id, chunk_index, list_filter({S.quoted(TERMS)}, lambda w: contains(chunk, w)) AS ws FROM par),
ent AS (SELECT DISTINCT doc_id, unnest(ws) AS name FROM f), rel AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || '>' || ws[i + 1])) AS pair FROM f),
sen AS (SELECT doc_id, len({TQ.SQL_SENTENCES}) AS n FROM (SELECT doc_id, {TQ.SQL_GRAPH_CLEAN} AS text FROM documents))"""


@query("kg6_build_counts", f"""WITH {FOUND} SELECT CAST(doc_id AS VARCHAR) AS doc_id, n AS sentences, (SELECT count(*) FROM par p WHERE p.doc_id = s.doc_id) AS paragraphs, (SELECT count(*) FROM ent e WHERE e.doc_id = s.doc_id) AS entities,
 (SELECT count(*) FROM rel r WHERE r.doc_id = s.doc_id) AS relations FROM sen s WHERE n > 0""")
def _(t):
    return B.GraphBuild(spread(t.documents), B.dictionary_extractor(TERMS)).counts()


@query("tx33_parse_outputs", """SELECT CAST(event_id AS VARCHAR) AS unit_id, CASE WHEN event_id % 4 = 3 THEN 'empty' WHEN event_id % 4 = 0 THEN 'ok' ELSE 'repaired' END AS status, CASE WHEN event_id % 4 = 3 THEN 0 ELSE 1 END AS n_entities,
 CASE WHEN event_id % 4 <> 3 THEN event_type END AS name FROM events""")
def _(t):
    entity = F.concat(F.lit('{"entities": [{"name": "'), "event_type", F.lit('", "type": "疾病"}'))
    output = (
        F.when(c("event_id") % 4 == 0, F.concat(F.lit("```json\n"), entity, F.lit("]}\n```"))).when(c("event_id") % 4 == 1, entity)
        .when(c("event_id") % 4 == 2, F.concat(F.lit("Sure: "), entity, F.lit("]} done"))).otherwise(F.concat(F.lit("no json "), "event_type")))
    parsed = B.parse_outputs(t.events.select(c("event_id").alias("unit_id"), output.alias("output")))
    return parsed.select("unit_id", "status", F.size("entities").alias("n_entities"), F.get("entities", F.lit(0))["name"].alias("name"))
