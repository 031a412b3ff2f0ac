"""Retrieval queries: label centroids as question vectors, part names and conversation turns as questions."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.functions import vectors as VEC
from loomwright.operators import retrieval as R
from loomwright.plans import graph_queries as GQ
from loomwright.plans import sqlkit as S
from loomwright.plans import text_queries as TQ
from loomwright.plans.registry import query
from loomwright.sources.splits import spread

c = F.col


def vectors(t):
    return t.embeddings.select(c("vec_id").alias("id"), "embedding", "label")


def centroids(t):
    """The mean vector of every label, used as one question each."""
    means = t.embeddings.groupBy("label").agg(Summarizer.mean(array_to_vector("embedding")).alias("m"))
    return means.select(c("label").alias("query_id"), "label", vector_to_array("m").alias("embedding"))


CENT = """d AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT label, unnest(e) AS x, unnest(range(len(e))) AS i FROM d), m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY ALL),
cent AS (SELECT label AS query_id, list(x ORDER BY i) AS q FROM m GROUP BY ALL),
near AS (SELECT query_id, vec_id AS id, d.label, 1 - list_cosine_similarity(e, q) AS distance FROM cent, d)"""


@query("rt1_cosine", f"WITH {CENT} SELECT id, round(1 - distance, 6) AS similarity FROM near WHERE query_id = label")
def _(t):
    joined = vectors(t).join(centroids(t).select("label", c("embedding").alias("q")), "label")
    return joined.select("id", F.round(VEC.cosine(c("embedding"), c("q")), 6).alias("similarity"))


@query("rt2_vector_top_k", f"WITH {CENT} SELECT query_id, id, round(distance, 6) AS distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INT) AS rank FROM near QUALIFY rank <= 10")
def _(t):
    return R.vector_top_k(vectors(t), centroids(t), 10).withColumn("distance", F.round("distance", 6))


@query("rt2_5_vector_top_k_filtered", f"WITH {CENT} SELECT query_id, id, round(distance, 6) AS distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INT) AS rank FROM near WHERE label = query_id QUALIFY rank <= 5")
def _(t):
    return R.vector_top_k(vectors(t), centroids(t), 5, same=["label"]).withColumn("distance", F.round("distance", 6))


@query("rt3_node_vector_search", f"""WITH {CENT} SELECT query_id, 'vector' AS type, id AS node_id, p_name AS name, round(1 - distance, 6) AS relevance_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INT) AS rank
FROM near JOIN part ON p_partkey = id QUALIFY rank <= 5""")
def _(t):
    known = t.part.select(c("p_partkey").alias("id"), c("p_name").alias("name"), c("p_brand").alias("description"))
    with_node = vectors(t).join(known.select("id"), "id", "left_semi")
    found = R.node_vector_search(with_node, known, centroids(t), 5)
    return found.drop("description").withColumn("relevance_score", F.round("relevance_score", 6))


def docs(t):
    return spread(t.documents).select(c("doc_id").alias("id"), c("source").alias("name"), c("text").alias("description"))


@query("rt4_keyword_search", """WITH w AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(text, '[^\\pL]+'), lambda x: length(x) >= 7)) AS keyword FROM benchmark),
p AS (SELECT DISTINCT query_id, doc_id FROM w JOIN documents ON contains(source || chr(10) || text, keyword))
SELECT query_id, doc_id AS node_id, 0.5::DOUBLE AS relevance_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS INT) AS rank FROM p QUALIFY rank <= 5""")
def _(t):
    words = F.filter(F.split("text", "[^\\p{L}]+"), lambda x: F.length(x) >= 7)
    keywords = t.benchmark.select(c("item_id").alias("query_id"), F.explode(words).alias("keyword"))
    return R.keyword_search(keywords, docs(t)).select("query_id", "node_id", "relevance_score", "rank")


@query("rt5_metadata_filter", "SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src1'")
def _(t):
    rows = t.documents.select("doc_id", c("lang").alias("user_id"), c("source").alias("source_type"), F.lit("kb").alias("kb_id"))
    return rows.filter(R.chunk_filter("en", "src1", "default")).select("doc_id")


ITEMS = """it AS (SELECT o_custkey AS query_id, CASE o_orderstatus WHEN 'F' THEN 'graph' WHEN 'O' THEN 'doc' ELSE 'keyword' END AS source, o_orderkey % 7 AS k, o_totalprice, o_orderkey FROM orders),
rk AS (SELECT query_id, source, k, CAST(row_number() OVER (PARTITION BY query_id, source ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rank FROM it),
items AS (SELECT query_id, source, rank, CASE WHEN k < 5 THEN 'graph:' ELSE source || ':' END || k AS content_key, 'text ' || source || ' ' || k AS content FROM rk WHERE rank <= 15)"""


def items(t):
    """Orders of a customer as ranked hits of three routes; some keys are shared between the routes."""
    from loomwright.operators.ranking import first_n

    source = F.when(c("o_orderstatus") == "F", "graph").when(c("o_orderstatus") == "O", "doc").otherwise("keyword")
    rows = t.orders.select(c("o_custkey").alias("query_id"), source.alias("source"), (c("o_orderkey") % 7).alias("k"), "o_totalprice", "o_orderkey")
    ranked = first_n(rows, ["query_id", "source"], [F.desc("o_totalprice"), c("o_orderkey")], R.PER_ROUTE)
    prefix = F.when(c("k") < 5, "graph:").otherwise(F.concat("source", F.lit(":")))
    return ranked.select("query_id", "source", "rank", F.concat(prefix, c("k").cast("string")).alias("content_key"), F.concat_ws(" ", F.lit("text"), "source", c("k").cast("string")).alias("content"))


@query("rt6_route_items", """WITH h AS (SELECT o_custkey AS query_id, o_orderkey, o_orderpriority, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rank FROM orders)
SELECT query_id, 'graph' AS source, rank, CASE WHEN o_orderkey % 3 = 0 THEN 'graph:path:a_' || o_orderkey ELSE 'graph:' || o_orderkey END AS content_key,
 CASE WHEN o_orderkey % 3 = 0 THEN 'n | 路径: a -> ' || o_orderkey || ' | 路径节点: a -> b | 关系: HAS' ELSE 'n | ' || o_orderpriority || ' | (2跳邻居) | 路径: a -> b | 关系: HAS' END AS content FROM h WHERE rank <= 15
UNION ALL SELECT query_id, 'doc', rank, 'doc:' || o_orderkey, o_orderpriority FROM h WHERE rank <= 15
UNION ALL SELECT query_id, 'keyword', rank, 'keyword:' || o_orderkey, o_orderpriority FROM h WHERE rank <= 15""")
def _(t):
    from loomwright.operators.ranking import first_n

    top = first_n(t.orders, ["o_custkey"], [F.desc("o_totalprice"), c("o_orderkey")], R.PER_ROUTE)
    key = c("o_orderkey").cast("string")
    path = c("o_orderkey") % 3 == 0
    hits = top.select(
        c("o_custkey").alias("query_id"), "rank", F.when(path, "path").otherwise("neighbor").alias("type"), F.when(~path, key).alias("node_id"), F.lit("n").alias("name"),
        F.when(~path, c("o_orderpriority")).alias("description"), F.lit("a").alias("start_entity"), key.alias("end_entity"), F.array(F.lit("a"), F.lit("b")).alias("path_names"),
        F.array(F.lit("HAS")).alias("relation_types"), F.lit(2).alias("hop_count"))
    plain = top.select(c("o_custkey").alias("query_id"), "rank", key.alias("chunk_id"), key.alias("node_id"), c("o_orderpriority").alias("text"), F.lit("").alias("description"), c("o_orderpriority").alias("name"))
    return R.graph_items(hits).union(R.doc_items(plain)).union(R.keyword_items(plain))


RRF = f"""{ITEMS}, o AS (SELECT *, CASE source WHEN 'graph' THEN 0 WHEN 'doc' THEN 1 ELSE 2 END AS route FROM items),
f AS (SELECT query_id, content_key, sum(1 / (60 + rank)) AS s, min((route, rank)) AS o, arg_min(source, (route, rank)) AS source, arg_min(content, (route, rank)) AS content FROM o GROUP BY ALL),
fused AS (SELECT query_id, content_key, source, content, round(s, 10) AS rrf_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, o) AS INT) AS place FROM f QUALIFY place <= 10)"""


@query("rt7_rrf", f"WITH {RRF} SELECT query_id, content_key, source, content, rrf_score FROM fused WHERE place <= 45")
def _(t):
    return R.rrf(items(t), top_k=10).drop("place").withColumn("rrf_score", F.round("rrf_score", 10))


def questions(t):
    """Customers asking about themselves, and some about their nation or a region as well; a label's centroid is the vector.

    Some have no entity, some no vector, some keywords that nothing holds, and a few none of them.
    """
    labels = centroids(t).select(c("label").cast("bigint").alias("_l"), "embedding")
    n = labels.select(F.count("*")).scalar()
    k = c("c_custkey")
    named = t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey")).join(t.region, k % 5 == c("r_regionkey"))
    second = F.when(k % 4 == 1, c("n_name")).when(k % 4 == 3, c("r_name"))
    asked = named.select(
        k.alias("query_id"), F.concat(F.lit("ask "), "c_mktsegment").alias("text"), F.when(k % 2 == 0, "symptom").otherwise("other").alias("intent"),
        F.when(k % 5 != 0, F.array_compact(F.array("c_name", second))).otherwise(F.array().cast("array<string>")).alias("entities"),
        F.when(k % 3 == 0, F.array(F.lower("c_mktsegment"))).otherwise(F.array(c("c_mktsegment"))).alias("keywords"), F.when(k % 7 != 0, k % n).alias("_l"))
    return asked.join(labels, "_l", "left").drop("_l")


# the vectors' part under another name: the graph's part has a table ``near`` too
CENT_ALL = CENT.replace("near AS (", "near_all AS (")
ASKED = """q AS (SELECT c_custkey AS query_id, 'ask ' || c_mktsegment AS text, CASE WHEN c_custkey % 5 = 0 THEN [] WHEN c_custkey % 4 = 1 THEN [c_name, n_name] WHEN c_custkey % 4 = 3 THEN [c_name, r_name] ELSE [c_name] END AS entities,
 CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS keyword, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % (SELECT count(*) FROM cent) END AS label
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON c_custkey % 5 = r_regionkey)"""

# entities, the first 50 paths of one or two edges per question, and the shortest paths of up to two edges between entities
GRAPH_ROUTE = """found AS (SELECT query_id, id, nodes.name, description FROM (SELECT query_id, unnest(entities) AS name FROM q) JOIN nodes USING (name)),
g1 AS (SELECT query_id, t AS e, [edge_id] AS es, [found.id, t] AS ns, [found.name, o.name] AS names, [rel] AS rs, o.name, o.description FROM found JOIN two ON f = found.id JOIN nodes o ON o.id = t),
g2 AS (SELECT query_id, t AS e, list_append(es, edge_id) AS es, list_append(ns, t) AS ns, list_append(names, o.name) AS names, list_append(rs, rel) AS rs, o.name, o.description FROM g1 JOIN two ON f = e AND NOT list_contains(es, edge_id) JOIN nodes o ON o.id = t),
near AS (SELECT * FROM (SELECT * FROM g1 UNION ALL SELECT * FROM g2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY len(es), name, ns, es) <= 50),
st AS (SELECT f, t, min(rel) AS rel FROM two GROUP BY ALL),
asked AS (SELECT a.query_id, a.id AS s, b.id AS g, a.name AS sn, b.name AS gn FROM found a JOIN found b ON a.query_id = b.query_id AND a.name <> b.name AND a.id <> b.id),
one AS (SELECT asked.*, 1 AS d, [rel] AS rs, [sn, gn] AS names FROM asked JOIN st ON f = s AND t = g),
mid AS (SELECT query_id, s, g, sn, gn, min(x.t) AS m FROM asked JOIN st x ON x.f = s JOIN st y ON y.f = g AND y.t = x.t GROUP BY ALL),
links AS (SELECT * FROM one UNION ALL SELECT mid.query_id, s, g, sn, gn, 2, [x.rel, y.rel], [sn, o.name, gn] FROM mid ANTI JOIN one USING (query_id, s, g) JOIN st x ON x.f = s AND x.t = m JOIN st y ON y.f = g AND y.t = m JOIN nodes o ON o.id = m),
top_links AS (SELECT * FROM links QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, sn, gn, s, g) <= 10),
all_hits AS (SELECT query_id, id AS key, 'entity' AS type, id AS node_id, name, description, NULL AS sn, NULL AS gn, NULL AS rs, NULL AS names, 0 AS hop, 1.0::DOUBLE AS score, '' AS pos FROM found
 UNION ALL SELECT query_id, e, 'neighbor', e, name, description, NULL, NULL, rs, names, len(es), 1 / (1 + 0.3::DOUBLE * len(es)), array_to_string(es, '>') FROM near
 UNION ALL SELECT query_id, 'path:' || sn || '->' || gn, 'path', NULL, NULL, NULL, sn, gn, rs, names, NULL, 1 / (1 + 0.2::DOUBLE * d), s || '>' || g FROM top_links),
best_hits AS (SELECT * FROM all_hits QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY score DESC, pos) = 1),
graph_hits AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS INT) AS rank FROM best_hits)"""

WORD_ROUTE = """words_of AS (SELECT DISTINCT keyword FROM q UNION SELECT unnest(string_split(text, ' ')) FROM q),
held AS (SELECT keyword, id, name, description FROM words_of JOIN nodes ON contains(name || chr(10) || description, keyword) QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY id) <= 15)"""

TO_ITEM = """'graph' AS source, rank, CASE WHEN node_id IS NOT NULL THEN 'graph:' || node_id ELSE 'graph:path:' || sn || '_' || gn END AS content_key,
 concat_ws(' | ', nullif(name, ''), nullif(description, ''), CASE WHEN type = 'path' THEN '路径: ' || sn || ' -> ' || gn END, CASE WHEN type = 'path' THEN '路径节点: ' || array_to_string(names, ' -> ') END,
  CASE WHEN type = 'neighbor' THEN '(' || hop || '跳邻居)' END, CASE WHEN type = 'neighbor' THEN '路径: ' || array_to_string(names, ' -> ') END, CASE WHEN type <> 'entity' THEN '关系: ' || array_to_string(rs, ', ') END) AS content"""


@query("rt8_graph_hits", f"""WITH {GQ.GRAPH}, {CENT_ALL}, {ASKED}, {GRAPH_ROUTE} SELECT query_id, key, type, name, sn AS start_entity, gn AS end_entity, array_to_string(rs, '>') AS relations, array_to_string(names, '>') AS names, round(score, 10) AS relevance_score, rank
FROM graph_hits WHERE rank <= 15""")
def _(t):
    hits = R.graph_route(questions(t), GQ.nodes(t), GQ.edges(t))
    joined = lambda name: F.when(F.size(name) > 0, F.array_join(name, ">"))
    return hits.select(
        "query_id", "key", "type", "name", "start_entity", "end_entity", joined("relation_types").alias("relations"), joined("path_names").alias("names"),
        F.round("relevance_score", 10).alias("relevance_score"), "rank")


@query("rt8_hybrid", f"""WITH {GQ.GRAPH}, {CENT_ALL}, {ASKED}, {GRAPH_ROUTE}, {WORD_ROUTE},
vec AS (SELECT q.query_id, id, CAST(row_number() OVER (PARTITION BY q.query_id ORDER BY round(distance, 12), id) AS INT) AS rank FROM q JOIN near_all n ON n.query_id = q.label QUALIFY rank <= 15),
found_words AS (SELECT query_id, id, name, description, CAST(row_number() OVER (PARTITION BY query_id ORDER BY id) AS INT) AS rank FROM q JOIN held USING (keyword) QUALIFY rank <= 15),
items AS (SELECT query_id, {TO_ITEM} FROM graph_hits WHERE rank <= 15 UNION ALL SELECT query_id, 'doc', rank, 'doc:' || id, 'chunk ' || id FROM vec
 UNION ALL SELECT query_id, 'keyword', rank, 'keyword:' || id, coalesce(nullif(description, ''), name) FROM found_words),
again AS (SELECT DISTINCT query_id, id, name, description FROM (SELECT query_id, unnest(string_split(text, ' ')) AS keyword FROM q WHERE query_id NOT IN (SELECT query_id FROM items)) JOIN held USING (keyword)),
rescue AS (SELECT query_id, 'keyword' AS source, CAST(row_number() OVER (PARTITION BY query_id ORDER BY id) AS INT) AS rank, 'keyword:' || id AS content_key, coalesce(nullif(description, ''), name) AS content FROM again QUALIFY rank <= 15),
fused AS (SELECT *, 1 / (60::DOUBLE + rank) AS s, CASE source WHEN 'graph' THEN 0 WHEN 'doc' THEN 1 ELSE 2 END AS route FROM (SELECT * FROM items UNION ALL SELECT * FROM rescue))
SELECT query_id, content_key, source, content, round(s, 10) AS rrf_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, route, rank) AS INT) AS place FROM fused QUALIFY place <= 10""")
def _(t):
    chunks = vectors(t).select("id", F.concat(F.lit("chunk "), c("id").cast("string")).alias("text"), "embedding")
    return R.hybrid(questions(t), GQ.nodes(t), GQ.edges(t), chunks, top_k=10).withColumn("rrf_score", F.round("rrf_score", 10))


@query("rt9_fallback", f"""WITH q AS (SELECT page_id AS query_id, url AS text FROM pages), w AS (SELECT query_id, unnest(list_filter(regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}\\pL\\pN_]+'), lambda x: length(x) >= 2)[1:5]) AS keyword FROM q WHERE query_id % 2 = 1),
p AS (SELECT DISTINCT query_id, doc_id FROM w JOIN documents ON contains(source || chr(10) || text, keyword))
SELECT query_id, doc_id AS node_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS INT) AS rank FROM p QUALIFY rank <= 5""")
def _(t):
    asked = t.pages.select(c("page_id").alias("query_id"), c("url").alias("text"))
    answered = asked.filter("query_id % 2 = 0").select("query_id")
    return R.fallback_search(asked, answered, docs(t)).select("query_id", "node_id", "rank")


@query("rt10_two_route", f"""WITH {GQ.GRAPH}, {CENT_ALL}, {ASKED}, {GRAPH_ROUTE}, {WORD_ROUTE},
vec AS (SELECT q.query_id, 'p' || id AS id, distance FROM q JOIN near_all n ON n.query_id = q.label QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY round(distance, 12), 'p' || id) <= 5),
main AS (SELECT query_id, key, type, name, sn, gn, score FROM graph_hits WHERE rank <= 5 UNION ALL SELECT query_id, id, 'vector', name, NULL, NULL, 1 - round(distance, 12) FROM vec JOIN nodes USING (id)),
empty AS (SELECT * FROM q WHERE query_id NOT IN (SELECT query_id FROM main)),
by_word AS (SELECT query_id, id, name FROM empty JOIN held USING (keyword) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY id) <= 5),
again AS (SELECT DISTINCT query_id, id, name FROM (SELECT query_id, unnest(string_split(text, ' ')) AS keyword FROM empty WHERE query_id NOT IN (SELECT query_id FROM by_word)) JOIN held USING (keyword) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY id) <= 5),
every AS (SELECT * FROM main UNION ALL SELECT query_id, id, 'keyword', name, NULL, NULL, 0.5 FROM by_word UNION ALL SELECT query_id, id, 'keyword', name, NULL, NULL, 0.5 FROM again),
best AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY score DESC, type) = 1)
SELECT query_id, key, type, name, sn AS start_entity, gn AS end_entity, round(score, 6) AS relevance_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS INT) AS rank FROM best QUALIFY rank <= 10""")
def _(t):
    node_vectors = t.embeddings.select(F.expr("'p' || vec_id").alias("id"), "embedding")
    found = R.two_route(questions(t), GQ.nodes(t), GQ.edges(t), node_vectors, top_k=5)
    return found.select("query_id", "key", "type", "name", "start_entity", "end_entity", F.round("relevance_score", 6).alias("relevance_score"), "rank")


HITS = """hits AS (SELECT o_custkey AS query_id, o_orderpriority AS name, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 50 AS VARCHAR) END AS node_id, round(o_totalprice / 600000, 4) AS s FROM orders)"""


def hits(t):
    return t.orders.select(
        c("o_custkey").alias("query_id"), c("o_orderpriority").alias("name"), F.when(c("o_orderkey") % 4 != 0, (c("o_orderkey") % 50).cast("string")).alias("node_id"),
        F.round(c("o_totalprice") / 600000, 4).alias("relevance_score"), F.lit("vector").alias("type"))


@query("rt11_dedupe_best", f"WITH {HITS} SELECT query_id, coalesce(node_id, name) AS key, max(s) AS relevance_score FROM hits GROUP BY ALL")
def _(t):
    return R.dedupe_best(hits(t)).select("query_id", "key", "relevance_score")


CTX = """h AS (SELECT o_custkey AS query_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rank, o_orderpriority AS name, repeat(o_orderpriority || ' ', 5) AS description,
 round(o_totalprice / 600000, 2) AS s FROM orders QUALIFY rank <= 15),
x AS (SELECT *, chr(10) || '[' || rank || '] ' || name || ' (Order) [相关度: ' || printf('%.2f', s) || ']' || chr(10) || '描述: ' || description || chr(10) AS txt FROM h),
y AS (SELECT *, sum(length(txt)) OVER (PARTITION BY query_id ORDER BY rank) + length('查询意图: symptom') + 8 AS upto FROM x),
k AS (SELECT query_id, string_agg(txt, '' ORDER BY rank) AS body FROM y WHERE upto <= 600 GROUP BY ALL)"""


def context_hits(t):
    from loomwright.operators.ranking import first_n

    top = first_n(t.orders, ["o_custkey"], [F.desc("o_totalprice"), c("o_orderkey")], 15)
    return top.select(
        c("o_custkey").alias("query_id"), "rank", c("o_orderpriority").alias("name"), F.repeat(F.concat("o_orderpriority", F.lit(" ")), 5).alias("description"),
        F.array(F.lit("Order")).alias("labels"), F.round(c("o_totalprice") / 600000, 2).alias("relevance_score"))


@query("rt12_context", f"""WITH {CTX} SELECT c_custkey AS query_id, CASE WHEN c_custkey NOT IN (SELECT query_id FROM h) THEN '未找到相关信息。' ELSE '查询意图: symptom' || chr(10) || chr(10) || '相关知识:' || chr(10) || coalesce(body, '') END AS context
FROM customer LEFT JOIN k ON query_id = c_custkey""")
def _(t):
    asked = t.customer.select(c("c_custkey").alias("query_id"), F.lit("symptom").alias("intent"))
    return R.context(context_hits(t), asked, budget=600)


LABELLED = """labelled AS (SELECT g.*, CASE WHEN node_id IS NOT NULL THEN o.type END AS label FROM graph_hits g LEFT JOIN nodes o ON o.id = node_id WHERE rank <= 15)"""


def labelled_hits(t):
    hits = R.graph_route(questions(t), GQ.nodes(t), GQ.edges(t))
    kinds = GQ.nodes(t).select(c("id").alias("node_id"), F.array("type").alias("labels"))
    return hits.join(kinds, "node_id", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


@query("rt12_context_paths", f"""WITH {GQ.GRAPH}, {CENT_ALL}, {ASKED}, {GRAPH_ROUTE}, {LABELLED}, head AS (SELECT query_id, '查询意图: ' || CASE WHEN query_id % 2 = 0 THEN 'symptom' ELSE 'other' END || chr(10) || chr(10) || '相关知识:' || chr(10) AS h FROM q),
x AS (SELECT *, chr(10) || '[' || rank || '] ' || coalesce(name, '未知') || coalesce(' (' || label || ')', '') || ' [相关度: ' || printf('%.2f', score) || ']' || chr(10) || CASE WHEN coalesce(description, '') <> '' THEN '描述: ' || description || chr(10) ELSE '' END
 || CASE type WHEN 'neighbor' THEN '路径距离: ' || hop || ' 跳' || chr(10) WHEN 'path' THEN '关系路径: ' || array_to_string(names, ' -> ') || chr(10) ELSE '' END AS txt FROM labelled),
y AS (SELECT x.*, h, sum(length(txt)) OVER (PARTITION BY x.query_id ORDER BY rank) + length(h) AS upto FROM x JOIN head USING (query_id)), k AS (SELECT query_id, string_agg(txt, '' ORDER BY rank) AS body FROM y WHERE upto <= 500 GROUP BY ALL)
SELECT query_id, CASE WHEN query_id NOT IN (SELECT query_id FROM labelled) THEN '未找到相关信息。' ELSE h || coalesce(body, '') END AS context FROM head LEFT JOIN k USING (query_id)""")
def _(t):
    return R.context(labelled_hits(t), questions(t), budget=500, text=R.hit_text(with_paths=True))


@query("rt12_graph_context", f"""WITH {GQ.GRAPH}, {CENT_ALL}, {ASKED}, {GRAPH_ROUTE}, {LABELLED},
x AS (SELECT *, CASE type WHEN 'entity' THEN '实体：' || name || ' (' || label || ')' || chr(10) || CASE WHEN coalesce(description, '') <> '' THEN '描述：' || description || chr(10) ELSE '' END
 WHEN 'neighbor' THEN '相关实体：' || name || ' (距离: ' || hop || ' 跳)' || chr(10) || '路径：' || array_to_string(names, ' -> ') || chr(10) ELSE '路径：' || sn || ' -> ' || gn || chr(10) || '关系：' || array_to_string(rs, ' -> ') || chr(10) END || chr(10) AS txt FROM labelled),
y AS (SELECT *, sum(length(txt)) OVER (PARTITION BY query_id ORDER BY rank) AS upto FROM x), k AS (SELECT query_id, string_agg(txt, '' ORDER BY rank) AS body FROM y WHERE upto <= 400 GROUP BY ALL)
SELECT query_id, coalesce(body, '') AS context FROM q LEFT JOIN k USING (query_id)""")
def _(t):
    return R.graph_context(labelled_hits(t), questions(t), budget=400)


@query("rt13_answer_confidence", """WITH g AS (SELECT o_custkey, count(*) AS n, avg(round(o_totalprice / 600000, 2)) AS a FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 15 GROUP BY ALL)
SELECT c_custkey AS query_id, CASE WHEN n IS NULL THEN 0.0 ELSE round(least(1.0, (0.5 + CASE WHEN n >= 5 THEN 0.2 WHEN n >= 3 THEN 0.1 ELSE 0 END + a * 0.2 + (c_custkey % 10) / 10) / 2), 10) END::DOUBLE AS confidence
FROM customer LEFT JOIN g ON o_custkey = c_custkey""")
def _(t):
    asked = t.customer.select(c("c_custkey").alias("query_id"), ((c("c_custkey") % 10) / 10).alias("confidence"))
    return R.answer_confidence(context_hits(t), asked).withColumn("confidence", F.round("confidence", 10))


@query("rt14_sources", "SELECT conv_id AS query_id, role AS type, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' WHEN text = '' THEN '来源' ELSE text END AS name, turn::DOUBLE AS relevance_score FROM conversations")
def _(t):
    rows = t.conversations.select(c("conv_id").alias("query_id"), c("role").alias("source"), c("text").alias("content"), c("turn").cast("double").alias("rrf_score"), c("turn").cast("string").alias("content_key"))
    return R.sources(rows).select("query_id", "type", "name", "relevance_score")


@query("rt15_passages", f"""WITH r AS (SELECT conv_id AS query_id, turn + 1 AS rank, CASE WHEN turn % 3 = 1 THEN ' ' ELSE text END AS text, CASE WHEN turn % 2 = 0 THEN role ELSE '' END AS f, turn AS doc FROM conversations)
SELECT query_id, string_agg('[片段 ' || rank || ' · ' || CASE WHEN f <> '' THEN f ELSE CAST(doc AS VARCHAR) END || ']' || chr(10) || {S.strip('text')}, chr(10) || chr(10) ORDER BY rank) AS passages FROM r WHERE {S.strip('text')} <> '' GROUP BY ALL""")
def _(t):
    rows = t.conversations.select(
        c("conv_id").alias("query_id"), (c("turn") + 1).alias("rank"), F.when(c("turn") % 3 == 1, " ").otherwise(c("text")).alias("text"),
        F.when(c("turn") % 2 == 0, c("role")).otherwise("").alias("source_file"), c("turn").alias("doc_id"))
    return R.passages(rows)


@query("rt16_document_list", f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, count(*) AS chunk_count, arg_min(source, chunk_index) AS source, arg_min(lang, chunk_index) AS lang FROM {TQ.CHUNKS} GROUP BY ALL")
def _(t):
    return R.document_list(TQ.chunk_rows(t))


@query("rt17_document_count", f"SELECT count(DISTINCT doc_id) AS documents FROM {TQ.CHUNKS}")
def _(t):
    return R.document_count(TQ.chunk_rows(t))


@query("rt18_embeddings")
def _(t):
    return R.embed(t.documents, "doc_id", "text", R.hashing_encoder(64), 64)


@query("rt19_dedupe_entities", """WITH e AS (SELECT l_orderkey AS query_id, p_name AS name, CASE WHEN l_tax > 0.04 THEN 'Gene' ELSE 'Disease' END AS type, l_discount AS confidence, l_linenumber * 1000000::BIGINT + l_partkey AS pos FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT query_id, name, arg_min(type, (-confidence, pos, type)) AS type, max(confidence) AS confidence FROM e GROUP BY ALL""")
def _(t):
    rows = t.lineitem.join(t.part, c("l_partkey") == c("p_partkey")).select(
        c("l_orderkey").alias("query_id"), c("p_name").alias("name"), F.when(c("l_tax") > 0.04, "基因").otherwise("疾病").alias("type"), c("l_discount").alias("confidence"),
        F.struct(F.expr("l_linenumber * 1000000L + l_partkey").alias("p"), F.when(c("l_tax") > 0.04, "Gene").otherwise("Disease")).alias("pos"))
    return R.dedupe_entities(rows)


TOOLS = ["graph_retrieve", "doc_search", "entity_search", "other"]
CALLS = """calls AS (SELECT conv_id AS question_id, turn AS pos, CASE turn % 4 WHEN 0 THEN 'graph_retrieve' WHEN 1 THEN 'doc_search' WHEN 2 THEN 'entity_search' ELSE 'other' END AS tool,
 CASE turn % 4 WHEN 0 THEN 'graph' WHEN 1 THEN 'doc' WHEN 2 THEN 'entity' ELSE 'tool' END AS type, CASE WHEN turn % 5 = 4 THEN '' ELSE text END AS content FROM conversations WHERE role = 'assistant' OR turn % 3 = 0)"""


def calls(t):
    tool = F.element_at(T.literals(TOOLS), (c("turn") % 4 + 1).cast("int"))
    rows = t.conversations.filter("role = 'assistant' or turn % 3 = 0")
    return rows.select(c("conv_id").alias("question_id"), c("turn").alias("pos"), tool.alias("tool"), F.when(c("turn") % 5 == 4, "").otherwise(c("text")).alias("content"))


@query("rt20_trace", f"""WITH {CALLS}, n AS (SELECT question_id, count(*) FILTER (type = 'graph') AS g, count(*) FILTER (type = 'doc') AS d, count(*) AS r FROM calls WHERE {S.strip('content')} <> '' GROUP BY ALL),
q AS (SELECT conv_id, arg_min(text, turn) AS question, count(*) - 2 AS h FROM conversations GROUP BY ALL), z AS (SELECT q.*, coalesce(g, 0) AS g, coalesce(d, 0) AS d, coalesce(r, 0) AS r FROM q LEFT JOIN n ON question_id = conv_id)
SELECT conv_id AS question_id, g AS graph_count, d AS doc_count, r AS retrievals, CASE WHEN g = 0 AND d = 0 AND h <= 0 THEN '本次回答主要基于模型对问题本身的理解，没有命中可用的图谱或文献检索结果，因此无法提供更详细的检索链路。'
 ELSE '围绕你的问题「' || substr(question, 1, 30) || '」，' || concat_ws('，', CASE WHEN g > 0 THEN '首先通过图谱工具检索到 ' || g || ' 条与问题高度相关的实体或关系信息' END,
  CASE WHEN d > 0 THEN '随后结合 ' || d || ' 条文献片段，对诊疗依据和背景知识进行补充说明' END, CASE WHEN h > 0 THEN '同时参考本轮会话中的历史提问，保证回答在语义和上下文上前后一致' END) || '，最后综合这些信息给出当前回答。' END AS reasoning FROM z""")
def _(t):
    asked = t.conversations.groupBy(c("conv_id").alias("question_id")).agg(F.min_by("text", "turn").alias("question"), (F.count("*") - 2).alias("n_history"))
    return R.retrieval_trace(asked, calls(t))


@query("rt20_snippets", f"WITH {CALLS} SELECT question_id, pos, type, tool, substr({S.strip('content')}, 1, 120) AS snippet FROM calls WHERE {S.strip('content')} <> ''")
def _(t):
    return R.retrieval_snippets(calls(t))


@query("rt20_rows", f"""WITH {CALLS}, q AS (SELECT conv_id AS question_id, count(*) - 2 AS h FROM conversations GROUP BY ALL) SELECT question_id, pos, type, tool, substr({S.strip('content')}, 1, 120) AS snippet FROM calls WHERE {S.strip('content')} <> ''
UNION ALL SELECT question_id, NULL, 'history', 'session_history', '结合了之前 ' || h || ' 轮对话上下文，用于理解指代和追问。' FROM q WHERE h > 0""")
def _(t):
    asked = t.conversations.groupBy(c("conv_id").alias("question_id")).agg((F.count("*") - 2).alias("n_history"))
    return R.retrieval_rows(asked, calls(t))


@query("rt6_related_entities", f"""WITH {GQ.GRAPH}, {GQ.NAMES}, f AS (SELECT query_id, t AS node_id, o.name, rel, CAST(row_number() OVER (PARTITION BY query_id ORDER BY t, rel, outgoing) AS INT) AS rank FROM names JOIN nodes n USING (name) JOIN two ON f = n.id JOIN nodes o ON o.id = t WHERE rel = 'BASED_IN' QUALIFY rank <= 15)
SELECT query_id, 'graph' AS source, rank, 'graph:' || node_id AS content_key, name || ' | 关系: ' || rel AS content FROM f""")
def _(t):
    from loomwright.operators import graph as G
    from loomwright.operators.ranking import first_n

    near = G.neighbours_by_relation(GQ.wanted_names(t), GQ.nodes(t), GQ.edges(t), "BASED_IN", "both")
    top = first_n(near, ["query_id"], [c("node_id"), c("rel"), c("outgoing")], R.PER_ROUTE)
    none, text = F.array().cast("array<string>"), F.lit(None).cast("string")
    hits = top.select(
        "query_id", "rank", F.lit("related_entity").alias("type"), "node_id", c("other_name").alias("name"), text.alias("description"), text.alias("start_entity"), text.alias("end_entity"),
        none.alias("path_names"), none.alias("relation_types"), c("rel").alias("relation_type"), F.lit(None).cast("int").alias("hop_count"))
    return R.graph_items(hits)
