"""Graph queries: the TPC-H tables as a property graph, orders as extraction units."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright import vocab as V
from loomwright.operators import assembly as A
from loomwright.operators import graph as G
from loomwright.operators import traversal as TR
from loomwright.plans import sqlkit as S
from loomwright.plans.registry import query
from loomwright.session import cut_lineage, dealt, kept, tasks_for
from loomwright.sources import snapshots as SN
from loomwright.sources.splits import spread

c = F.col
# node prefix, type, table, key, name, description
NODE_SOURCES = [
    ("r", "Region", "region", "r_regionkey", "r_name", "''"),
    ("n", "Nation", "nation", "n_nationkey", "n_name", "'in region ' || n_regionkey"),
    ("c", "Customer", "customer", "c_custkey", "c_name", "c_mktsegment"),
    ("s", "Supplier", "supplier", "s_suppkey", "s_name", "''"),
    ("p", "Part", "part", "p_partkey", "p_name", "p_brand"),
    ("o", "Order", "orders", "o_orderkey", "'Order#' || o_orderkey", "o_orderpriority"),
]
# relation, table, source prefix, source key, target prefix, target key
EDGE_SOURCES = [
    ("IN_REGION", "nation", "n", "n_nationkey", "r", "n_regionkey"),
    ("LIVES_IN", "customer", "c", "c_custkey", "n", "c_nationkey"),
    ("BASED_IN", "supplier", "s", "s_suppkey", "n", "s_nationkey"),
    ("PLACED_BY", "orders", "o", "o_orderkey", "c", "o_custkey"),
    ("SUPPLIED_BY", "lineitem", "p", "l_partkey", "s", "l_suppkey"),
]


def nodes(t):
    parts = [
        getattr(t, table).select(
            F.lit("g").alias("graph_id"), F.expr(f"'{prefix}' || {key}").alias("id"), F.expr(name).alias("name"), F.lit(kind).alias("type"),
            F.expr(text).alias("description"), F.expr(f"map('source', '{table}', 'importance', string({key} % 3))").alias("properties"), F.expr(f"cast({key} as bigint)").alias("pos"))
        for prefix, kind, table, key, name, text in NODE_SOURCES
    ]
    return reduce(DataFrame.unionByName, parts)


def edge_tasks(t):
    return tasks_for(*[getattr(t, table) for _, table, *_ in EDGE_SOURCES])


def edges(t):
    """Distinct by the keys, before names are formed of them: a relation comes from one table, a name from one key."""
    n = edge_tasks(t)
    pairs = [
        getattr(t, table).select(F.lit(i).alias("_i"), F.col(ak).cast("bigint").alias("_a"), F.col(bk).cast("bigint").alias("_b"))
        for i, (_, table, _, ak, _, bk) in enumerate(EDGE_SOURCES)
    ]
    rows = reduce(DataFrame.unionByName, pairs).repartition(n, "_i", "_a", "_b").distinct()
    rel, a, b = (F.element_at(F.array(*[F.lit(x[k]) for x in EDGE_SOURCES]), c("_i") + 1) for k in (0, 2, 4))
    rows = rows.select(F.concat(a, "_a").alias("src"), rel.alias("rel"), F.concat(b, "_b").alias("dst"))
    return rows.select(
        F.lit("g").alias("graph_id"), F.concat_ws("_", "src", "rel", "dst").alias("id"), "src", "rel", "dst", F.create_map(F.lit("via"), F.lower("rel")).alias("properties"))


NODES = "nodes AS (" + " UNION ALL ".join(
    f"SELECT '{p}' || {k} AS id, {n} AS name, '{kind}' AS type, {d} AS description, CAST({k} AS BIGINT) AS pos, '{table}' AS origin FROM {table}" for p, kind, table, k, n, d in NODE_SOURCES) + ")"
EDGES = "edges AS (SELECT DISTINCT src || '_' || rel || '_' || dst AS id, * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' || {ak} AS src, '{rel}' AS rel, '{b}' || {bk} AS dst FROM {table}" for rel, table, a, ak, b, bk in EDGE_SOURCES) + "))"
TWO = "two AS (SELECT id AS edge_id, src AS f, rel, dst AS t, true AS outgoing FROM edges UNION ALL SELECT id, dst, rel, src, false FROM edges)"
GRAPH = f"{NODES}, {EDGES}, {TWO}"


@query("gr1_statistics", f"WITH {GRAPH} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(DISTINCT type) FROM nodes) AS labels, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT rel) FROM edges) AS relation_types")
def _(t):
    return G.statistics(nodes(t), edges(t))


@query("gr2_counts_by_type", f"""WITH {GRAPH}, f AS (SELECT 'node' AS kind, type, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'edge', rel, count(*) FROM edges GROUP BY ALL)
SELECT * FROM f WHERE type IN ('Customer', 'Part', 'PLACED_BY') UNION ALL SELECT 'node', 'Gene', 0 UNION ALL SELECT 'edge', 'NONE', 0 UNION ALL SELECT kind, 'total', sum(n)::BIGINT FROM f GROUP BY ALL""")
def _(t):
    return G.counts_by_type(t.spark, nodes(t), edges(t), ["Customer", "Part", "Gene"], ["PLACED_BY", "NONE"])


@query("gr3_label_histogram", f"WITH {GRAPH} SELECT type, count(*) AS n FROM nodes GROUP BY ALL")
def _(t):
    return G.label_histogram(nodes(t))


@query("gr3_relation_histogram", f"WITH {GRAPH} SELECT rel, count(*) AS n FROM edges GROUP BY ALL")
def _(t):
    return G.relation_histogram(edges(t))


@query("gr4_search_by_name", f"WITH {GRAPH} SELECT id, name, type FROM nodes WHERE contains(name, 'red') AND type = 'Part' ORDER BY id LIMIT 20")
def _(t):
    return G.search_by_name(nodes(t), "red", "Part").select("id", "name", "type")


@query("gr5_search_ignore_case", f"WITH {GRAPH} SELECT id, name, type FROM nodes WHERE contains(lower(name), 'customer#000') AND type = 'Customer' ORDER BY id LIMIT 50")
def _(t):
    return G.search_by_name(nodes(t), "CUSTOMER#000", "Customer", 50, ignore_case=True).select("id", "name", "type")


@query("gr6_search_anywhere", f"WITH {GRAPH} SELECT id, name, type, description FROM nodes WHERE contains(lower(description), 'brand#1') AND type = 'Part'")
def _(t):
    return G.search_anywhere(nodes(t), "BRAND#1", "part").select("id", "name", "type", "description")


@query("gr7_find_nodes", f"WITH {GRAPH} SELECT id, name FROM nodes WHERE type = 'Customer' AND description = 'BUILDING' ORDER BY id LIMIT 100")
def _(t):
    return G.find_nodes(nodes(t), "Customer", {"description": "BUILDING", "source": "customer"}).select("id", "name")


@query("gr8_search_relations", f"WITH {GRAPH} SELECT id, src, rel, dst FROM edges WHERE rel IN ('SUPPLIED_BY', 'BASED_IN')")
def _(t):
    e, n = edges(t), edge_tasks(t)
    return G.search_relations(e, "Supplied_B", tasks=n).unionByName(G.search_relations(e, "based", "BASED_IN", tasks=n)).select("id", "src", "rel", "dst")


BEST = "best AS (SELECT 'c' || max_by(c_custkey, (c_acctbal, c_custkey)) AS id FROM customer GROUP BY c_nationkey)"


def best_customers(t):
    """The customer with the highest balance in every nation, as ids to look up."""
    top = t.customer.groupBy("c_nationkey").agg(F.max_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("k"))
    return top.select(F.expr("'c' || k").alias("id"))


@query("gr9_entity_details", f"""WITH {GRAPH}, {BEST} SELECT n.id, n.name, edge_id, rel, outgoing, t AS other_id, o.name AS other_name, o.type AS other_type
FROM nodes n JOIN best ON n.id = best.id LEFT JOIN two ON two.f = n.id LEFT JOIN nodes o ON o.id = t""")
def _(t):
    rows = G.entity_details(best_customers(t), nodes(t), edges(t))
    return rows.select("id", "name", "edge_id", "rel", "outgoing", "other_id", "other_name", "other_type")


@query("gr10_relation_details", f"WITH {GRAPH}, {BEST} SELECT e.id, src, rel, dst FROM edges e JOIN best ON e.id LIKE best.id || '\\_LIVES%' ESCAPE '\\'")
def _(t):
    wanted = edges(t).filter("rel = 'LIVES_IN'").join(best_customers(t).withColumnRenamed("id", "src"), "src").select("id")
    return G.relation_details(wanted, edges(t)).select("id", "src", "rel", "dst")


@query("gr11_expand", f"WITH {GRAPH}, {BEST} SELECT DISTINCT t AS id, 'node' AS kind FROM two JOIN best ON f = best.id UNION ALL SELECT DISTINCT edge_id, 'edge' FROM two JOIN best ON f = best.id")
def _(t):
    n, e = G.expand(best_customers(t), nodes(t), edges(t))
    return n.select("id", F.lit("node").alias("kind")).union(e.select("id", F.lit("edge").alias("kind")))


NAMES = "names AS (SELECT r_regionkey % 2 AS query_id, r_name AS name FROM region UNION ALL SELECT 2, n_name FROM nation)"


def wanted_names(t):
    regions = t.region.select((c("r_regionkey") % 2).alias("query_id"), c("r_name").alias("name"))
    return regions.union(t.nation.select(F.lit(2), "n_name"))


@query("gr12_direct_entities", f"WITH {GRAPH}, {NAMES} SELECT query_id, id, name, 1.0::DOUBLE AS relevance_score FROM nodes JOIN names USING (name)")
def _(t):
    return G.direct_entities(wanted_names(t), nodes(t)).select("query_id", "id", "name", "relevance_score")


HOPS = """hop0 AS (SELECT query_id, id FROM nodes JOIN names USING (name)),
hop1 AS (SELECT query_id, t AS id, min((f, rel)) AS p FROM hop0 JOIN two ON f = id GROUP BY ALL), h1 AS (SELECT * FROM hop1 ANTI JOIN hop0 USING (query_id, id)),
hop2 AS (SELECT query_id, t AS id, min((f, rel)) AS p FROM h1 JOIN two ON f = id GROUP BY ALL), h2 AS (SELECT * FROM hop2 ANTI JOIN hop0 USING (query_id, id) ANTI JOIN h1 USING (query_id, id)),
hop3 AS (SELECT query_id, t AS id, min((f, rel)) AS p FROM h2 JOIN two ON f = id GROUP BY ALL), h3 AS (SELECT * FROM hop3 ANTI JOIN hop0 USING (query_id, id) ANTI JOIN h1 USING (query_id, id) ANTI JOIN h2 USING (query_id, id)),
hops AS (SELECT query_id, id, 0 AS hop, NULL AS p FROM hop0 UNION ALL SELECT query_id, id, 1, p FROM h1 UNION ALL SELECT query_id, id, 2, p FROM h2 UNION ALL SELECT query_id, id, 3, p FROM h3)"""


def seeds(t):
    return nodes(t).join(wanted_names(t), "name").select("query_id", "id")


@query("gr13_k_hop", f"""WITH {GRAPH}, {NAMES}, {HOPS} SELECT query_id, hops.id, hop, CASE WHEN hop > 0 THEN p[1] END AS parent, CASE WHEN hop > 0 THEN p[2] END AS rel,
 CASE hop WHEN 0 THEN 1.0 ELSE 1 / (1 + 0.3 * hop) END::DOUBLE AS relevance_score, o.name AS parent_name FROM hops LEFT JOIN nodes o ON o.id = p[1]""")
def _(t):
    hits = TR.neighbour_hits(TR.k_hop(seeds(t), edges(t), 3, ["query_id"]), nodes(t))
    return hits.select("query_id", "id", "hop", "parent", "rel", "relevance_score", "parent_name")


PATHS = """p1 AS (SELECT id AS start, t AS e, [edge_id] AS es, [id, t] AS ns FROM region_seeds JOIN two ON f = id),
p2 AS (SELECT start, t AS e, list_append(es, edge_id) AS es, list_append(ns, t) AS ns FROM p1 JOIN two ON f = e WHERE NOT list_contains(es, edge_id)),
p3 AS (SELECT start, t AS e, list_append(es, edge_id) AS es, list_append(ns, t) AS ns FROM p2 JOIN two ON f = e WHERE NOT list_contains(es, edge_id)),
paths AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)"""
RSEED = "region_seeds AS (SELECT id FROM nodes WHERE type = 'Region')"


@query("gr14_paths", f"WITH {GRAPH}, {RSEED}, {PATHS} SELECT start, e AS \"end\", len(es) AS hop, array_to_string(ns, '>') AS nodes FROM paths")
def _(t):
    paths = TR.expand_paths(nodes(t).filter("type = 'Region'"), edges(t), 3)
    return paths.select("start", "end", "hop", F.array_join("nodes", ">").alias("nodes"))


@query("gr14_path_hits", f"""WITH {GRAPH}, {RSEED}, {PATHS} SELECT e AS "end", name, len(es) AS hop, array_to_string(ns, '>') AS nodes, round(1 / (1 + 0.3 * len(es)), 10)::DOUBLE AS relevance_score
FROM paths JOIN nodes ON nodes.id = e ORDER BY hop, name, ns LIMIT 50""")
def _(t):
    hits = TR.path_hits(nodes(t).filter("type = 'Region'"), nodes(t), edges(t), 3, 50)
    return hits.select("end", "name", "hop", F.array_join("nodes", ">").alias("nodes"), F.round("relevance_score", 10).alias("relevance_score"))


# distance of every pair of nations over at most five edges, by distances to all nodes
DIST = """d0 AS (SELECT id AS s, id FROM nodes WHERE type = 'Nation'),
s1 AS (SELECT DISTINCT s, t AS id FROM d0 JOIN two ON f = id), d1 AS (SELECT * FROM s1 ANTI JOIN d0 USING (s, id)),
s2 AS (SELECT DISTINCT s, t AS id FROM d1 JOIN two ON f = id), d2 AS (SELECT * FROM s2 ANTI JOIN d0 USING (s, id) ANTI JOIN d1 USING (s, id)),
s3 AS (SELECT DISTINCT s, t AS id FROM d2 JOIN two ON f = id), d3 AS (SELECT * FROM s3 ANTI JOIN d0 USING (s, id) ANTI JOIN d1 USING (s, id) ANTI JOIN d2 USING (s, id)),
s4 AS (SELECT DISTINCT s, t AS id FROM d3 JOIN two ON f = id), d4 AS (SELECT * FROM s4 ANTI JOIN d0 USING (s, id) ANTI JOIN d1 USING (s, id) ANTI JOIN d2 USING (s, id) ANTI JOIN d3 USING (s, id)),
dist AS (SELECT s, id, 1 AS d FROM d1 UNION ALL SELECT s, id, 2 FROM d2 UNION ALL SELECT s, id, 3 FROM d3 UNION ALL SELECT s, id, 4 FROM d4)"""


@query("gr15_shortest_paths", f"""WITH {GRAPH}, {DIST} SELECT s AS start, id AS goal, d AS path_length, d + 1 AS n_nodes, round(1 / (1 + 0.2 * d), 10)::DOUBLE AS relevance_score
FROM dist WHERE id IN (SELECT id FROM d0)""")
def _(t):
    nations = nodes(t).filter("type = 'Nation'").select("id")
    found = TR.shortest_paths_among(nations, edges(t), 4)
    return found.select("start", "goal", "path_length", F.size("path_nodes").alias("n_nodes"), F.round("relevance_score", 10).alias("relevance_score"))


@query("gr15_paths_between_names", f"""WITH {GRAPH}, {DIST} SELECT a.name AS start_name, b.name AS goal_name, d AS path_length FROM dist JOIN nodes a ON a.id = s JOIN nodes b ON b.id = dist.id
WHERE b.type = 'Nation' AND d <= 3 ORDER BY d, a.name, b.name LIMIT 10""")
def _(t):
    names = t.nation.select(c("n_name").alias("name"))
    return TR.paths_between_names(names, nodes(t), edges(t), 3, 10).select("start_name", "goal_name", "path_length")


# levels around every nation with the least parent and relation, and the paths read off at the least common node
WAYS = """st AS (SELECT f, t, min(rel) AS rel FROM two GROUP BY ALL), w0 AS (SELECT id AS s, id FROM nodes WHERE type = 'Nation'),
w1 AS (SELECT s, t AS id, min((f, rel)) AS p FROM w0 JOIN st ON f = id WHERE t <> s GROUP BY ALL),
w2 AS (SELECT s, t AS id, min((f, rel)) AS p FROM w1 JOIN st ON f = id ANTI JOIN w1 AS seen ON seen.s = w1.s AND seen.id = t WHERE t <> s GROUP BY ALL),
met AS (SELECT a.s AS a, b.s AS b, 1 AS d, min(a.id) AS m FROM w1 a JOIN w0 b USING (id) WHERE a.s < b.s GROUP BY ALL UNION ALL SELECT a.s, b.s, 2, min(a.id) FROM w1 a JOIN w1 b USING (id) WHERE a.s < b.s GROUP BY ALL
 UNION ALL SELECT a.s, b.s, 3, min(a.id) FROM w2 a JOIN w1 b USING (id) WHERE a.s < b.s GROUP BY ALL UNION ALL SELECT a.s, b.s, 4, min(a.id) FROM w2 a JOIN w2 b USING (id) WHERE a.s < b.s GROUP BY ALL),
short AS (SELECT a, b, min((d, m)) AS x FROM met GROUP BY ALL),
ways AS (SELECT a, b, x[1] AS d, CASE x[1] WHEN 1 THEN [a, b] WHEN 2 THEN [a, x[2], b] WHEN 3 THEN [a, p2.p[1], x[2], b] ELSE [a, p2.p[1], x[2], q2.p[1], b] END AS ns,
 CASE x[1] WHEN 1 THEN [p1.p[2]] WHEN 2 THEN [p1.p[2], q1.p[2]] WHEN 3 THEN [u1.p[2], p2.p[2], q1.p[2]] ELSE [u1.p[2], p2.p[2], q2.p[2], v1.p[2]] END AS rs
 FROM short LEFT JOIN w1 p1 ON p1.s = a AND p1.id = x[2] LEFT JOIN w2 p2 ON p2.s = a AND p2.id = x[2] LEFT JOIN w1 u1 ON u1.s = a AND u1.id = p2.p[1]
 LEFT JOIN w1 q1 ON q1.s = b AND q1.id = x[2] LEFT JOIN w2 q2 ON q2.s = b AND q2.id = x[2] LEFT JOIN w1 v1 ON v1.s = b AND v1.id = q2.p[1])"""


@query("gr15_path_details", f"""WITH {GRAPH}, {WAYS} SELECT a AS start, b AS goal, d AS path_length, array_to_string(ns, '>') AS nodes, array_to_string(rs, '>') AS relations FROM ways
UNION ALL SELECT b, a, d, array_to_string(list_reverse(ns), '>'), array_to_string(list_reverse(rs), '>') FROM ways""")
def _(t):
    found = TR.shortest_paths_among(nodes(t).filter("type = 'Nation'"), edges(t), 4)
    return found.select("start", "goal", "path_length", F.array_join("path_nodes", ">").alias("nodes"), F.array_join("relation_types", ">").alias("relations"))


@query("gr16_snapshot_paths", f"""WITH {GRAPH}, {DIST}, m AS (SELECT id, row_number() OVER (ORDER BY id) AS r FROM d0)
SELECT s AS start, dist.id AS goal, d AS path_length FROM dist JOIN m a ON a.id = s JOIN m b ON b.id = dist.id WHERE a.r <= 2 AND b.r IN (a.r + 1, a.r + 2)""")
def _(t):
    matched = nodes(t).filter("type = 'Nation'")
    return TR.snapshot_paths(matched, edges(t), 5).select("start", "goal", "path_length")


@query("gr17_neighbours_by_relation", f"""WITH {GRAPH}, {NAMES} SELECT query_id, n.name, t AS node_id, o.name AS other_name, rel, outgoing, 0.8::DOUBLE AS relevance_score
FROM names JOIN nodes n USING (name) JOIN two ON f = n.id JOIN nodes o ON o.id = t WHERE (rel = 'IN_REGION' AND NOT outgoing) OR rel = 'BASED_IN'""")
def _(t):
    inside = G.neighbours_by_relation(wanted_names(t), nodes(t), edges(t), "IN_REGION", "in")
    either = G.neighbours_by_relation(wanted_names(t), nodes(t), edges(t), "BASED_IN", "both")
    return inside.union(either).drop("other_type")


@query("gr18_subgraph", f"""WITH {GRAPH}, names AS (SELECT 0 AS query_id, r_name AS name FROM region), {HOPS}, inner_ids AS (SELECT id FROM hops WHERE hop < 2)
SELECT id, 'node' AS kind FROM hops WHERE hop <= 2 UNION ALL SELECT DISTINCT id, 'edge' FROM edges WHERE src IN (SELECT id FROM inner_ids) OR dst IN (SELECT id FROM inner_ids)""")
def _(t):
    n, e = TR.subgraph(nodes(t).filter("type = 'Region'"), nodes(t), edges(t), 2)
    return n.select("id", F.lit("node").alias("kind")).union(e.select("id", F.lit("edge").alias("kind")))


@query("gr19_resolve_endpoints", """WITH n AS (SELECT 'p' || p_partkey AS id, p_name AS name FROM part), by_name AS (SELECT name, min(id) AS m FROM n GROUP BY ALL),
e AS (SELECT DISTINCT CASE l_linenumber % 3 WHEN 0 THEN 'p' || l_partkey WHEN 1 THEN p_name ELSE 'lost' || l_partkey END AS src, 'p' || l_suppkey AS dst FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT coalesce(a.id, m) AS src, b.id AS dst FROM e LEFT JOIN n a ON a.id = e.src LEFT JOIN by_name ON by_name.name = e.src JOIN n b ON b.id = e.dst WHERE coalesce(a.id, m) IS NOT NULL""")
def _(t):
    n = t.part.select(F.expr("'p' || p_partkey").alias("id"), c("p_name").alias("name"))
    raw = F.when(c("l_linenumber") % 3 == 0, F.expr("'p' || l_partkey")).when(c("l_linenumber") % 3 == 1, c("p_name")).otherwise(F.expr("'lost' || l_partkey"))
    e = t.lineitem.join(t.part, c("l_partkey") == c("p_partkey")).select(raw.alias("src"), F.expr("'p' || l_suppkey").alias("dst")).distinct()
    return SN.resolve_endpoints(e, n).select("src", "dst")


@query("gr20_dedupe_and_rank", f"""WITH {GRAPH}, {NAMES}, {HOPS}, h AS (SELECT query_id, id, hop, least(1.0, (CASE hop WHEN 0 THEN 1.0 ELSE 1 / (1 + 0.3 * hop) END) + CASE WHEN hop > 0 AND p[2] IN ('BASED_IN', 'LIVES_IN') THEN 0.2 ELSE 0 END)::DOUBLE AS s FROM hops)
SELECT query_id, id AS key, round(max(s), 10) AS relevance_score FROM h GROUP BY ALL""")
def _(t):
    hits = TR.neighbour_hits(TR.k_hop(seeds(t), edges(t), 3, ["query_id"]), nodes(t))
    twice = hits.withColumn("relevance_score", c("relevance_score") / 2).unionByName(hits)
    rows = twice.select(
        "query_id", c("kind").alias("type"), c("id").alias("node_id"), "name", F.lit(None).cast("string").alias("start_entity"), F.lit(None).cast("string").alias("end_entity"),
        "relation_types", "relevance_score", F.lit(1).alias("pos"))
    ranked = G.dedupe_and_rank(rows, F.array(F.lit("BASED_IN"), F.lit("LIVES_IN")))
    return ranked.select("query_id", "key", F.round("relevance_score", 10).alias("relevance_score"))


@query("gr21_page", f"WITH {GRAPH}, pg AS (SELECT id FROM nodes ORDER BY id LIMIT 2000 OFFSET 1000) SELECT id, 'node' AS kind FROM pg UNION ALL SELECT id, 'edge' FROM edges WHERE src IN (SELECT id FROM pg) AND dst IN (SELECT id FROM pg)")
def _(t):
    n, e = G.graph_page(nodes(t), edges(t), 2000, 1000)
    return n.select("id", F.lit("node").alias("kind")).union(e.select("id", F.lit("edge").alias("kind")))


@query("gr22_visual", f"WITH {GRAPH} SELECT id, (40 + 10 * (pos % 3))::DOUBLE AS symbol_size, CASE type WHEN 'Part' THEN '#4ecdc4' ELSE '#9c27ff' END AS color, CASE type WHEN 'Part' THEN 'symptom' ELSE lower(type) END AS category FROM nodes")
def _(t):
    typed = nodes(t).withColumn("type", F.when(c("type") == "Part", "Symptom").otherwise(c("type")))
    return G.visual(typed).select("id", "symbol_size", "color", "category")


@query("gr25_intent_names", f"""WITH {GRAPH}, q AS (SELECT r_regionkey AS query_id, r_name AS name FROM region)
SELECT query_id, q.name, o.name AS answer FROM q JOIN nodes n USING (name) JOIN two ON f = n.id AND rel = 'IN_REGION' AND NOT outgoing JOIN nodes o ON o.id = t""")
def _(t):
    starts = t.region.select(c("r_regionkey").alias("query_id"), c("r_name").alias("name"))
    return G.intent_names(starts, nodes(t), edges(t), "IN_REGION", False, "Nation")


@query("gr26_intent_answers", """WITH k AS (SELECT n_regionkey AS query_id, n_nationkey AS pos, n_name AS related, CASE WHEN n_nationkey % 2 = 0 THEN 'HAS_SYMPTOM' ELSE 'TREATED_BY' END AS relation FROM nation),
q AS (SELECT r_regionkey AS query_id, CASE r_regionkey WHEN 0 THEN 'symptom_query' WHEN 1 THEN 'treatment_query' WHEN 2 THEN 'general_query' ELSE 'prognosis_query' END AS intent FROM region UNION ALL SELECT 99, 'symptom_query')
SELECT query_id, intent, CASE WHEN query_id = 99 THEN '抱歉，我没有找到相关的医疗信息。请咨询专业医生。'
 WHEN intent = 'symptom_query' THEN '根据医疗知识库，主要症状包括：' || (SELECT string_agg(related, ', ' ORDER BY pos) FROM k WHERE k.query_id = q.query_id AND relation = 'HAS_SYMPTOM') || '。建议及时就医。'
 WHEN intent = 'treatment_query' THEN '常用治疗方法包括：' || (SELECT string_agg(related, ', ' ORDER BY pos) FROM k WHERE k.query_id = q.query_id AND relation = 'TREATED_BY') || '。请遵医嘱用药。'
 ELSE '关于' || (SELECT arg_min(r_name, r_regionkey) FROM region WHERE r_regionkey = q.query_id) || '：text 详细信息请咨询专业医生。' END AS answer FROM q""")
def _(t):
    k = t.nation.join(t.region, c("n_regionkey") == c("r_regionkey")).select(
        c("n_regionkey").alias("query_id"), c("n_nationkey").alias("pos"), c("r_name").alias("entity"), F.when(c("n_nationkey") % 2 == 0, "HAS_SYMPTOM").otherwise("TREATED_BY").alias("relation"),
        c("n_name").alias("related_entity"), F.lit("text").alias("description"))
    intent = F.when(c("r_regionkey") == 0, "symptom_query").when(c("r_regionkey") == 1, "treatment_query").when(c("r_regionkey") == 2, "general_query").otherwise("prognosis_query")
    q = t.region.select(c("r_regionkey").alias("query_id"), intent.alias("intent"))
    extra = t.region.agg(F.lit(99).alias("query_id"), F.lit("symptom_query").alias("intent"))
    return G.intent_answers(q.unionByName(extra), k)


# --- graphs as snapshots: one graph per nation ---------------------------------------------------------------------


def nation_tables(t):
    people = t.customer.select(
        F.concat(F.lit("g"), c("c_nationkey").cast("string")).alias("graph_id"), F.expr("'c' || c_custkey").alias("id"), c("c_name").alias("name"), F.lit("Customer").alias("type"),
        c("c_mktsegment").alias("description"))
    firms = t.supplier.select(
        F.concat(F.lit("g"), c("s_nationkey").cast("string")).alias("graph_id"), F.expr("'s' || s_suppkey").alias("id"), c("s_name").alias("name"), F.lit("Supplier").alias("type"),
        F.lit("").alias("description"))
    links = t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).select(
        F.concat(F.lit("g"), c("c_nationkey").cast("string")).alias("graph_id"), F.expr("'e' || o_orderkey").alias("id"), F.expr("'c' || c_custkey").alias("source"),
        c("o_orderpriority").alias("relation"), F.expr("CASE WHEN o_orderkey % 5 = 0 THEN c_name ELSE 's' || (o_orderkey % 200) END").alias("target"))
    return people.unionByName(firms), links


NATION = """people AS (SELECT 'g' || c_nationkey AS graph_id, 'c' || c_custkey AS id, c_name AS name, 'Customer' AS type, c_mktsegment AS description FROM customer
 UNION ALL SELECT 'g' || s_nationkey, 's' || s_suppkey, s_name, 'Supplier', '' FROM supplier),
links AS (SELECT 'g' || c_nationkey AS graph_id, 'e' || o_orderkey AS id, 'c' || c_custkey AS src, o_orderpriority AS rel, CASE WHEN o_orderkey % 5 = 0 THEN c_name ELSE 's' || (o_orderkey % 200) END AS dst
 FROM orders JOIN customer ON o_custkey = c_custkey)"""


def snapshots(t, items_per_part=200):
    return SN.write_snapshots(*nation_tables(t), items_per_part=items_per_part)


@query("src11_12_snapshot_nodes", f"WITH {NATION} SELECT graph_id, id, name, type, description FROM people")
def _(t):
    return SN.snapshot_to_nodes(snapshots(t)).select("graph_id", "id", "name", "type", "description")


@query("src11_12_snapshot_edges", f"WITH {NATION} SELECT graph_id, id, src, rel, dst FROM links")
def _(t):
    return SN.snapshot_to_edges(snapshots(t)).select("graph_id", "id", "src", "rel", "dst")


@query("src12_snapshot_keys", f"""WITH {NATION} SELECT graph_id, (SELECT count(*) FROM people p WHERE p.graph_id = g.graph_id) AS nodes, (SELECT count(*) FROM links l WHERE l.graph_id = g.graph_id) AS edges, 'nodes,edges' AS keys
FROM (SELECT DISTINCT graph_id FROM people) g""")
def _(t):
    sized = snapshots(t).select(
        "graph_id", F.array_join(F.json_object_keys("graph_data"), ",").alias("keys"), F.json_array_length(F.get_json_object("graph_data", "$.nodes")).alias("n"),
        F.json_array_length(F.get_json_object("graph_data", "$.edges")).alias("e"))
    return sized.groupBy("graph_id", "keys").agg(F.sum("n").alias("nodes"), F.sum("e").alias("edges"))


CATALOGUE = f"""catalogue AS (SELECT 'g' || n_nationkey AS graph_id, n_name AS graph_name, CASE WHEN n_nationkey % 3 = 0 THEN NULL WHEN n_nationkey % 3 = 1 THEN 'ann' ELSE 'bob' END AS user_id FROM nation)"""


def catalogue(t):
    k = c("n_nationkey")
    return t.nation.select(
        F.concat(F.lit("g"), k.cast("string")).alias("graph_id"), c("n_name").alias("graph_name"), F.when(k % 3 == 1, "ann").when(k % 3 == 2, "bob").alias("user_id"),
        (k * 10).cast("bigint").alias("entity_count"), F.lit(600).cast("bigint").alias("relation_count"))


@query("gr23_merge_graphs", f"""WITH {NATION}, n AS (SELECT name AS id, min(graph_id) AS graph_id FROM people GROUP BY ALL), e AS (SELECT DISTINCT src || '_' || rel || '_' || dst AS id FROM links)
SELECT id, 'node' AS kind FROM n UNION ALL SELECT id, 'edge' FROM e""")
def _(t):
    n, e = SN.snapshot_to_nodes(snapshots(t)), SN.snapshot_to_edges(snapshots(t))
    merged, unique = G.merge_graphs(n.withColumn("id", c("name")), e.withColumn("id", F.concat_ws("_", "src", "rel", "dst")))
    return merged.select("id", F.lit("node").alias("kind")).union(unique.select("id", F.lit("edge").alias("kind")))


LIMITED = f"""{NATION}, firsts AS (SELECT id, min(graph_id) AS graph_id FROM (SELECT graph_id, name AS id FROM people) GROUP BY ALL), sizes AS (SELECT graph_id, count(*) FILTER (id IS NOT NULL) AS n FROM (SELECT graph_id, id FROM firsts UNION ALL SELECT DISTINCT graph_id, NULL FROM links) GROUP BY ALL),
runs AS (SELECT graph_id, n, sum(n) OVER (ORDER BY graph_id) - n AS before FROM sizes), lim AS (SELECT (sum(n) * 0.3)::BIGINT AS m FROM sizes), taken AS (SELECT * FROM runs WHERE before < (SELECT m FROM lim))"""


@query("gr23_limited_merge", f"""WITH {LIMITED}, kept AS (SELECT id, row_number() OVER (ORDER BY graph_id, id) AS r FROM firsts)
SELECT id, 'node' AS kind FROM kept WHERE r <= (SELECT m FROM lim) UNION ALL SELECT DISTINCT src || '_' || rel || '_' || dst, 'edge' FROM links WHERE graph_id IN (SELECT graph_id FROM taken)""")
def _(t):
    n, e = SN.snapshot_to_nodes(snapshots(t)), SN.snapshot_to_edges(snapshots(t))
    n = n.withColumn("id", c("name")).withColumn("pos", c("name"))
    limit = round(n.select(F.count_distinct("id")).first()[0] * 0.3)
    merged, unique = G.merge_graphs(n, e.withColumn("id", F.concat_ws("_", "src", "rel", "dst")), limit)
    return merged.select("id", F.lit("node").alias("kind")).union(unique.select("id", F.lit("edge").alias("kind")))


@query("gr23_placeholder", f"""WITH {CATALOGUE}, {NATION} SELECT '_placeholder_' || graph_id AS id, graph_name || '（暂无节点数据，请上传并构建后查看）' AS name, 'entity' AS category FROM (SELECT * FROM catalogue ORDER BY graph_id LIMIT 1)
UNION ALL SELECT id, name, 'customer' FROM people WHERE type = 'Customer'""")
def _(t):
    n = SN.snapshot_to_nodes(snapshots(t)).select("id", "name", F.lower("type").alias("category"))
    return G.or_placeholder(n.filter("category = 'nothing'"), catalogue(t)).union(G.or_placeholder(n.filter("category = 'customer'"), catalogue(t)))


@query("gr23_24_visible_graphs", f"WITH {CATALOGUE} SELECT graph_id, user_id FROM catalogue WHERE user_id IS NULL OR user_id = 'ann'")
def _(t):
    all_graphs = catalogue(t)
    own = all_graphs.filter("user_id = 'ann'")
    shadowed = G.merge_visible(G.visible_to(all_graphs, "ann"), own)
    return shadowed.select("graph_id", "user_id")


@query("gr29_quality_checks", f"""WITH {NATION}, {CATALOGUE}, loose AS (SELECT l.graph_id, count(*) AS dangling FROM links l LEFT JOIN people a ON a.graph_id = l.graph_id AND a.id = l.src LEFT JOIN people b ON b.graph_id = l.graph_id AND b.id = l.dst
 WHERE a.id IS NULL OR b.id IS NULL GROUP BY ALL), n AS (SELECT graph_id, count(*) AS nodes FROM people GROUP BY ALL), e AS (SELECT graph_id, count(*) AS edges FROM links GROUP BY ALL)
SELECT graph_id, coalesce(nodes, 0) AS nodes, 0 AS bad_nodes, coalesce(edges, 0) AS edges, 0 AS bad_edges, coalesce(dangling, 0) AS dangling, coalesce(nodes, 0) = 10 * CAST(graph_id[2:] AS INT) AS entity_count_ok, coalesce(edges, 0) = 600 AS relation_count_ok
FROM catalogue LEFT JOIN n USING (graph_id) LEFT JOIN e USING (graph_id) LEFT JOIN loose USING (graph_id)""")
def _(t):
    return G.quality_checks(SN.snapshot_to_nodes(snapshots(t)), SN.snapshot_to_edges(snapshots(t)), catalogue(t))


@query("gr30_snapshot_summaries", f"""WITH {NATION}, {CATALOGUE}, n AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY id) AS r, count(*) OVER (PARTITION BY graph_id) AS total FROM people),
e AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY id) AS r, count(*) OVER (PARTITION BY graph_id) AS total FROM links)
SELECT graph_id, '图谱 ' || graph_name || '（' || graph_id || '）：共 ' || (SELECT any_value(total) FROM n WHERE n.graph_id = k.graph_id) || ' 节点、' || (SELECT any_value(total) FROM e WHERE e.graph_id = k.graph_id) || ' 关系。' || chr(10)
 || '节点示例: ' || (SELECT string_agg(name || ' (' || type || ')', '; ' ORDER BY r) FROM n WHERE n.graph_id = k.graph_id AND r <= 15) || chr(10)
 || '关系示例: ' || (SELECT string_agg(src || ' --[' || rel || ']--> ' || dst, '; ' ORDER BY r) FROM e WHERE e.graph_id = k.graph_id AND r <= 15) AS summary FROM catalogue k""")
def _(t):
    n, e = SN.snapshot_to_nodes(snapshots(t)), SN.snapshot_to_edges(snapshots(t))
    return G.snapshot_summaries(catalogue(t), n.withColumn("pos", c("id")), e.withColumn("pos", c("id")))


@query("gr31_graph_sizes", f"""WITH {NATION}, {CATALOGUE} SELECT graph_id, graph_name, (SELECT count(*) FROM people p WHERE p.graph_id = k.graph_id) AS node_count, (SELECT count(*) FROM links l WHERE l.graph_id = k.graph_id) AS edge_count FROM catalogue k""")
def _(t):
    sized = G.graph_sizes(catalogue(t), SN.snapshot_to_nodes(snapshots(t)), SN.snapshot_to_edges(snapshots(t)))
    return sized.select("graph_id", "graph_name", "node_count", "edge_count")


# --- assembly: one extraction unit per order -----------------------------------------------------------------------

LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_tax"]


def unit_rows(lines, t, tasks=None):
    """The distinct rows of the units of ``lines``. With ``tasks`` they are dealt by unit before the wide texts are formed."""
    kind = F.when(c("p_type") == "ECONOMY", " 症状 ").when(c("p_type") == "SMALL", "Medicine").when(c("p_type") == "PROMO", "手术").otherwise(c("p_type"))
    firm = F.when(c("l_suppkey") % 7 == 0, "患者").when(c("l_suppkey") % 11 == 0, "12.5 - 3").otherwise(F.expr("'Ｓupplier　　' || l_suppkey"))
    sold = lines.select(*LINE).join(t.part.select("p_partkey", "p_name", "p_type"), c("l_partkey") == c("p_partkey")).drop("p_partkey")
    unit = c("l_orderkey").cast("string").alias("unit_id")
    bought = t.orders.select("o_orderkey", "o_custkey")
    if tasks:
        joined = sold.select("*", unit).repartition(tasks, "unit_id").join(bought.select(c("o_orderkey").cast("string").alias("unit_id"), "o_custkey"), "unit_id")
    else:
        joined = sold.join(bought, c("l_orderkey") == c("o_orderkey")).select("*", unit)
    return joined.select(
        "unit_id", F.expr("l_linenumber * 1000000000L + l_partkey * 10000 + l_suppkey").alias("line"), F.expr("'Customer ' || o_custkey").alias("buyer"),
        F.when(c("l_suppkey") % 2 == 0, F.translate("p_name", "abc", "ａｂｃ")).otherwise(F.upper("p_name")).alias("item"), kind.alias("kind"), firm.alias("firm"), "l_returnflag", "l_linestatus", "l_tax").distinct()


def unit_parts(t):
    """The extraction units as (rows, tasks): those of ordinary units dealt by unit to ``tasks``, where every later step of a
    unit finds them, and, if there are any, those of units with very many lines, which are spread (tasks: none)."""
    tasks = tasks_for(t.lineitem)
    sizes = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    many = cut_lineage(sizes.filter(c("n") > A.UNIT_ROWS // 3).select("l_orderkey"))  # a line gives three rows
    if many.isEmpty():
        return [(dealt(unit_rows(t.lineitem, t, tasks), ["unit_id"], tasks), tasks)]
    few = unit_rows(t.lineitem.join(many, "l_orderkey", "left_anti"), t, tasks)
    return [(dealt(few, ["unit_id"], tasks), tasks), (kept(unit_rows(t.lineitem.join(many, "l_orderkey", "left_semi"), t)), None)]


UNITS = """u AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS unit_id, l_linenumber * 1000000000::BIGINT + l_partkey * 10000 + l_suppkey AS line, 'Customer ' || o_custkey AS buyer,
 CASE WHEN l_suppkey % 2 = 0 THEN p_name ELSE upper(p_name) END AS item, CASE p_type WHEN 'ECONOMY' THEN 'Symptom' WHEN 'SMALL' THEN 'Medicine' WHEN 'PROMO' THEN 'Surgery' ELSE 'Disease' END AS kind,
 CASE WHEN l_suppkey % 7 = 0 THEN '患者' WHEN l_suppkey % 11 = 0 THEN '12.5 - 3' ELSE 'Supplier ' || l_suppkey END AS firm, l_returnflag, l_linestatus, l_tax
 FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey),
ent0 AS (SELECT unit_id, line * 3 AS pos, buyer AS name, 'Disease' AS type, 'buyer' AS description FROM u UNION ALL SELECT unit_id, line * 3 + 1, item, kind, NULL FROM u UNION ALL SELECT unit_id, line * 3 + 2, firm, 'Disease', '' FROM u),
ent AS (SELECT unit_id, name, count(*) AS n, min(pos) AS pos, arg_min(type, pos) AS type, coalesce(nullif(arg_min(coalesce(description, ''), pos), ''), name) AS description, name NOT IN ('患者', '12.5 - 3') AS valid FROM ent0 GROUP BY unit_id, name),
good AS (SELECT * FROM ent WHERE valid),
rel0 AS (SELECT unit_id, line * 3 AS pos, buyer AS s, CASE l_returnflag WHEN 'A' THEN 'HAS_SYMPTOM' WHEN 'N' THEN 'TREATED_BY' ELSE 'BELONGS_TO' END AS p, item AS o FROM u
 UNION ALL SELECT unit_id, line * 3 + 1, item, 'BELONGS_TO', firm FROM u UNION ALL SELECT unit_id, line * 3 + 2, CASE WHEN l_linestatus = 'F' THEN 'ghost' ELSE item END, 'HAS_COMPLICATION', CASE WHEN l_tax < 0.02 THEN '' ELSE item END FROM u),
cls AS (SELECT r.*, a.type AS st, b.type AS ot, CASE WHEN s = '' OR o = '' THEN 'empty' WHEN a.name IS NULL THEN 'subject_missing' WHEN b.name IS NULL THEN 'object_missing' WHEN s = o THEN 'self_loop' END AS reason
 FROM rel0 r LEFT JOIN good a ON a.unit_id = r.unit_id AND a.name = s LEFT JOIN good b ON b.unit_id = r.unit_id AND b.name = o),
tri AS (SELECT unit_id, s, p, o, min(pos) AS pos, count(*) AS n, any_value(st) AS st, any_value(ot) AS ot,
 CASE any_value(p) WHEN 'HAS_SYMPTOM' THEN NOT (any_value(st) IN ('Disease', 'Symptom') AND any_value(ot) = 'Symptom') WHEN 'TREATED_BY' THEN NOT (any_value(st) IN ('Disease', 'Symptom') AND any_value(ot) IN ('Medicine', 'Surgery'))
  WHEN 'HAS_COMPLICATION' THEN NOT (any_value(st) = 'Disease' AND any_value(ot) = 'Disease') ELSE false END AS mismatch FROM cls WHERE reason IS NULL GROUP BY unit_id, s, p, o)"""


def raw_entities(u):
    def row(shift, name, kind, text):
        return F.struct((c("line") * 3 + shift).alias("pos"), name.alias("name"), kind.alias("type"), text.alias("description"))

    none = F.lit(None).cast("string")
    rows = F.array(row(0, c("buyer"), F.lit("疾病"), F.lit(" buyer")), row(1, c("item"), c("kind"), none), row(2, c("firm"), none, F.lit(" ")))
    return u.select("unit_id", F.inline(rows))


def raw_relations(u):
    def row(shift, subject, predicate, target):
        return F.struct((c("line") * 3 + shift).alias("pos"), subject.alias("subject"), predicate.alias("predicate"), target.alias("object"))

    predicate = F.when(c("l_returnflag") == "A", "症状或体征").when(c("l_returnflag") == "N", "TREATED_BY").otherwise("unknown")
    ghost = F.when(c("l_linestatus") == "F", "ghost").otherwise(c("item"))
    rows = F.array(
        row(0, c("buyer"), predicate, c("item")), row(1, c("item"), F.lit("属于"), c("firm")),
        row(2, ghost, F.lit("并发症"), F.when(c("l_tax") < 0.02, " ").otherwise(c("item"))))
    return u.select("unit_id", F.inline(rows))


def validated(t, written=False, parts=None):
    found = [A.validate(raw_entities(u), raw_relations(u), written, tasks) for u, tasks in parts or unit_parts(t)]
    return tuple(reduce(DataFrame.unionByName, tables) for tables in zip(*found))


@query("kg1_entities", f"WITH {UNITS} SELECT unit_id, pos, name, type, description FROM good")
def _(t):
    return reduce(DataFrame.unionByName, [A.valid_entities(A.classify_entities(raw_entities(u))) for u, _ in unit_parts(t)])


@query("kg2_relation_reasons", f"WITH {UNITS} SELECT unit_id, reason, count(*) AS n FROM cls GROUP BY ALL")
def _(t):
    return validated(t)[2].groupBy("unit_id", "reason").agg(F.count("*").alias("n"))


@query("kg2_3_relations", f"WITH {UNITS} SELECT unit_id, s AS subject, p AS predicate, o AS object, pos, n, mismatch FROM tri")
def _(t):
    return validated(t)[3].select("unit_id", "subject", "predicate", "object", "pos", "n", "mismatch")


@query("kg4_validation_stats", f"""WITH {UNITS}, a AS (SELECT unit_id, sum(CASE WHEN valid THEN 0 ELSE n END)::BIGINT AS inv, sum(CASE WHEN valid THEN n - 1 ELSE 0 END)::BIGINT AS dup FROM ent GROUP BY ALL),
b AS (SELECT unit_id, count(*) FILTER (reason = 'subject_missing') AS sm, count(*) FILTER (reason = 'object_missing') AS om, count(*) FILTER (reason = 'self_loop') AS sl FROM cls GROUP BY ALL),
d AS (SELECT unit_id, sum(n - 1)::BIGINT AS rd, count(*) FILTER (mismatch) AS sw FROM tri GROUP BY ALL)
SELECT unit_id, inv AS entities_skipped_invalid, dup AS entities_skipped_duplicate, sm AS relations_skipped_subject_missing, om AS relations_skipped_object_missing, sl AS relations_skipped_self_loop,
 coalesce(rd, 0) AS relations_skipped_duplicate, 0 AS relations_type_mapped, coalesce(sw, 0) AS relations_semantic_warn FROM a JOIN b USING (unit_id) LEFT JOIN d USING (unit_id)""")
def _(t):
    classified, _, relations, triples = validated(t, written=True)
    return A.validation_stats(classified, relations, triples)


@query("kg5_merged_entities", f"WITH {UNITS} SELECT name, type, min((unit_id, pos))[1] AS unit_id, min((unit_id, pos))[2] AS pos, arg_min(description, (unit_id, pos)) AS description FROM good GROUP BY ALL")
def _(t):
    return A.merge_entities(validated(t)[1])


@query("kg5_merged_relations", f"WITH {UNITS} SELECT s AS subject, p AS predicate, o AS object, min((unit_id, pos))[1] AS unit_id, min((unit_id, pos))[2] AS pos FROM tri GROUP BY ALL")
def _(t):
    return A.merge_relations(validated(t)[3])


@query("kg7_batch_totals", f"""WITH {UNITS}, e AS (SELECT unit_id, count(*) AS entities FROM good GROUP BY ALL), r AS (SELECT unit_id, count(*) AS relations FROM tri GROUP BY ALL),
d AS (SELECT unit_id, entities, coalesce(relations, 0) AS relations, coalesce(relations, 0) > 1 AS ok FROM e LEFT JOIN r USING (unit_id))
SELECT count(*) AS total, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, sum(entities) FILTER (ok)::BIGINT AS entities, sum(relations) FILTER (ok)::BIGINT AS relations FROM d""")
def _(t):
    _, entities, _, triples = validated(t, written=True)
    e = entities.groupBy("unit_id").agg(F.count("*").alias("entities"))
    r = triples.groupBy("unit_id").agg(F.count("*").alias("relations"))
    docs = e.join(r, "unit_id", "left").na.fill(0, ["relations"]).withColumn("ok", c("relations") > 1)
    return A.batch_totals(docs)


@query("kg8_upsert_nodes", """WITH old AS (SELECT 'Disease' AS label, p_name AS name, 'Disease' AS type, min(p_brand) AS description FROM part WHERE p_size < 25 GROUP BY ALL),
new AS (SELECT CASE WHEN p_size % 3 = 0 THEN 'Medicine' ELSE 'Disease' END AS label, p_name AS name, CASE WHEN p_size % 3 = 0 THEN 'Medicine' ELSE 'Disease' END AS type, arg_max(p_type, p_partkey) FILTER (p_size % 2 = 0) AS description FROM part WHERE p_size >= 20 GROUP BY ALL)
SELECT label, name, coalesce(n.type, o.type) AS type, coalesce(n.description, o.description) AS description, CASE WHEN o.type IS NULL THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END AS created_at,
 CASE WHEN n.type IS NOT NULL AND o.type IS NOT NULL THEN TIMESTAMP '2024-02-01' END AS updated_at FROM old o FULL JOIN new n USING (label, name)""")
def _(t):
    old = t.part.filter("p_size < 25").groupBy(F.lit("Disease").alias("label"), c("p_name").alias("name")).agg(
        F.lit("Disease").alias("type"), F.min("p_brand").alias("description"), F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"))
    new = t.part.filter("p_size >= 20").select(F.concat(F.lit(" "), c("p_name")).alias("name"), F.when(c("p_size") % 3 == 0, " Medicine").otherwise("Pa-rt").alias("type"), F.when(c("p_size") % 2 == 0, F.concat(c("p_type"), F.lit(" "))).alias("description"), c("p_partkey").alias("pos"))
    return A.upsert_nodes(old, new, "2024-02-01")


@query("kg9_upsert_edges", f"""WITH {UNITS}, names AS (SELECT DISTINCT name FROM good WHERE type <> 'Medicine'), old AS (SELECT DISTINCT s, p, o FROM tri WHERE p = 'TREATED_BY'),
new AS (SELECT DISTINCT s, p, o FROM rel0 WHERE s <> o AND s IN (SELECT name FROM names) AND o IN (SELECT name FROM names) AND (s, p, o) NOT IN (SELECT (s, p, o) FROM old))
SELECT s AS subject, p AS predicate, o AS object, TIMESTAMP '2024-01-01' AS created_at FROM old UNION ALL SELECT s, p, o, TIMESTAMP '2024-02-01' FROM new""")
def _(t):
    from loomwright.functions import text as T

    parts = unit_parts(t)
    _, entities, _, triples = validated(t, True, parts)
    # read for the edges kept and for those not to be added again
    old = kept(triples.filter("predicate = 'TREATED_BY'").select("subject", "predicate", "object").distinct().withColumn("created_at", F.lit("2024-01-01").cast("timestamp")))
    incoming = raw_relations(reduce(DataFrame.unionByName, [u for u, _ in parts])).select(T.normalize_name(c("subject")).alias("subject"), "predicate", T.normalize_name(c("object")).alias("object"))
    return A.upsert_edges(old, incoming, entities.filter("type <> 'Medicine'"), "2024-02-01")


@query("kg10_merge_properties", """SELECT p_partkey AS id, p_brand AS brand, CASE WHEN p_size > 25 THEN 'new' ELSE p_type END AS kind, CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) END AS size FROM part""")
def _(t):
    old = t.part.select(c("p_partkey").alias("id"), F.create_map(F.lit("brand"), c("p_brand"), F.lit("kind"), c("p_type")).alias("properties"))
    new = t.part.filter("p_size > 25").select(c("p_partkey").alias("id"), F.create_map(F.lit("kind"), F.lit("new"), F.lit("size"), c("p_size").cast("string")).alias("properties"))
    merged = A.merge_properties(old, new, ["id"])
    return merged.select("id", *[c("properties")[k].alias(k) for k in ("brand", "kind", "size")])


@query("kg11_snapshot_tables", f"""WITH {UNITS}, n AS (SELECT unit_id, name, type, description FROM good), e AS (SELECT DISTINCT unit_id, s, p, o FROM tri)
SELECT unit_id, 'node' AS part, name AS id, lower(type) AS kind, description AS detail FROM n UNION ALL SELECT unit_id, 'edge', s || '_' || p || '_' || o, p, s || '>' || o FROM e""")
def _(t):
    _, entities, _, triples = validated(t, written=True)
    n = A.snapshot_nodes(entities, ["unit_id"]).select("unit_id", F.lit("node").alias("part"), "id", c("category").alias("kind"), c("description").alias("detail"))
    e = A.snapshot_edges(triples, ["unit_id"]).select("unit_id", F.lit("edge").alias("part"), "id", c("relation").alias("kind"), F.concat_ws(">", "source", "target").alias("detail"))
    return n.union(e)


@query("kg12_official_graph", f"WITH {UNITS} SELECT 'node' AS part, name AS id FROM good GROUP BY ALL UNION ALL SELECT DISTINCT 'edge', s || '_' || p || '_' || o FROM tri")
def _(t):
    _, entities, _, triples = validated(t, written=True)
    n = A.snapshot_nodes(A.merge_entities(entities), [])
    e = A.snapshot_edges(A.merge_relations(triples), [])
    return n.select(F.lit("node").alias("part"), "id").union(e.select(F.lit("edge").alias("part"), "id"))


def triples(t):
    rows = t.lineitem.join(t.part, c("l_partkey") == c("p_partkey"))
    firm, item = F.expr("'firm' || l_suppkey"), c("p_name")
    forward = rows.filter("l_returnflag = 'A'").select(F.concat(firm, F.lit("[疾病]")).alias("header"), F.lit(" 症状 ").alias("relation"), item.alias("tail"))
    backward = rows.filter("l_returnflag = 'N'").select(F.concat(item, F.lit("[症状]")), F.lit("可能疾病"), F.concat(firm, F.lit(" [疾病]")))
    other = rows.filter("l_returnflag = 'R'").select(F.concat(item, F.lit("[药物]")), F.lit("可能疾病"), firm)
    return forward.union(backward).union(other)


PAIRS = """pairs AS (SELECT DISTINCT CASE l_returnflag WHEN 'A' THEN 'disease_symptom' ELSE 'symptom_disease' END AS direction, 'firm' || l_suppkey AS disease, p_name AS symptom
 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('A', 'N'))"""


@query("kg13_symptom_pairs", f"WITH {PAIRS} SELECT * FROM pairs")
def _(t):
    return A.symptom_pairs(triples(t))


GOLD = f"""{PAIRS}, d AS (SELECT symptom, disease, row_number() OVER (PARTITION BY symptom ORDER BY disease) AS r FROM pairs WHERE direction = 'symptom_disease'),
s AS (SELECT symptom, 'cmkg_' || lpad(CAST(row_number() OVER (ORDER BY symptom) AS VARCHAR), 3, '0') AS sample_id, symptom || '这一症状常见相关疾病包括' || string_agg(disease, '、' ORDER BY disease) FILTER (r <= 5) || '等。' AS text, count(*) AS n_diseases
 FROM d GROUP BY symptom ORDER BY symptom LIMIT 100)"""


@query("kg14_gold_samples", f"WITH {GOLD} SELECT sample_id, symptom, text, n_diseases FROM s")
def _(t):
    return A.gold_samples(A.symptom_pairs(triples(t)), prefix="cmkg_")[0]


@query("kg14_gold_relations", f"WITH {GOLD} SELECT sample_id, disease, symptom, r AS place FROM s JOIN d USING (symptom)")
def _(t):
    return A.gold_samples(A.symptom_pairs(triples(t)), prefix="cmkg_")[1]


@query("kg15_tiered_lookup", """WITH m AS (SELECT doc_id, min(name) AS name FROM documents JOIN (SELECT DISTINCT split_part(p_name, ' ', 1) AS name FROM part) d ON contains(text, d.name) GROUP BY ALL),
x AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS name, split_part(p_name, ' ', 2) AS tail FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY tail) AS rank FROM x QUALIFY rank <= 2)
SELECT doc_id, name, CAST(rank AS INT) AS rank, tail FROM m JOIN r USING (name)""")
def _(t):
    from loomwright.operators.dictionary import match_with_synonyms

    names = t.part.select(F.split("p_name", " ")[0].alias("name")).distinct()
    matches = match_with_synonyms(t.documents.select("doc_id", "text"), names.withColumn("synonym", c("name")), "doc_id", "text")
    known = t.part.select(F.split("p_name", " ")[0].alias("header"), F.lit("has").alias("relation"), F.split("p_name", " ")[1].alias("tail")).distinct().withColumn("pos", c("tail"))
    return A.tiered_lookup(matches, known, "has", "doc_id")


CASCADE = """w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS name, p_brand, p_type FROM part), k AS (SELECT DISTINCT name, CASE length(name) % 3 WHEN 0 THEN 'disease' WHEN 1 THEN 'symptom' ELSE 'record' END AS kind FROM w),
words AS (SELECT kind, name, name AS word FROM k UNION SELECT kind, name, translate(name, 'aeiou', 'eioua') FROM k),
triples AS (SELECT DISTINCT name AS header, '症状' AS relation, p_brand AS tail FROM w WHERE length(name) = 3 UNION SELECT DISTINCT name, 'check', p_brand FROM w WHERE contains(name, 'a') UNION SELECT DISTINCT name, 'recommand_drug', p_type FROM w),
tails AS (SELECT *, row_number() OVER (PARTITION BY header, relation ORDER BY tail) AS r FROM triples QUALIFY r <= 2),
hits AS (SELECT doc_id, kind, name, bool_and(word <> name) AS syn FROM documents JOIN words ON contains(text, word) GROUP BY ALL),
own AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY syn, name) AS r FROM hits h WHERE NOT syn OR NOT EXISTS (SELECT 1 FROM hits d WHERE d.doc_id = h.doc_id AND d.kind = h.kind AND NOT d.syn) QUALIFY r <= 2),
steps AS (SELECT doc_id, 'symptom' AS step, 1 AS tier, name, syn, tails.r AS rank, tail AS item FROM own JOIN tails ON header = name AND relation = '症状' WHERE kind = 'disease' AND own.r = 1
 UNION ALL SELECT doc_id, 'symptom', 2, name, syn, r, name FROM own WHERE kind = 'symptom' UNION ALL SELECT doc_id, relation, 1, name, syn, tails.r, tail FROM own JOIN tails ON header = name AND relation <> '症状' WHERE kind = 'record' AND own.r = 1)"""


@query("kg15_cascade", f"WITH {CASCADE} SELECT doc_id, step, tier, name, syn AS by_synonym, CAST(rank AS INT) AS rank, item FROM steps QUALIFY tier = min(tier) OVER (PARTITION BY doc_id, step)")
def _(t):
    w = t.part.select(F.explode(F.split("p_name", " ")).alias("name"), "p_brand", "p_type").distinct()
    size = F.length("name") % 3
    kinds = w.select(F.when(size == 0, "disease").when(size == 1, "symptom").otherwise("record").alias("kind"), "name").distinct()
    words = kinds.withColumn("word", c("name")).union(kinds.withColumn("word", F.translate("name", "aeiou", "eioua"))).distinct()
    own = w.filter(F.length("name") == 3).select(c("name").alias("header"), F.lit("症状").alias("relation"), c("p_brand").alias("tail"))
    check = w.filter(c("name").contains("a")).select("name", F.lit("check"), "p_brand")
    drug = w.select("name", F.lit("recommand_drug"), "p_type")
    known = own.union(check).union(drug).distinct().withColumn("pos", c("tail"))
    return A.tiered_cascade(spread(t.documents.select("doc_id", "text")), words, known, "doc_id", "text")


@query("kg16_sync_snapshots", f"""WITH {NATION}, by_name AS (SELECT graph_id, name, min(id) AS id FROM people GROUP BY ALL), n AS (SELECT DISTINCT type AS label, name FROM people),
e AS (SELECT DISTINCT a.name AS s, b.name AS o FROM links l JOIN people a ON a.graph_id = l.graph_id AND a.id = l.src LEFT JOIN people x ON x.graph_id = l.graph_id AND x.id = l.dst
 LEFT JOIN by_name y ON y.graph_id = l.graph_id AND y.name = l.dst JOIN people b ON b.graph_id = l.graph_id AND b.id = coalesce(x.id, y.id) WHERE a.name <> b.name)
SELECT label AS kind, name AS key FROM n UNION ALL SELECT 'edge', s || '>' || o FROM e""")
def _(t):
    n, e = SN.snapshot_to_nodes(snapshots(t)), SN.snapshot_to_edges(snapshots(t))
    empty_nodes = n.limit(0).select(c("type").alias("label"), "name", "type", "description", F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"))
    synced = A.upsert_nodes(empty_nodes, n, "2024-02-01", types=None)
    ends = n.select("graph_id", "id", "name")
    solved = SN.resolve_endpoints(e, n, ["graph_id"])
    named = solved.join(ends.toDF("graph_id", "src", "subject"), ["graph_id", "src"]).join(ends.toDF("graph_id", "dst", "object"), ["graph_id", "dst"])
    empty_edges = e.limit(0).select(c("src").alias("subject"), c("rel").alias("predicate"), c("dst").alias("object"), F.lit(None).cast("timestamp").alias("created_at"))
    added = A.upsert_edges(empty_edges, named.select("subject", c("rel").alias("predicate"), "object"), synced, "2024-02-01")
    return synced.select(c("label").alias("kind"), c("name").alias("key")).union(added.select(F.lit("edge").alias("kind"), F.concat_ws(">", "subject", "object").alias("key")))
