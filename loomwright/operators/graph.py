"""Graph queries over node and edge tables, written as equi joins, semi joins and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright import vocab as V
from loomwright.functions import text as T
from loomwright.operators.ranking import first_n, page
from loomwright.session import cut_lineage

c = F.col


def _one_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One whole row per key, the smallest by ``order``."""
    rest = [n for n in df.columns if n not in keys]
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f"))
    return kept.select(*keys, *[f"_f.{n}" for n in rest])


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    e = edges.agg(F.count("*").alias("edges"), F.count_distinct("rel").alias("relation_types"))
    out = nodes.agg(F.count("*").alias("nodes"), F.count_distinct("type").alias("labels"))
    return out.withColumns({n: e.select(n).scalar() for n in ("edges", "relation_types")})


def counts_by_type(spark: SparkSession, nodes: DataFrame, edges: DataFrame, entity_types: list[str], relation_types: list[str]) -> DataFrame:
    """Number of nodes and edges of every configured type, 0 for absent ones, plus the totals."""
    n = nodes.groupBy(F.lit("node").alias("kind"), "type").agg(F.count("*").alias("n"))
    e = edges.groupBy(F.lit("edge").alias("kind"), c("rel").alias("type")).agg(F.count("*").alias("n"))
    found = n.unionByName(e)
    known = [("node", x) for x in entity_types] + [("edge", x) for x in relation_types]
    vocabulary = spark.createDataFrame(known, "kind string, type string")
    listed = vocabulary.join(found, ["kind", "type"], "left").select("kind", "type", F.coalesce("n", F.lit(0)).alias("n"))
    totals = found.groupBy("kind").agg(F.lit("total").alias("type"), F.sum("n").alias("n"))
    return listed.unionByName(totals)


def label_histogram(nodes: DataFrame, n: int = 20) -> DataFrame:
    return nodes.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type").limit(n)


def relation_histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rel").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rel")


def search_by_name(nodes: DataFrame, keyword: str, node_type: str | None = None, limit: int = 20, ignore_case: bool = False) -> DataFrame:
    """Nodes whose name contains the keyword, in id order."""
    name = F.lower("name") if ignore_case else c("name")
    found = nodes.filter(name.contains(keyword.lower() if ignore_case else keyword))
    if node_type is not None:
        found = found.filter(c("type") == node_type)
    return found.orderBy("id").limit(limit)


def search_anywhere(nodes: DataFrame, keyword: str, node_type: str | None = None) -> DataFrame:
    """Nodes with the keyword anywhere in their JSON form, case-insensitively, one row per id."""
    found = nodes.filter(F.lower(F.to_json(F.struct(*nodes.columns))).contains(keyword.lower()))
    if node_type is not None:
        found = found.filter(F.lower("type") == node_type.lower())
    return _one_per(found, ["id"], ["graph_id", "name", "type"])


def find_nodes(nodes: DataFrame, node_type: str, properties: dict[str, str], limit: int = 100) -> DataFrame:
    found = nodes.filter(c("type") == node_type)
    for name, value in properties.items():
        found = found.filter((c(name) if name in nodes.columns else c("properties")[name]) == value)
    return found.orderBy("id").limit(limit)


def search_relations(edges: DataFrame, keyword: str | None = None, label: str | None = None, tasks: int | None = None) -> DataFrame:
    """Edges whose label or any property contains the keyword (ignoring case), of one label; distinct ids.

    With ``tasks`` the edges are dealt out to so many by id, instead of to the session's number, and sorted once.
    """
    found = edges if label is None else edges.filter(c("rel") == label)
    if keyword:
        word = keyword.lower()
        values = F.coalesce(F.map_values("properties"), F.array().cast("array<string>"))
        found = found.filter(F.lower("rel").contains(word) | F.exists(values, lambda v: F.lower(v).contains(word)))
    return _one_per(found.repartition(tasks, "id") if tasks else found, ["id"], ["graph_id", "src", "rel", "dst"])


def both_ways(edges: DataFrame) -> DataFrame:
    """(edge_id, from, rel, to, outgoing): every edge seen from either end; the edges are formed once."""
    ends = F.array(
        F.struct(c("src").alias("from"), c("dst").alias("to"), F.lit(True).alias("outgoing")),
        F.struct(c("dst").alias("from"), c("src").alias("to"), F.lit(False).alias("outgoing")))
    return edges.select(c("id").alias("edge_id"), "rel", F.inline(ends)).select("edge_id", "from", "rel", "to", "outgoing")


def entity_details(ids: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The wanted nodes with one row per incident edge (the other end named); isolated nodes keep one row."""
    incident = both_ways(edges).join(ids.select(c("id").alias("from")), "from", "left_semi")
    other = nodes.select(c("id").alias("to"), c("name").alias("other_name"), c("type").alias("other_type"))
    named = incident.join(other, "to", "left").withColumnsRenamed({"from": "id", "to": "other_id"})
    return nodes.join(ids.select("id"), "id", "left_semi").join(named, "id", "left")


def relation_details(ids: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.join(ids.select("id"), "id", "left_semi")


def expand(ids: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct incident edges and the nodes on their other side."""
    incident = both_ways(edges).join(ids.select(c("id").alias("from")), "from", "left_semi")
    touched = incident.select(c("edge_id").alias("id")).distinct()
    return nodes.join(incident.select(c("to").alias("id")), "id", "left_semi"), edges.join(touched, "id", "left_semi")


def direct_entities(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes bearing the wanted names (query_id, name), with score 1."""
    return nodes.join(names, "name").withColumn("relevance_score", F.lit(1.0))


def neighbours_by_relation(names: DataFrame, nodes: DataFrame, edges: DataFrame, rel: str | None = None, direction: str = "both") -> DataFrame:
    """(query_id, name) to the nodes one edge away in a direction: out, in or both; score 0.8."""
    wanted = edges if rel is None else edges.filter(c("rel") == rel)
    sides = both_ways(wanted)
    if direction != "both":
        sides = sides.filter(c("outgoing") == (direction == "out"))
    start = names.join(nodes.select("name", c("id").alias("from")), "name")
    far = nodes.select(c("id").alias("to"), c("name").alias("other_name"), c("type").alias("other_type"))
    found = start.join(sides, "from").join(far, "to")
    return found.select(
        "query_id", "name", c("to").alias("node_id"), "other_name", "other_type", "rel", "outgoing", F.lit(0.8).alias("relevance_score")
    )


def dedupe_and_rank(hits: DataFrame, preferred: Column) -> DataFrame:
    """Best score per key and query, with 0.2 more (at most 1) for a preferred relation type.

    The key is the node id, else the pair of path ends, else the name. ``preferred`` is an array of relation types.
    """
    liked = F.coalesce(F.arrays_overlap(F.coalesce("relation_types", F.array().cast("array<string>")), preferred), F.lit(False))
    score = F.least(F.lit(1.0), c("relevance_score") + F.when(liked, 0.2).otherwise(0.0))
    path = F.concat(F.lit("path:"), "start_entity", F.lit("->"), "end_entity")
    key = F.coalesce(c("node_id"), F.when(c("type") == "path", path), c("name"))
    rows = hits.withColumn("relevance_score", score).withColumn("key", key)
    rest = [n for n in rows.columns if n not in ("query_id", "key")]
    best = F.min_by(F.struct(*rest), F.struct(-c("relevance_score"), c("pos"))).alias("_f")
    return rows.groupBy("key", "query_id").agg(best).select("query_id", "key", *[f"_f.{n}" for n in rest])


def graph_page(nodes: DataFrame, edges: DataFrame, limit: int = 100, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page of nodes in id order and the edges with both ends on it."""
    chosen = page(nodes, [c("id")], limit, offset).drop("total")
    ids = chosen.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return chosen, inside


def visual(nodes: DataFrame) -> DataFrame:
    """Symbol size from the importance, colour from the type, and the display category."""
    def lookup(key: Column, table: dict[str, str], default: Column | str) -> Column:
        return F.coalesce(F.element_at(T.mapping(table), key), default if isinstance(default, Column) else F.lit(default))

    kind = F.coalesce("type", F.lit("Entity"))
    importance = F.coalesce(c("properties")["importance"].try_cast("double"), F.lit(1.0))
    return nodes.select(
        "id", "name", (40 + importance * 10).alias("symbol_size"), lookup(kind, V.NODE_COLOURS, V.NODE_COLOUR_DEFAULT).alias("color"),
        F.lower(kind).alias("category"), lookup(F.lower(kind), V.DISPLAY_CATEGORIES, F.lower(kind)).alias("display_category"),
    )


def visible_to(graphs: DataFrame, user: Column | str | None) -> DataFrame:
    """Graphs without an owner, or owned by the caller; a caller without an id sees all."""
    if user is None:
        return graphs
    owner = F.nullif(c("user_id"), F.lit(""))
    return graphs.filter(owner.isNull() | (owner == user))


def merge_visible(default_graphs: DataFrame, user_graphs: DataFrame) -> DataFrame:
    """One row per graph id; the user's row wins over a default one."""
    rest = [n for n in default_graphs.columns if n != "graph_id"]
    ranked = default_graphs.withColumn("_p", F.lit(0)).unionByName(user_graphs.withColumn("_p", F.lit(1)))
    best = F.max_by(F.struct(*rest), "_p").alias("_f")
    return ranked.groupBy("graph_id").agg(best).select("graph_id", *[f"_f.{n}" for n in rest])


def merge_graphs(nodes: DataFrame, edges: DataFrame, node_limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes of several graphs, the first per id by (graph, position), and edges distinct by id.

    With ``node_limit`` graphs are taken in order until their new nodes reach it; the one that does gives its first nodes up
    to the limit and all its edges, graphs after it nothing. Running sums over graph sizes find it, and only its own nodes
    are sorted.
    """
    merged = _one_per(nodes, ["id"], ["graph_id", "pos"])
    if node_limit is not None:
        sizes = merged.groupBy("graph_id").agg(F.count("*").alias("_n")).unionByName(edges.select("graph_id").distinct().withColumn("_n", F.lit(0).cast("bigint")))
        upto = F.sum("_n").over(Window.orderBy("graph_id"))  # one row per graph
        running = cut_lineage(sizes.groupBy("graph_id").agg(F.sum("_n").alias("_n")).withColumn("_before", upto - c("_n")).filter(c("_before") < node_limit))
        inside = running.filter(c("_before") + c("_n") <= node_limit).select("graph_id")
        last = running.filter(c("_before") + c("_n") > node_limit)
        room = node_limit - (last.select(F.max("_before")).first()[0] or 0)
        cut_off = merged.join(last.select("graph_id"), "graph_id", "left_semi").orderBy("pos", "id").limit(room)
        merged = merged.join(inside, "graph_id", "left_semi").unionByName(cut_off)
        edges = edges.join(running.select("graph_id"), "graph_id", "left_semi")
    return merged, _one_per(edges, ["id"], ["graph_id", "pos"])


# Fixed value: what a graph without nodes is shown as.
EMPTY_GRAPH = "（暂无节点数据，请上传并构建后查看）"


def or_placeholder(nodes: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``nodes(id, name, category)``, or one node that names the first graph of the catalogue where there are none."""
    first = catalogue.agg(F.min_by(F.struct("graph_id", "graph_name"), "graph_id").alias("g")).filter("g is not null")
    name = F.concat(F.coalesce(F.nullif(c("g.graph_name"), F.lit("")), F.lit("默认图谱")), F.lit(EMPTY_GRAPH))
    none = nodes.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(1).alias("_one"))
    shown = first.withColumn("_one", F.lit(1)).join(none, "_one", "left_semi")
    return nodes.select("id", "name", "category").union(shown.select(F.concat(F.lit("_placeholder_"), c("g.graph_id")), name, F.lit("entity")))


def list_graphs(catalogue: DataFrame, status: str | None = None, user: str | None = None, defaults: bool = False, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the catalogue, newest first: of one status, of one user, or the ownerless defaults; each only when asked."""
    wanted = catalogue
    if status:
        wanted = wanted.filter(c("status") == status)
    if defaults:
        wanted = wanted.filter(c("user_id").isNull())
    elif user:
        wanted = wanted.filter(c("user_id") == user)
    return page(wanted, [F.desc("created_at"), c("graph_id")], limit, offset)


def listing_line() -> Column:
    """A catalogue row as a line of text: id, name and sizes."""
    return F.concat(
        F.lit("- "), F.coalesce("graph_id", F.lit("")), F.lit("\t"), F.coalesce("graph_name", F.lit("")), F.lit("\t节点"), F.coalesce("entity_count", F.lit(0)).cast("string"),
        F.lit(" 关系"), F.coalesce("relation_count", F.lit(0)).cast("string"))


def intent_names(starts: DataFrame, nodes: DataFrame, edges: DataFrame, rel: str, outgoing: bool, target_type: str) -> DataFrame:
    """Names one fixed step away from each start node (query_id, name); the pattern behind the intent answers."""
    steps = both_ways(edges.filter(c("rel") == rel)).filter(c("outgoing") == outgoing)
    begin = starts.join(nodes.select("name", c("id").alias("from")), "name")
    far = nodes.filter(c("type") == target_type).select(c("id").alias("to"), c("name").alias("answer"))
    return begin.join(steps, "from").join(far, "to").select("query_id", "name", "answer").distinct()


# Answer frames per coarse intent with their relation types, and the closing texts.
ANSWER_FRAMES = {
    "symptom_query": (["HAS_SYMPTOM"], "根据医疗知识库，主要症状包括：", "。建议及时就医。"),
    "treatment_query": (["TREATED_BY", "TREATS_COMPLICATION"], "常用治疗方法包括：", "。请遵医嘱用药。"),
    "department_query": (["BELONGS_TO_DEPARTMENT", "TREATED_AT_HOSPITAL"], "建议挂号科室：", "。"),
    "prognosis_query": (["HAS_PROGNOSIS"], "预后情况：", "。具体请咨询主治医生。"),
    "population_query": (["AFFECTS_POPULATION"], "多发人群：", "。"),
    "diagnosis_query": (["REQUIRES_EXAM", "HAS_ABNORMAL_EXAM_RESULT"], "相关检查包括：", "。"),
}
ANSWER_NONE = "抱歉，我没有找到相关的医疗信息。请咨询专业医生。"
ANSWER_MORE = " 详细信息请咨询专业医生。"


def intent_answers(questions: DataFrame, knowledge: DataFrame) -> DataFrame:
    """A sentence per question from its retrieved rows.

    ``questions(query_id, intent)``; ``knowledge(query_id, pos, entity, relation, related_entity, description)``.
    Retrieval returns at most ``top_k`` rows per question, so the name list of one question is bounded by it. Symptom rows
    without names still give the symptom sentence; other intents without names give the general one.
    """
    joined = knowledge.join(questions, "query_id")
    wanted = F.lit(False)
    for intent, (relations, _, _) in ANSWER_FRAMES.items():
        wanted = wanted | ((c("intent") == intent) & c("relation").isin(relations))
    item = F.when(c("relation").isin("TREATED_BY", "TREATS_COMPLICATION"), F.coalesce(F.nullif(c("related_entity"), F.lit("")), c("entity"))).otherwise(c("related_entity"))
    named = joined.withColumn("_item", F.when(wanted, F.nullif(item, F.lit("")))).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.when(c("_item").isNotNull(), F.struct("pos", "_item")))).alias("_items"),
        F.min(F.struct("pos", "entity", "description")).alias("_first"), F.max(wanted).alias("_any"),
    )
    names = F.array_join(F.transform("_items", lambda x: x["_item"]), ", ")
    about = F.concat(F.lit("关于"), F.coalesce(c("_first.entity"), F.lit("")))
    general = F.concat(about, F.when(F.coalesce(c("_first.description"), F.lit("")) != "", F.concat(F.lit("："), c("_first.description"))).otherwise(""), F.lit(ANSWER_MORE))
    answer = F.when(c("_first").isNull(), ANSWER_NONE)
    for intent, (_, before, after) in ANSWER_FRAMES.items():
        usable = c("_any") if intent == "symptom_query" else F.size("_items") > 0
        answer = answer.when((c("intent") == intent) & usable, F.concat(F.lit(before), names, F.lit(after)))
    return questions.join(named, "query_id", "left").select("query_id", "intent", answer.otherwise(general).alias("answer"))


def quality_checks(nodes: DataFrame, edges: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Per graph: nodes and edges with missing fields, dangling edges, declared against actual counts."""
    def blank(*names: str) -> Column:
        tests = [F.coalesce(c(n), F.lit("")) == "" for n in names]
        out = tests[0]
        for test in tests[1:]:
            out = out | test
        return out

    n = nodes.groupBy("graph_id").agg(F.count("*").alias("nodes"), F.count_if(blank("id", "name", "type")).alias("bad_nodes"))
    e = edges.groupBy("graph_id").agg(F.count("*").alias("edges"), F.count_if(blank("src", "dst", "rel")).alias("bad_edges"))
    ids = nodes.select("graph_id", "id").distinct()
    loose = edges.join(ids.withColumnRenamed("id", "src"), ["graph_id", "src"], "left_anti").unionByName(
        edges.join(ids.withColumnRenamed("id", "src"), ["graph_id", "src"], "left_semi").join(ids.withColumnRenamed("id", "dst"), ["graph_id", "dst"], "left_anti"))
    d = loose.groupBy("graph_id").agg(F.count("*").alias("dangling"))
    joined = catalogue.join(n, "graph_id", "left").join(e, "graph_id", "left").join(d, "graph_id", "left")
    filled = joined.na.fill(0, ["nodes", "bad_nodes", "edges", "bad_edges", "dangling"])
    return filled.select(
        "graph_id", "nodes", "bad_nodes", "edges", "bad_edges", "dangling",
        (c("nodes") == c("entity_count")).alias("entity_count_ok"), (c("edges") == c("relation_count")).alias("relation_count_ok"),
    )


def snapshot_summaries(catalogue: DataFrame, nodes: DataFrame, edges: DataFrame, shown: int = 15) -> DataFrame:
    """Text per graph: counts and the first nodes and edges. Only the shown rows of a graph come together."""
    def part(df: DataFrame, text: Column, name: str) -> DataFrame:
        counts = df.groupBy("graph_id").agg(F.count("*").alias(f"n_{name}"))
        top = first_n(df, ["graph_id"], [c("pos")], shown).withColumn("_t", text)
        listed = top.groupBy("graph_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_t"))), lambda x: x["_t"]), "; ").alias(name))
        return counts.join(listed, "graph_id")

    n = part(nodes, F.concat(F.coalesce("name", "id"), F.lit(" ("), F.coalesce("type", F.lit("")), F.lit(")")), "nodes")
    e = part(edges, F.concat("src", F.lit(" --["), "rel", F.lit("]--> "), "dst"), "edges")
    rows = catalogue.join(n, "graph_id", "left").join(e, "graph_id", "left").na.fill(0, ["n_nodes", "n_edges"])
    head = F.concat(F.lit("图谱 "), "graph_name", F.lit("（"), "graph_id", F.lit("）：共 "), c("n_nodes").cast("string"), F.lit(" 节点、"), c("n_edges").cast("string"), F.lit(" 关系。"))
    return rows.select("graph_id", F.concat_ws(
        "\n", head, F.when(c("nodes").isNotNull(), F.concat(F.lit("节点示例: "), "nodes")), F.when(c("edges").isNotNull(), F.concat(F.lit("关系示例: "), "edges")),
    ).alias("summary"))


def graph_sizes(catalogue: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Catalogue rows with the actual number of nodes and relations of each graph."""
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("node_count"))
    e = edges.groupBy("graph_id").agg(F.count("*").alias("edge_count"))
    return catalogue.join(n, "graph_id", "left").join(e, "graph_id", "left").na.fill(0, ["node_count", "edge_count"])
