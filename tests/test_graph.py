"""Graph operators on small graphs, against plain breadth-first search."""

import itertools
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from loomwright.operators import assembly as A
from loomwright.operators import building as B
from loomwright.operators import graph as G
from loomwright.operators import retrieval as R
from loomwright.operators import traversal as TR
from loomwright.operators.ranking import positions
from loomwright.sources import snapshots as SN

EDGE = "id string, src string, rel string, dst string"


def edges_of(spark, pairs):
    return spark.createDataFrame([(f"{a}_R_{b}", a, "R", b) for a, b in pairs], EDGE)


def distances(pairs, start):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seen, queue = {start: 0}, deque([start])
    while queue:
        at = queue.popleft()
        for to in near.get(at, ()):
            if to not in seen:
                seen[to] = seen[at] + 1
                queue.append(to)
    return seen


@pytest.fixture(scope="module")
def random_pairs():
    rng = random.Random(7)
    return sorted({(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(38)} - {(f"n{i}", f"n{i}") for i in range(30)})


def test_k_hop_is_bfs_distance(spark, random_pairs):
    seeds = spark.createDataFrame([("q1", "n1"), ("q2", "n2"), ("q2", "n3")], "q string, id string")
    got = {(r["q"], r["id"]): r["hop"] for r in TR.k_hop(seeds, edges_of(spark, random_pairs), 3, ["q"]).collect()}
    d1, d2, d3 = (distances(random_pairs, n) for n in ("n1", "n2", "n3"))
    expected = {("q1", n): d for n, d in d1.items() if d <= 3}
    for n in set(d2) | set(d3):
        d = min(d2.get(n, 99), d3.get(n, 99))
        if d <= 3:
            expected["q2", n] = d
    assert got == expected


@pytest.mark.parametrize("limit", [1, 2, 3, 4, 5])
def test_shortest_paths(spark, random_pairs, limit):
    names = sorted({n for p in random_pairs for n in p})[:8]
    pairs = [(a, b) for a, b in itertools.permutations(names, 2)]
    found = TR.shortest_paths(spark.createDataFrame(pairs, "start string, goal string"), edges_of(spark, random_pairs), limit).collect()
    links = set(random_pairs) | {(b, a) for a, b in random_pairs}
    assert {(r["start"], r["goal"]): r["path_length"] for r in found} == {
        (a, b): distances(random_pairs, a)[b] for a, b in pairs if 0 < distances(random_pairs, a).get(b, 99) <= limit}
    for r in found:
        path = r["path_nodes"]
        assert path[0] == r["start"] and path[-1] == r["goal"] and len(path) == r["path_length"] + 1 == len(r["relation_types"]) + 1
        assert all(step in links for step in zip(path, path[1:]))


def test_shortest_paths_among(spark, random_pairs):
    names = sorted({n for p in random_pairs for n in p})[:8]
    found = TR.shortest_paths_among(spark.createDataFrame([(n,) for n in names], "id string"), edges_of(spark, random_pairs), 5).collect()
    assert {(r["start"], r["goal"]): r["path_length"] for r in found} == {
        (a, b): distances(random_pairs, a)[b] for a, b in itertools.permutations(names, 2) if distances(random_pairs, a).get(b, 99) <= 5}


def test_paths_use_no_edge_twice(spark):
    edges = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "a")])
    paths = TR.expand_paths(spark.createDataFrame([("a",)], "id string"), edges, 3).collect()
    assert len(paths) == 6 and all(len(set(p["edge_ids"])) == p["hop"] for p in paths)


def test_snapshot_round_trip_and_parts(spark):
    nodes = spark.createDataFrame([("g", f"n{i}", f"name{i}") for i in range(25)], "graph_id string, id string, name string")
    edges = spark.createDataFrame([("g", f"e{i}", f"n{i}", "R", f"n{i + 1}") for i in range(24)], "graph_id string, id string, source string, relation string, target string")
    written = SN.write_snapshots(nodes, edges, items_per_part=10)
    assert written.count() == 3
    assert SN.snapshot_to_nodes(written).count() == 25 and SN.snapshot_to_edges(written).count() == 24
    assert SN.write_snapshots(nodes, edges).count() == 1


def test_snapshot_places_do_not_depend_on_parts(spark):
    nodes = spark.createDataFrame([("g", f"n{i}" if i % 3 else None, f"name{i}") for i in range(25)] + [("g", "n1", "name1")], "graph_id string, id string, name string")
    edges = spark.createDataFrame([("g", f"e{i}", f"n{i}", "R", f"n{i + 1}") for i in range(24)], "graph_id string, id string, source string, relation string, target string")

    def places(size):
        written = SN.write_snapshots(nodes, edges, size)
        rows = SN.snapshot_to_nodes(written).select("pos", "id", "name").union(SN.snapshot_to_edges(written).select("pos", "id", "src"))
        return sorted((tuple(r) for r in rows.collect()), key=str)

    assert places(4) == places(7) == places(None)
    assert sorted(r[0] for r in places(4)) == sorted([*range(26), *range(24)])


def test_snapshot_spellings_and_bad_json(spark):
    docs = [
        ("a", '{"nodes": [{"id": "1", "label": "X"}, {"name": "only"}], "relations": [{"subject": "1", "predicate": "P", "object": "only"}]}'),
        ("b", "not json"), ("c", '{"nodes": [], "edges": [{"sourceId": "1", "targetId": "2", "label": "L"}, {"source": ""}]}'),
    ]
    graphs = spark.createDataFrame(docs, "graph_id string, graph_data string")
    assert {(r["graph_id"], r["id"], r["name"]) for r in SN.snapshot_to_nodes(graphs).collect()} == {("a", "1", "X"), ("a", "only", "only")}
    assert {(r["graph_id"], r["src"], r["rel"], r["dst"]) for r in SN.snapshot_to_edges(graphs).collect()} == {("a", "1", "P", "only"), ("c", "1", "L", "2")}


def test_validation_reasons_and_stats(spark):
    entities = spark.createDataFrame(
        [("u", 0, "Ａ病", "疾病", None), ("u", 1, "A病", "症状", "x"), ("u", 2, "患者", None, None), ("u", 3, "头痛", "症状", " "), ("u", 4, "9", None, None)],
        "unit_id string, pos bigint, name string, type string, description string")
    relations = spark.createDataFrame(
        [("u", 0, "A病", "症状或体征", "头痛"), ("u", 1, "Ａ病", "HAS_SYMPTOM", "头痛"), ("u", 2, "无名", "x", "头痛"), ("u", 3, "头痛", "x", "无名"), ("u", 4, "头痛", "x", "头痛"),
         ("u", 5, "", "x", "头痛"), ("u", 6, "头痛", "HAS_COMPLICATION", "A病")],
        "unit_id string, pos bigint, subject string, predicate string, object string")
    classified = A.classify_entities(entities)
    good = A.valid_entities(classified)
    assert {(r["name"], r["type"], r["description"]) for r in good.collect()} == {("A病", "Disease", "A病"), ("头痛", "Symptom", "头痛")}
    classes = A.classify_relations(relations, good)
    assert [r["reason"] for r in classes.orderBy("pos").collect()] == [None, None, "subject_missing", "object_missing", "self_loop", "empty", None]
    triples = A.valid_relations(classes)
    assert {(r["subject"], r["predicate"], r["mismatch"]) for r in triples.collect()} == {("A病", "HAS_SYMPTOM", False), ("头痛", "HAS_COMPLICATION", True)}
    stats = A.validation_stats(classified, classes, triples).first().asDict()
    assert [stats[n] for n in A.STAT_NAMES] == [2, 1, 1, 1, 1, 1, 0, 1]


def test_positions_with_one_hot_key(spark):
    df = spark.range(500).select(F.lit("hot").alias("k"), F.col("id").alias("v"))
    rows = positions(df, ["k"], [F.col("v")], F.floor(F.col("v") / 7)).collect()
    assert all(r["position"] == r["v"] + 1 and r["group_size"] == 500 for r in rows)


def test_rrf(spark):
    rows = [("q", "graph", 1, "x", "gx"), ("q", "doc", 2, "x", "dx"), ("q", "doc", 1, "y", "dy"), ("q", "keyword", 1, "z", "kz")]
    items = spark.createDataFrame(rows, "query_id string, source string, rank int, content_key string, content string")
    out = R.rrf(items).orderBy("place").collect()
    assert [r["content_key"] for r in out] == ["x", "y", "z"] and out[0]["content"] == "gx"
    assert out[0]["rrf_score"] == pytest.approx(1 / 61 + 1 / 62)


def test_vector_top_k_blocks_and_zero_vector(spark):
    rng = random.Random(3)
    rows = [(i, [rng.random() - 0.5 for _ in range(5)]) for i in range(60)] + [(60, [0.0] * 5)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>")
    queries = spark.createDataFrame(rows[:9] + rows[-1:], "query_id long, embedding array<double>")
    whole = R.vector_top_k(vectors, queries, 7).orderBy("query_id", "rank").collect()
    blocks = R.vector_top_k(vectors, queries, 7, block=3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["id"]) for r in whole] == [(r["query_id"], r["rank"], r["id"]) for r in blocks]
    assert len(whole) == 70 and whole[0]["id"] == 0
    assert {r["distance"] for r in whole if r["query_id"] == 60} == {1.0}
    odd = spark.createDataFrame([(70, None), (71, [1.0]), (72, []), (73, [None] * 5), (74, [float("nan")] * 5)], "id long, embedding array<double>")
    more = R.vector_top_k(vectors.union(odd), queries.union(odd), 7, parts=3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["id"]) for r in more if r["query_id"] != 71] == [(r["query_id"], r["rank"], r["id"]) for r in whole]
    assert [r["id"] for r in more if r["query_id"] == 71] == [71]
    assert R.vector_top_k(vectors, queries.limit(0), 7).count() == 0


def test_keyword_search_limits_each_word(spark):
    nodes = spark.createDataFrame([(i, "common word", f"n{i}") for i in range(40)] + [(40, "rare", None)], "id long, name string, description string")
    words = spark.createDataFrame([(q, w) for q in range(6) for w in ("common", "rare")], "query_id long, keyword string")
    hits = R.keyword_search(words, nodes, 5).collect()
    assert sorted((r["query_id"], r["node_id"]) for r in hits) == [(q, i) for q in range(6) for i in range(5)]
    rare = R.keyword_search(words.filter("keyword = 'rare'"), nodes, 5).collect()
    assert {r["node_id"] for r in rare} == {40} and len(rare) == 6


def test_repair_json():
    ok = {"entities": [{"name": "a"}], "relations": []}
    text = '{"entities": [{"name": "a"}], "relations": []}'
    assert B.repair_json(text) == (ok, "ok")
    assert B.repair_json(f"```json\n{text}\n```") == (ok, "ok")
    assert B.repair_json(f"Here: {text} bye") == (ok, "repaired")
    assert B.repair_json('{"entities": [{"name": "a"}')[0] == {"entities": [{"name": "a"}]}
    assert B.repair_json('{"a": "x')[0] == {"a": "x"}
    assert B.repair_json('{"entities": [{"name": "a')[1] == "empty"
    assert B.repair_json("nothing")[1] == B.repair_json("")[1] == "empty"


def test_intent_names(spark):
    nodes = spark.createDataFrame([("d", "flu", "Disease"), ("s", "cough", "Symptom"), ("m", "tea", "Drug")], "id string, name string, type string")
    edges = spark.createDataFrame([("1", "d", "HAS_SYMPTOM", "s"), ("2", "m", "TREATS", "d")], EDGE)
    start = spark.createDataFrame([(1, "flu")], "query_id int, name string")
    assert G.intent_names(start, nodes, edges, "HAS_SYMPTOM", True, "Symptom").first()["answer"] == "cough"
    assert G.intent_names(start, nodes, edges, "TREATS", False, "Drug").first()["answer"] == "tea"


def test_intent_answers_without_names(spark):
    questions = spark.createDataFrame([(1, "symptom_query"), (2, "department_query"), (3, "symptom_query")], "query_id int, intent string")
    rows = [(1, 1, "flu", "HAS_SYMPTOM", "", "d"), (2, 1, "flu", "BELONGS_TO_DEPARTMENT", None, ""), (3, 1, "flu", "OTHER", "x", "d")]
    knowledge = spark.createDataFrame(rows, "query_id int, pos int, entity string, relation string, related_entity string, description string")
    got = {r["query_id"]: r["answer"] for r in G.intent_answers(questions, knowledge).collect()}
    assert got[1] == "根据医疗知识库，主要症状包括：。建议及时就医。"
    assert got[2].startswith("关于flu 详细") and got[3].startswith("关于flu：d")
