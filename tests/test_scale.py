"""Operators under one hot value, and their blocked forms against plain ones."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from loomwright.operators import assembly as A
from loomwright.operators import chunking as C
from loomwright.operators import dashboards as D
from loomwright.operators import eeg as E
from loomwright.operators import grams as GR
from loomwright.operators import graph as G
from loomwright.operators import traversal as TR
from loomwright.operators.ranking import range_positions
from loomwright.plans import all_queries
from loomwright.session import tasks_for

EDGE = "id string, src string, rel string, dst string"


def edges_of(spark, pairs, rel="R"):
    return spark.createDataFrame([(f"{a}_{rel}_{b}", a, rel, b) for a, b in pairs], EDGE)


def rows_per_partition(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


@pytest.fixture(scope="module")
def star(spark):
    return G.both_ways(edges_of(spark, [("hub", f"n{i}") for i in range(8000)])).select("from", "rel", "to")


def test_hub_is_dealt_over_buckets(spark, star):
    steps = TR.resident(star, hub=50, buckets=8)
    assert [r["from"] for r in steps.hubs.collect()] == ["hub"]
    sizes = rows_per_partition(steps.steps)
    assert len(sizes) == 8 and max(sizes) <= 2 * statistics.median(sizes)
    near = steps.around(spark.createDataFrame([("hub",), ("n5",), ("none",)], "`from` string"))
    assert sorted((r["from"], r["to"]) for r in near.collect()) == sorted([("hub", f"n{i}") for i in range(8000)] + [("n5", "hub")])


@pytest.mark.parametrize("hub", [50, 10**6])
def test_rounds_do_not_move_the_adjacency(spark, star, hub):
    steps = TR.resident(star, hub=hub, buckets=8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = steps.around(spark.range(1000).select(F.concat(F.lit("n"), "id").alias("from")))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    joins = plan[plan.index("SortMergeJoin"):].splitlines()  # the outermost join
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    right = next(i for i, line in enumerate(joins[1:], 1) if i > 1 and depth(line) == depth(joins[1]))
    assert not any("Exchange" in line or line.strip(" :+-").startswith("Sort ") for line in joins[right:]), plan


def test_best_paths_stop_at_the_limit(spark):
    rng = random.Random(2)
    pairs = [("a", f"b{i}") for i in range(30)] + [(f"b{rng.randrange(30)}", f"c{i}") for i in range(60)] + [("z", "y"), ("y", "x"), ("x", "w")]
    edges = edges_of(spark, sorted(set(pairs)))
    ids = sorted({n for p in pairs for n in p})
    names = {n: f"name{rng.randrange(12)}" for n in ids}
    nodes = spark.createDataFrame([(n, names[n]) for n in ids], "id string, name string")
    seeds = spark.createDataFrame([(1, "a"), (2, "z"), (2, "c3"), (3, "w")], "q long, id string").join(nodes, "id")
    every = {}
    for r in TR.expand_paths(seeds, edges, 3, ["q"]).collect():
        every.setdefault(r["q"], []).append((r["hop"], names[r["end"]], r["nodes"], r["edge_ids"]))
    for limit in (4, 33, 500):
        got = TR.path_hits(seeds, nodes, edges, 3, limit, ["q"]).collect()
        assert sorted((r["q"], r["hop"], r["name"], r["nodes"], r["edge_ids"]) for r in got) == sorted((q, *p) for q, paths in every.items() for p in sorted(paths)[:limit])
        assert all(r["names"] == [names[n] for n in r["nodes"]] for r in got)
    assert TR.path_hits(seeds.limit(0), nodes, edges, 2, 5, ["q"]).count() == 0


def test_a_hub_gives_its_first_edges_to_paths(spark):
    nodes = spark.createDataFrame([(f"n{i}", f"name{i % 7}") for i in range(3000)] + [("hub", "hub"), ("n1", "again")], "id string, name string")
    edges = edges_of(spark, [("hub", f"n{i}") for i in range(3000)]).union(edges_of(spark, [("hub", "hub")]))
    steps = G.both_ways(edges).drop("outgoing").join(nodes.select(F.col("id").alias("to"), "name"), "to")
    first = [(r["name"], r["to"]) for r in TR._first_steps(steps.filter("`from` = 'hub'"), 5).collect()]
    assert sorted(first) == sorted([("again", "n1"), ("name1", "n1"), ("hub", "hub"), ("hub", "hub"), *[("name0", f"n{i}") for i in (0, 1001, 1008)]])
    seeds = spark.createDataFrame([(q, f"n{q}", f"name{q % 7}") for q in range(40)], "q long, id string, name string")
    got = TR.path_hits(seeds, nodes, edges, 2, 4, ["q"])
    assert got.groupBy("q").count().filter("count <> 4").count() == 0
    assert {(r["end"], r["hop"]) for r in got.filter("q = 3").collect()} == {("hub", 1), ("n1", 2), ("hub", 2)}


def test_best_rows_of_a_block():
    import numpy as np

    from loomwright.operators.retrieval import _best_rows

    distances = np.array([[0.5, 0.1, 0.5, 0.1], [0.2, 0.2, 0.2, 0.2], [0.9, 0.8, 0.7, 0.6]])  # a row per query
    got = _best_rows(["a", "b", "c"], distances, np.array([4, 3, 2, 1]), 3)
    assert list(got.itertuples(index=False, name=None)) == [
        ("a", 1, 0.1), ("a", 3, 0.1), ("a", 2, 0.5), ("b", 1, 0.2), ("b", 2, 0.2), ("b", 3, 0.2), ("c", 1, 0.6), ("c", 2, 0.7), ("c", 3, 0.8)]


def test_questions_of_one_vector_and_of_none(spark):
    from loomwright.operators import retrieval as R

    vectors = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(30)], "id long, embedding array<double>")
    queries = spark.createDataFrame([(q, [1.0, 0.5]) for q in range(50)] + [(99, [0.0, 1.0]), (99, [1.0, 0.0]), (7, None)], "query_id long, embedding array<double>")
    got = R.vector_top_k(vectors, queries, 2)
    assert {(r["query_id"], r["id"]) for r in got.filter("query_id < 50").collect()} >= {(q, 5) for q in range(50)}
    assert sorted((r["id"], r["rank"]) for r in got.filter("query_id = 99").collect()) == [(0, 1), (1, 2)]
    assert got.count() == 102


def test_paths_have_their_relations_both_ways(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("a", "q"), ("q", "c")]
    edges = edges_of(spark, pairs, "R").union(edges_of(spark, [("b", "a")], "A"))
    asked = spark.createDataFrame([("a", "f"), ("f", "a"), ("a", "c"), ("b", "a"), ("a", "lost"), ("a", "a")], "start string, goal string")
    got = {(r["start"], r["goal"]): (r["path_nodes"], r["relation_types"]) for r in TR.shortest_paths(asked, edges, 5).collect()}
    assert got == {
        ("a", "f"): (list("abcdef"), ["A", "R", "R", "R", "R"]), ("f", "a"): (list("fedcba"), ["R", "R", "R", "R", "A"]), ("a", "c"): (list("abc"), ["A", "R"]), ("b", "a"): (list("ba"), ["A"])}
    assert TR.shortest_paths(asked.limit(0), edges, 3).count() == 0


def test_pairs_of_a_question_only(spark):
    nodes = spark.createDataFrame([(n, n.upper()) for n in "abcd"], "id string, name string")
    edges = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    names = spark.createDataFrame([(1, "A"), (1, "C"), (2, "B"), (3, "C"), (3, "D"), (3, "D")], "q long, name string")
    got = TR.paths_between_names(names, nodes, edges, 3, 1, ["q"]).collect()
    assert sorted((r["q"], r["start_name"], r["goal_name"], r["path_length"]) for r in got) == [(1, "A", "C", 2), (3, "C", "D", 1)]


# ---- names in texts

def texts_and_names():
    rng = random.Random(3)
    letters = "abcde é\U0001f600症\n状"
    long = ["".join(rng.choices(letters, k=rng.randrange(1, 120))) for _ in range(60)]
    texts = [("".join(rng.choices(letters, k=rng.randrange(0, 400)))) for _ in range(80)]
    texts += [t + rng.choice(long) + t[::-1] + rng.choice(long) for t in texts[:40]] + ["", None, "a", "ab" * 50000, "é"]
    names = long + ["".join(rng.choices(letters, k=k)) for k in range(1, 12) for _ in range(15)] + ["", None, "absent from all", "a" * 200, "ab" * 60, "bab"]
    return list(enumerate(texts)), sorted({n for n in names if n is not None}) + [None, names[0], names[0]]


def test_occurrences_equal_plain_search(spark):
    texts, names = texts_and_names()
    expected = sorted({(i, n) for i, t in texts for n in names if t and n and n in t})
    got = GR.occurrences(spark.createDataFrame(texts, "id long, t string").repartition(3), spark.createDataFrame([(n,) for n in names], "word string"), "id", "t", "word")
    assert got.columns == ["id", "word"]
    assert sorted({(r["id"], r["word"]) for r in got.collect()}) == expected and len(expected) > 500


def test_occurrences_of_nothing(spark):
    texts = spark.createDataFrame([(1, "abc"), (2, None)], "id long, t string")
    for names in ([], [""], [None], ["zzz"], ["z" * 30]):
        assert GR.occurrences(texts, spark.createDataFrame([(n,) for n in names], "name string"), "id", "t").count() == 0
    assert GR.occurrences(texts.limit(0), spark.createDataFrame([("abc",)], "name string"), "id", "t").count() == 0


def test_rarest_gram_keeps_common_beginnings_apart(spark):
    """All names begin alike; only the places of the rare parts may leave a task."""
    texts = spark.createDataFrame([(i, f"the customer number {i} of the customers " * 3) for i in range(300)], "id long, t string")
    names = spark.createDataFrame([(f"customer number {i} ",) for i in range(1000)], "name string")
    assert sorted((r["id"], r["name"]) for r in GR.occurrences(texts, names, "id", "t").distinct().collect()) == [(i, f"customer number {i} ") for i in range(300)]


# ---- units, numbering, signals, merges

def test_large_units_are_looked_up_by_name(spark, monkeypatch):
    rng = random.Random(5)
    entities = spark.createDataFrame([(f"u{i % 4}", i, f"name {rng.randrange(9)}", "疾病", None) for i in range(120)] + [("u9", 0, "alone", "疾病", "x")], "unit_id string, pos long, name string, type string, description string")
    relations = spark.createDataFrame([(rng.choice(["u0", "u1", "u2", "u3", "u9", "none"]), i, f"name {rng.randrange(11)}", "并发症", f"name {rng.randrange(11)}") for i in range(200)], "unit_id string, pos long, subject string, predicate string, object string")
    results = []
    for limit in (10**6, 35, 1):
        monkeypatch.setattr(A, "UNIT_ROWS", limit)
        for written in (False, True):
            classified, _, found, triples = A.validate(entities, relations, written)
            results.append([sorted(map(tuple, df.collect()), key=str) for df in (classified, found, triples.select("unit_id", "subject", "predicate", "object", "pos", "n", "mismatch"))])
    assert all(r == results[0] for r in results) and results[0][2]


def test_numbering_of_one_hot_key(spark):
    rows = [("k0", i % 7, i) for i in range(4000)] + [(None, i, i) for i in range(5)] + [(f"k{i % 3 + 1}", i, i) for i in range(300)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v long, i long").repartition(4)
    groups = {}
    for k, v, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        groups.setdefault(k, []).append(i)
    got = {(r["k"], r["i"]): (r["position"], r["group_size"]) for r in range_positions(df, ["k"], [F.col("v"), F.col("i")]).collect()}
    assert got == {(k, i): (n, len(members)) for k, members in groups.items() for n, i in enumerate(members, 1)}
    whole = {r["i"]: r["position"] for r in range_positions(df.filter("k = 'k0'"), [], [F.col("v"), F.col("i")]).collect()}
    assert whole == {i: n for n, i in enumerate(groups["k0"], 1)}
    sizes = rows_per_partition(df.repartitionByRange(8, "k", "v", "i"))  # the ranges in which the rows are numbered
    assert max(sizes) <= 2 * statistics.median(sizes)
    assert range_positions(df.limit(0), ["k"], [F.col("i")]).count() == range_positions(df.limit(0), [], [F.col("i")]).count() == 0


def test_sheet_of_one_day(spark):
    sessions = spark.range(500).select(
        F.col("id").cast("string").alias("id"), F.lit("s1").alias("subject_id"), F.lit("completed").alias("status"), F.lit("2024-01-01 10:00:00").cast("timestamp").alias("start_time"),
        F.lit("{}").alias("session_note"), F.lit("low").alias("cognitive_level"), F.lit(5).alias("duration_seconds"))
    subjects = spark.createDataFrame([("s1", "c1", "n", 3, "male", "mci")], "id string, subject_code string, name string, age int, gender string, cognitive_status string")
    assert sorted(r["number"] for r in D.experiment_sheet(sessions, subjects).select("number").collect()) == list(range(1, 501))


@pytest.mark.parametrize("block", [1, 3, 4])
def test_blocked_resampling(spark, monkeypatch, block):
    rng = random.Random(block)
    rows = [(rec, ch, i, rng.uniform(-5, 5)) for rec in "ab" for ch in ("x", "y") for i in range(40) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "recording_id string, channel string, sample_idx long, uv double")
    whole = sorted(map(tuple, E.resample(df, 500.0).collect()))
    monkeypatch.setattr(E, "BLOCK", block)
    assert sorted(map(tuple, E.resample(df, 500.0).collect())) == whole and whole
    clean = E.remove_artifacts(df, 4.0).collect()
    bad = {(r[0], r[2]) for r in rows if abs(r[3]) >= 4.0}
    assert sorted(map(tuple, clean)) == sorted(r for r in rows if (r[0], r[2]) not in bad)


@pytest.mark.parametrize("limit", [0, 1, 4, 5, 9, 100])
def test_merge_stops_inside_a_graph(spark, limit):
    rng = random.Random(9)
    nodes = [(f"g{g}", f"n{rng.randrange(12)}", p) for g in range(5) for p in range(4) if g != 2]
    edges = [(f"g{g}", f"e{rng.randrange(9)}", p) for g in range(5) for p in range(3)]
    seen, kept, links, open_ = set(), [], set(), limit > 0
    for g in sorted({n[0] for n in nodes} | {e[0] for e in edges}):
        if not open_:
            break
        for _, name, _ in [n for n in nodes if n[0] == g]:
            if name not in seen and len(kept) < limit:
                seen.add(name)
                kept.append(name)
        links |= {e for graph, e, _ in edges if graph == g}
        open_ = len(kept) < limit
    n, e = G.merge_graphs(spark.createDataFrame(nodes, "graph_id string, id string, pos long"), spark.createDataFrame(edges, "graph_id string, id string, pos long"), limit)
    assert sorted(r["id"] for r in n.collect()) == sorted(kept)
    assert sorted(r["id"] for r in e.collect()) == sorted(links)


def test_placeholder_only_without_nodes(spark):
    none = spark.createDataFrame([], "id string, name string, category string")
    graphs = spark.createDataFrame([("g2", "two"), ("g1", "")], "graph_id string, graph_name string")
    assert [tuple(r) for r in G.or_placeholder(none, graphs).collect()] == [("_placeholder_g1", "默认图谱" + G.EMPTY_GRAPH, "entity")]
    assert G.or_placeholder(none, graphs.limit(0)).count() == 0
    one = spark.createDataFrame([("a", "b", "c")], none.schema)
    assert [tuple(r) for r in G.or_placeholder(one, graphs).collect()] == [("a", "b", "c")]


# ---- expressions on names run once

def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_names_of_a_sample_are_read_once(spark):
    from loomwright.operators import evaluation as EV

    entity = "array<struct<id string, text string, type string>>"
    relation = "array<struct<subject string, type string, object string>>"
    row = (1, [("a", " Ａ  b ", "x"), ("b", "c", "y"), ("d", "d", ""), ("e", None, "z")], [("a", "r", "b"), ("a", "r", "d"), ("b", "r", "e"), ("b", "", "a"), ("b", None, "a"), ("b", "s", "a"), ("b", "s", "a"), (None, "s", "a")])
    got = EV.gold_relations(spark.createDataFrame([row, (2, None, None)], f"id long, entities {entity}, relations {relation}"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "A b", "R", "c"), (1, "c", "S", "A b")]
    assert optimized(got).count("map_from_entries") == 1


def test_incoming_names_are_read_once(spark):
    from loomwright.functions import text as T

    raw = spark.createDataFrame([(" Ａ ", "属于", "b"), ("b", "BELONGS_TO", "b "), ("b", "", "A"), ("A", "BELONGS_TO", "b"), ("A", "odd", "lost")], "s string, predicate string, o string")
    incoming = raw.select(T.normalize_name(F.col("s")).alias("subject"), "predicate", T.normalize_name(F.col("o")).alias("object"))
    old = spark.createDataFrame([], "subject string, predicate string, object string, created_at timestamp")
    got = A.upsert_edges(old, incoming, spark.createDataFrame([("A",), ("b",)], "name string"), "2024-02-01")
    assert sorted((r["subject"], r["predicate"], r["object"]) for r in got.collect()) == [("A", "BELONGS_TO", "b")]
    assert not any("regexp_replace" in line for line in optimized(got).splitlines() if line.strip(" :+-").startswith("Filter"))


def test_plain_names_and_others_agree(spark):
    from loomwright.functions import text as T

    raw = ["a b", " a b", "a b ", "a  b", "a\n", "a\nb", "ａ b", "症 状", "é é", "é  é", "a　b", "", None, " ", "~!", "a\tb"]
    got = spark.createDataFrame([(x,) for x in raw], "t string").select(T.normalize_name(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in got] == ["a b", "a b", "a b", "a b", "a", "a b", "a b", "症 状", "é é", "é é", "a b", "", "", "", "~!", "a b"]


def test_texts_are_cut_in_blocks(spark):
    import pyarrow as pa

    assert list(C._blocks(pa.array(["a" * 10, None, "b" * 5, "c" * 20, ""]), 12)) == [(0, 3), (3, 4), (4, 5)]
    assert list(C._blocks(pa.array([], pa.string()), 12)) == []
    texts = [("one. two! three? " * n) or None for n in range(0, 40, 3)] + [" . "]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").coalesce(1)
    got = sorted((r["k"], r["chunk_index"], r["chunk"]) for r in C.chunk(rows, "extraction", size=30).collect())
    assert got == [(k, i, x) for k, t in enumerate(texts) for i, x in enumerate(C.extraction_paragraphs(t or "", 30))]


def test_tasks_grow_with_the_rows(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tasks_for(spark.range(25), spark.range(26), rows=2) == 26
    assert tasks_for(spark.range(25)) == least


def test_found_relations_are_dealt_over_given_tasks(spark):
    edges = edges_of(spark, [("a", f"b{i}") for i in range(60)]).unionByName(edges_of(spark, [("a", "b7")]))
    edges = edges.withColumn("graph_id", F.lit("g")).withColumn("properties", F.create_map(F.lit("via"), F.lit("x")))
    got = G.search_relations(edges, "r", "R", tasks=13)
    assert got.rdd.getNumPartitions() == 13
    assert sorted(r["dst"] for r in got.collect()) == sorted(f"b{i}" for i in range(60))


def test_score_sets_are_counted_where_their_samples_lie(spark):
    plan = all_queries()["ev3_core_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "sample_id" in line]
    assert dealt and all("REPARTITION_BY_NUM" in line and "hashpartitioning(sample_id" in line for line in dealt), plan


def test_edges_are_formed_once(spark):
    formed = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            formed.add(batch.num_rows)
            yield batch

    edges = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")]).mapInArrow(count, EDGE)
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    n, e = TR.subgraph(nodes.filter("id = 'a'"), nodes, edges, 2)
    assert sorted(r["id"] for r in n.collect()) == ["a", "b", "c"]
    assert sorted(r["id"] for r in e.collect()) == ["a_R_b", "b_R_c"]
    assert formed.value == 4
