"""Traversals: k-hop neighbours, path expansion, shortest paths, subgraphs.

All of them are frontier joins on a resident adjacency: the edges seen from both ends, written once in sorted buckets by node,
with the neighbours of a hub dealt over salted sub-buckets. A round shuffles the frontier only, keeps one row per reached node by a partial aggregate, and cuts the lineage with a checkpoint, so a lost
executor repeats one round at most. No side is broadcast by hint.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.operators.graph import both_ways
from loomwright.operators.ranking import first_n
from loomwright.session import cut_lineage, dealt, kept, tasks_for

c = F.col
MAX_HOPS = 3
MAX_PATH_EDGES = 5
#: Neighbours in one sub-bucket of a hub.
HUB = 10_000


def _within(asked: int, most: int) -> int:
    """``asked``, if the operator goes that far; it never shortens an answer silently."""
    if asked > most:
        raise ValueError(f"at most {most} steps, not {asked}")
    return asked


@dataclass
class Adjacency:
    """Neighbours in buckets by node; where there are ``hubs(from, salts)``, nodes with several sub-buckets, by (from, salt)."""

    steps: DataFrame
    hubs: DataFrame | None

    def around(self, frontier: DataFrame) -> DataFrame:
        """``frontier(from, ...)`` with one row per neighbour; a hub's rows ask each of its sub-buckets."""
        if self.hubs is None:
            return frontier.join(self.steps, "from")
        last = F.coalesce(c("salts"), F.lit(1)) - 1
        asked = frontier.join(self.hubs, "from", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), last))).drop("salts")
        return asked.join(self.steps, ["from", "salt"]).drop("salt")


def resident(steps: DataFrame, hub: int = HUB, buckets: int | None = None) -> Adjacency:
    """Write ``steps(from, ...)`` to the shared folder for the rounds of one traversal, in sorted buckets by node (``dealt``).

    There are as many buckets as shuffle partitions, or more where a bucket would get more than a million rows; the frontier is
    dealt out to fit them, and a round neither moves nor sorts them. The rows of a node with more than ``hub`` neighbours get salts by the hash of the row, ``hub`` rows each
    on average. ``steps`` is read three times, see ``adjacency``.
    """
    rows, buckets = steps, buckets or tasks_for(steps)
    hubs = cut_lineage(rows.groupBy("from").agg(F.ceil(F.count("*") / hub).cast("int").alias("salts")).filter("salts > 1"))
    by, any_hub = ["from"], not hubs.isEmpty()
    if any_hub:  # one hub per ``hub`` rows at most: sent to every task, so that rows are not written once more
        salt = F.coalesce(F.pmod(F.xxhash64(*rows.columns), c("salts")), F.lit(0)).cast("int")
        by, rows = ["from", "salt"], rows.join(F.broadcast(hubs), "from", "left").withColumn("salt", salt).drop("salts")
    return Adjacency(dealt(rows, by, buckets).hint("merge"), hubs if any_hub else None)  # a broadcast would gather the buckets


def adjacency(edges: DataFrame, *columns: str) -> Adjacency:
    """The ``columns`` of ``both_ways(edges)``, resident. The edges are formed and written once, one row each."""
    ids = [c("id")] if "edge_id" in columns else []
    ends = kept(edges.select(*ids, "src", "rel", "dst"))
    return resident(both_ways(ends if ids else ends.withColumn("id", F.lit(None))).select(*columns))


def _grow(frontier: DataFrame, steps: Adjacency, keys: list[str], earlier: list[DataFrame]) -> DataFrame:
    """The nodes next to ``frontier(*keys, id)`` that none of the ``earlier`` levels holds, with their least parent.

    Steps go both ways, so a neighbour of a node at distance d is at d - 1 at least: two earlier levels are enough. The step
    back to the parent leads to one of them and is left out before neighbours are sorted, by id, which tells them apart soonest.
    """
    near = steps.around(frontier.select(*keys, c("id").alias("from"), c("parent").alias("_back")))
    ahead = near.filter(F.coalesce(c("to") != c("_back"), F.lit(True)))
    reached = ahead.groupBy(c("to").alias("id"), *keys).agg(F.min(F.struct(c("from").alias("parent"), "rel")).alias("_f"))
    seen = reduce(DataFrame.union, [x.select(*keys, "id") for x in earlier])
    return reached.join(seen, [*keys, "id"], "left_anti").select(*keys, "id", "_f.parent", "_f.rel")


def k_hop(seeds: DataFrame, edges: DataFrame, depth: int = MAX_HOPS, keys: list[str] | None = None) -> DataFrame:
    """Every node within ``depth`` (at most 3) undirected steps of the seeds, once, at its smallest distance.

    ``seeds(*keys, id)`` gives one traversal per key. The result has ``id, hop, parent, rel``; among several parents
    the smallest id is kept, with the smallest relation.
    """
    keys = keys or []
    none = F.lit(None).cast("string")
    levels = [cut_lineage(seeds.select(*keys, "id").distinct().withColumns({"hop": F.lit(0), "parent": none, "rel": none}))]
    if _within(depth, MAX_HOPS) < 1:
        return levels[0]
    steps = adjacency(edges, "from", "rel", "to")
    for hop in range(1, depth + 1):
        fresh = _grow(levels[-1], steps, keys, levels[-2:])
        levels.append(cut_lineage(fresh.select(*keys, "id", F.lit(hop).alias("hop"), "parent", "rel")))
    return reduce(DataFrame.unionByName, levels)


def neighbour_hits(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """Traversal rows as hits: score 1 for the seeds, 1 / (1 + 0.3 hop) for neighbours, with the parent's name.

    A parent is a reached node itself, so the nodes are joined once and the parents' names come from that result; few of the
    reached nodes are parents.
    """
    me = nodes.select("id", "name", c("type").alias("label"), "description")
    rows = kept(reached.join(me, "id"))
    wanted = rows.select("parent").filter("parent is not null").distinct()
    names = rows.select(c("id").alias("parent"), c("name").alias("parent_name"))
    parents = names.join(wanted, "parent", "left_semi").dropDuplicates(["parent"])
    hop = c("hop")
    return rows.join(parents, "parent", "left").withColumns({
        "kind": F.when(hop == 0, "entity").otherwise("neighbor"),
        "relevance_score": 1.0 / (1.0 + 0.3 * hop),
        "relation_types": F.array_compact(F.array(F.nullif(c("rel"), F.lit("")))),
        "path_names": F.when(hop > 0, F.array("parent_name", "name")),
    })


def _start_paths(seeds: DataFrame, keys: list[str], extra: list[Column]) -> DataFrame:
    texts = F.array().cast("array<string>")
    return seeds.select(*keys, c("id").alias("start"), c("id").alias("end"), F.array("id").alias("nodes"), texts.alias("rels"), texts.alias("edge_ids"), *extra)


def _longer(paths: DataFrame, steps: Adjacency, keys: list[str], extra: list[Column | str]) -> DataFrame:
    """Every path with one more edge that it does not use yet; ``extra`` columns come along."""
    grown = steps.around(paths.withColumn("from", c("end"))).filter(~F.array_contains("edge_ids", c("edge_id")))
    return grown.select(
        *keys, "start", c("to").alias("end"), F.concat("nodes", F.array("to")).alias("nodes"), F.concat("rels", F.array("rel")).alias("rels"),
        F.concat("edge_ids", F.array("edge_id")).alias("edge_ids"), *extra)


def expand_paths(seeds: DataFrame, edges: DataFrame, depth: int = 2, keys: list[str] | None = None) -> DataFrame:
    """One row per undirected path of 1 to ``depth`` edges from the seeds; a path uses no edge twice."""
    keys = keys or []
    paths, levels = _start_paths(seeds, keys, []), []
    steps = adjacency(edges, "edge_id", "from", "rel", "to")
    for _ in range(_within(depth, MAX_HOPS)):
        paths = cut_lineage(_longer(paths, steps, keys, []))
        levels.append(paths)
    return reduce(DataFrame.union, levels).withColumn("hop", F.size("rels"))


def _first_steps(steps: DataFrame, n: int) -> DataFrame:
    """``steps(from, edge_id, rel, to, name)`` of the first ``n`` edges of each node by (name, to, edge).

    Edges are ranked by their first end, as an id may stand for several rows; all rows of a kept edge are kept.
    """
    ends = F.collect_list(F.struct("name", "to", "rel")).alias("_ends")
    by_edge = steps.filter("edge_id is not null").groupBy("from", "edge_id").agg(ends).withColumn("_least", F.array_min("_ends"))
    return first_n(by_edge, ["from"], [c("_least.name"), c("_least.to"), c("edge_id")], n).select("from", "edge_id", F.inline("_ends"))


def path_hits(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 2, limit: int = 50, keys: list[str] | None = None, steps: Adjacency | None = None) -> DataFrame:
    """The first ``limit`` paths per key by (hop, name of the end, nodes, edges), scored 1 / (1 + 0.3 hop), best first.

    ``seeds(*keys, id, name)``; the result has the names along the path as ``names``. A level is cut to what its key can still take as it is formed, and a key that is full grows no further: a path of the
    next level cannot come before one of this. So a level has at most ``limit`` rows per key, of which fewer than ``limit``
    grow. ``name`` is the end's name. Edges to nodes that ``nodes`` lacks are no steps.

    Of all the ways on from one path only the first ``limit`` by (name, to, edge) can count, and a path excludes fewer edges
    than ``depth``: so the paths of a level meet the first ``limit + depth - 1`` edges of the nodes they end at, and a hub is
    no larger than any other node. ``steps(from, edge_id, rel, to)`` may be given where they are resident already.
    """
    keys = keys or []
    names = nodes.select(c("id").alias("to"), "name")
    begin = seeds.select(*keys, "id", "name").distinct()
    paths, levels = _start_paths(begin, keys, [F.array("name").alias("names"), F.lit(0).cast("long").alias("have")]), []
    steps = steps or adjacency(edges, "edge_id", "from", "rel", "to")
    for _ in range(_within(depth, MAX_HOPS)):
        near = steps.around(paths.select(c("end").alias("from")).distinct()).join(names, "to")
        grown = _longer(paths, Adjacency(_first_steps(near, limit + depth - 1), None), keys, ["name", F.concat("names", F.array("name")).alias("names"), "have"])
        best = first_n(grown, keys, [c("name"), c("nodes"), c("edge_ids")], limit).filter(c("rank") + c("have") <= limit)
        full = c("have") + F.count("*").over(Window.partitionBy(*keys))
        level = kept(best.withColumn("have", full).drop("rank"))
        levels.append(level.drop("have"))
        paths = level.filter(c("have") < limit).drop("name")
        if paths.isEmpty():
            break
    found = reduce(DataFrame.union, levels).withColumn("hop", F.size("rels"))
    return found.withColumn("relevance_score", 1.0 / (1.0 + 0.3 * c("hop")))


def _met(pairs: DataFrame, ahead: DataFrame, back: DataFrame) -> DataFrame:
    """``start, goal, path_length, id``: per open pair the least node at the shortest distance that both sides hold.

    ``back(source, id, path_length)`` is the goals' side. Nodes that one source alone has reached, as most are, go first,
    before the pairs of a source meet its level.
    """
    both = ahead.select("source", "id").union(back.select("source", "id"))
    shared = both.groupBy("id").agg(F.min("source").alias("_a"), F.max("source").alias("_b")).filter("_a <> _b").select("id")
    from_start = ahead.select(c("source").alias("start"), "id").join(shared, "id", "left_semi")
    from_goal = back.select(c("source").alias("goal"), "id", "path_length").join(shared, "id", "left_semi")
    met = pairs.join(from_start, "start").join(from_goal, ["goal", "id"])
    return met.groupBy("start", "goal").agg(F.min(F.struct("path_length", "id")).alias("_f")).select("start", "goal", "_f.path_length", "_f.id")


def _walk(found: DataFrame, levels: dict[int, DataFrame], end: str, depth: int) -> DataFrame:
    """From the meeting node back to ``end`` by one parent a level: adds ``nodes_<end>`` (the meeting node last) and ``rels_<end>``."""
    nodes, rels = f"nodes_{end}", f"rels_{end}"
    rows = found.withColumns({"_at": c("id"), nodes: F.array("id"), rels: F.array().cast("array<string>")})
    for k in range(depth, 0, -1):  # a node is in one level of its source, so only that level extends it
        back = levels[k].select(c("source").alias(end), c("id").alias("_at"), c("parent").alias("_parent"), "rel")
        rows = rows.join(back, [end, "_at"], "left").withColumns({
            nodes: F.when(c("_parent").isNotNull(), F.concat(F.array("_parent"), nodes)).otherwise(c(nodes)),
            rels: F.when(c("_parent").isNotNull(), F.concat(F.array("rel"), rels)).otherwise(c(rels)),
            "_at": F.coalesce("_parent", "_at"),
        }).drop("_parent", "rel")
    return rows.drop("_at")


def shortest_paths(pairs: DataFrame, edges: DataFrame, max_edges: int = MAX_PATH_EDGES, steps: Adjacency | None = None) -> DataFrame:
    """A shortest undirected path for each pair (start, goal) joined by at most ``max_edges`` (5) edges.

    Both ends of a pair grow, one row (source, node, parent) per reached node, and a source of several pairs grows once.
    After each round the open pairs look for a common node; those that have one are closed, and a source without an open
    pair stops growing. Paths are read off afterwards by walking the parents of the meeting node. The smallest meeting node
    is taken, on either side the smallest parents with the smallest relation; a pair asked the other way round has the same
    path reversed.
    """
    limit = _within(max_edges, MAX_PATH_EDGES)
    given = cut_lineage(pairs.select("start", "goal").distinct().filter("start <> goal"))
    still = given.select(F.least("start", "goal").alias("start"), F.greatest("start", "goal").alias("goal")).distinct()
    none = F.lit(None).cast("string")
    ends = still.select(F.explode(F.array("start", "goal")).alias("source")).distinct()
    levels = {0: ends.select("source", c("source").alias("id"), none.alias("parent"), none.alias("rel"))}
    solved: list[DataFrame] = []
    steps = steps or adjacency(edges, "from", "rel", "to")
    for k in range(1, (limit + 1) // 2 + 1):
        growing = ["start", "goal"] if 2 * k <= limit else ["start"]
        need = still.select(F.explode(F.array(*growing)).alias("source")).distinct()
        frontier = levels[k - 1].join(need, "source", "left_semi")
        levels[k] = cut_lineage(_grow(frontier, steps, ["source"], [levels[i] for i in (k - 1, k - 2) if i in levels]))
        sides = [levels[i].select("source", "id", F.lit(k + i).alias("path_length")) for i in (k - 1, k) if k + i <= limit]
        solved.append(cut_lineage(_met(still, levels[k], reduce(DataFrame.union, sides))))
        still = cut_lineage(still.join(solved[-1], ["start", "goal"], "left_anti"))
        if still.isEmpty():
            break
    found = reduce(DataFrame.union, solved)
    walked = _walk(_walk(found, levels, "start", min((limit + 1) // 2, max(levels))), levels, "goal", min(limit // 2, max(levels)))
    tail = F.slice(F.reverse("nodes_goal"), F.lit(2), F.greatest(F.size("nodes_goal") - 1, F.lit(0)))
    paths = walked.select(
        c("start").alias("_a"), c("goal").alias("_b"), "path_length", F.concat("nodes_start", tail).alias("_nodes"), F.concat("rels_start", F.reverse("rels_goal")).alias("_rels"))
    ahead = c("start") < c("goal")
    return given.withColumns({"_a": F.least("start", "goal"), "_b": F.greatest("start", "goal")}).join(paths, ["_a", "_b"]).select(
        "start", "goal", "path_length", F.when(ahead, c("_nodes")).otherwise(F.reverse("_nodes")).alias("path_nodes"),
        F.when(ahead, c("_rels")).otherwise(F.reverse("_rels")).alias("relation_types"), (1.0 / (1.0 + 0.2 * c("path_length"))).alias("relevance_score"))


def point_pairs(points: DataFrame, keys: list[str], differ: str = "id") -> DataFrame:
    """Ordered pairs of the points of one key that differ in a column: ``*keys, start, goal`` and the columns' values.

    An equi join on the keys; it lists what is asked, the points of a question squared, and nothing beyond a question.
    """
    a = points.select(*keys, c("id").alias("start"), c(differ).alias(f"start_{differ}"))
    b = points.select(*keys, c("id").alias("goal"), c(differ).alias(f"goal_{differ}"))
    return a.join(b, keys).filter(c(f"start_{differ}") != c(f"goal_{differ}"))


def shortest_paths_among(points: DataFrame, edges: DataFrame, max_edges: int = MAX_PATH_EDGES) -> DataFrame:
    """As ``shortest_paths`` for all ordered pairs of one question's ``points(id)``."""
    asked = points.select(F.lit(0).alias("_question"), "id").distinct()
    return shortest_paths(point_pairs(asked, ["_question"]), edges, max_edges)


def paths_between_names(names: DataFrame, nodes: DataFrame, edges: DataFrame, max_depth: int = 3, limit: int = 10, keys: list[str] | None = None, steps: Adjacency | None = None) -> DataFrame:
    """Shortest paths for ordered pairs of differently named entities of a key, the first ``limit`` by length and names.

    Paths are looked for and cut to ``limit`` per pair of names, which all keys with these names share.
    """
    by = keys or ["_question"]
    asked = (names if keys else names.withColumn("_question", F.lit(0))).select(*by, "name").distinct()
    found = cut_lineage(nodes.select("id", "name").join(asked.select("name").distinct(), "name").distinct())
    known = asked.join(found.select("name").distinct(), "name", "left_semi")
    wanted = known.select(*by, c("name").alias("start_name")).join(known.select(*by, c("name").alias("goal_name")), by)
    wanted = cut_lineage(wanted.filter("start_name <> goal_name"))
    links = wanted.select("start_name", "goal_name").distinct()
    ends = links.join(found.toDF("start_name", "start"), "start_name").join(found.toDF("goal_name", "goal"), "goal_name")
    pairs = cut_lineage(ends.filter("start <> goal"))
    paths = shortest_paths(pairs.select("start", "goal"), edges, max_depth, steps)
    shared = first_n(pairs.join(paths, ["start", "goal"]), ["start_name", "goal_name"], [c("path_length"), c("start"), c("goal")], limit).drop("rank")
    named = wanted.join(shared, ["start_name", "goal_name"])
    top = first_n(named, by, [c("path_length"), c("start_name"), c("goal_name"), c("start"), c("goal")], limit)
    return top.drop("rank") if keys else top.drop("rank", "_question")


def snapshot_path_pairs(matched: DataFrame) -> DataFrame:
    """Pairs tried by the snapshot variant: each of the first two matched ids with the two after it."""
    top = matched.select("id").distinct().orderBy("id").limit(4)
    numbered = top.groupBy().agg(F.array_sort(F.collect_list("id")).alias("ids"))

    def pair(i: int, j: int) -> Column:
        return F.when(F.size("ids") > j, F.struct(c("ids")[i].alias("start"), c("ids")[j].alias("goal")))

    return numbered.select(F.inline(F.array_compact(F.array(pair(0, 1), pair(0, 2), pair(1, 2), pair(1, 3)))))


def snapshot_paths(matched: DataFrame, edges: DataFrame, max_depth: int = 5) -> DataFrame:
    """Snapshot variant: the depth (at most 5) bounds the number of nodes, hence one edge less."""
    return shortest_paths(snapshot_path_pairs(matched), edges, _within(max_depth, MAX_PATH_EDGES) - 1)


def subgraph(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``depth`` of the seeds and the edges on the walks that reach them.

    An edge is on such a walk when one of its ends is nearer than ``depth``.
    """
    edges = kept(edges)  # read by every step below, formed once
    reached = k_hop(seeds, edges, depth)
    inner = reached.filter(c("hop") < _within(depth, MAX_HOPS)).select("id")
    touched = edges.join(inner.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(
        edges.join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi")).select("id").distinct()
    return nodes.join(reached.select("id"), "id", "left_semi"), edges.join(touched, "id", "left_semi")
