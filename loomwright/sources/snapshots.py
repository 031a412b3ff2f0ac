"""Graph snapshots: JSON documents {nodes, edges} in rows, parsed to node and edge tables and written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright import schemas
from loomwright.functions import text as T
from loomwright.operators.ranking import positions

c = F.col


def _first(struct: str, *names: str) -> Column:
    """First of several fields that is not blank."""
    return F.coalesce(*[F.nullif(T.strip(c(f"{struct}.{n}")), F.lit("")) for n in names])


def _parsed(graphs: DataFrame) -> DataFrame:
    return graphs.withColumn("_data", F.from_json("graph_data", schemas.SNAPSHOT))


def _placed(rows: DataFrame, item: str) -> DataFrame:
    return rows.withColumn("pos", F.coalesce(c(f"{item}.pos"), c("pos").cast("long")))


def snapshot_to_nodes(graphs: DataFrame) -> DataFrame:
    """Node rows of all graphs; a graph with bad JSON gives none. ``pos`` is the stored place, else the one inside its document."""
    rows = _placed(_parsed(graphs).select("graph_id", F.posexplode("_data.nodes").alias("pos", "n")), "n")
    return rows.select(
        "graph_id", "pos", _first("n", "id", "name", "label").alias("id"), _first("n", "name", "label").alias("name"),
        _first("n", "type", "label", "category").alias("type"), c("n.category").alias("category"),
        F.coalesce(c("n.description"), c("n.properties")["description"]).alias("description"), c("n.properties").alias("properties"),
    )


def snapshot_to_edges(graphs: DataFrame) -> DataFrame:
    """Edge rows; ``edges`` when that list has items, else ``relations``; all key spellings are accepted."""
    lists = F.when(F.size("_data.edges") > 0, c("_data.edges")).otherwise(c("_data.relations"))
    rows = _placed(_parsed(graphs).select("graph_id", F.posexplode(lists).alias("pos", "e")), "e")
    named = rows.select(
        "graph_id", "pos", c("e.id").alias("id"), _first("e", "source", "sourceId", "subject").alias("src"),
        F.coalesce(_first("e", "label", "relation", "predicate", "type"), F.lit("")).alias("rel"),
        _first("e", "target", "targetId", "object").alias("dst"), c("e.properties").alias("properties"),
    ).filter("src is not null and dst is not null")
    return named.withColumn("id", F.coalesce(F.nullif(c("id"), F.lit("")), F.concat_ws("_", "src", "rel", "dst")))


def write_snapshots(nodes: DataFrame, edges: DataFrame, items_per_part: int | None = None) -> DataFrame:
    """(graph_id, part, graph_data) with exactly the keys ``nodes`` and ``edges``; one document per graph, part 0.

    Given ``items_per_part``, every graph is written in documents of that many nodes and edges, so no row grows with the
    graph. Items carry their place ``pos`` in the graph, which does not depend on the parts: it follows a hash of the whole
    row, so that a large graph is numbered by many tasks, and null ids are spread as well.
    """
    def parts(df: DataFrame, name: str) -> DataFrame:
        fields = [n for n in df.columns if n not in ("graph_id", "pos")]
        stamp = {f: t for f, t in df.dtypes if t == "timestamp"}
        text = F.to_json(F.struct(*fields))
        hashed = df.select("graph_id", *fields).withColumn("_text", text).withColumn("_hash", F.xxhash64("_text"))
        numbered = positions(hashed, ["graph_id"], [c("_hash"), c("_text")], F.shiftright("_hash", 52))
        pos = (c("position") - 1).alias("pos")
        item = F.struct(pos, *[F.date_format(c(f), "yyyy-MM-dd'T'HH:mm:ss").alias(f) if f in stamp else c(f) for f in fields])
        part = F.floor((c("position") - 1) / items_per_part).cast("int") if items_per_part else F.lit(0)
        return numbered.select("graph_id", part.alias("part"), item.alias("_item")).groupBy("graph_id", "part").agg(F.array_sort(F.collect_list("_item")).alias(name))

    both = parts(nodes, "nodes").join(parts(edges, "edges"), ["graph_id", "part"], "full")
    filled = F.struct(*[F.coalesce(c(n), F.array().cast(both.schema[n].dataType)).alias(n) for n in ("nodes", "edges")])
    return both.select("graph_id", "part", F.to_json(filled).alias("graph_data"))


def resolve_endpoints(edges: DataFrame, nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Replace edge ends by node ids: an id stays, a name becomes its smallest id, others drop the edge."""
    keys = keys or []
    ids = nodes.select(*keys, "id").distinct()
    names = nodes.filter("name is not null").groupBy(*keys, "name").agg(F.min("id").alias("_by_name"))
    out = edges
    for end in ("src", "dst"):
        known = ids.select(*keys, c("id").alias(end), F.lit(True).alias("_known"))
        named = names.withColumnRenamed("name", end)
        out = out.join(known, [*keys, end], "left").join(named, [*keys, end], "left")
        out = out.withColumn(end, F.when(c("_known"), c(end)).otherwise(c("_by_name"))).drop("_known", "_by_name").filter(c(end).isNotNull())
    return out
