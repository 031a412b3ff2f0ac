"""Exact top-k by inner product over a pivot-distance index.

Vectors get one more component so that all have the norm of the longest; then a larger inner product is a smaller distance.
Each vector is keyed by its nearest pivot and its distance to it. Cells are annuli: stretches of that distance around a
pivot, held as blocks of a bounded number of rows. A block of queries meets the blocks in the order of their lower bounds
``|d(query, pivot) - d(row, pivot)|`` (triangle inequality) and stops where no row can reach its k-th best any more.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import cut

#: Rows of a block of the index, and of a block of queries.
BLOCK = 4096
QUERY_BLOCK = 1024
#: Pivots: the first rows by a hash, at most so many (the index holds every row; only pivots are a sample).
MOST_PIVOTS = 64
SCALE = 64
#: Score of a place that is still free; its negative is a long as well.
NONE = -(2 ** 63 - 1)


def quantised(embedding: Column) -> Column:
    """``floor(64 * x)`` of all components; null for vectors that are null, empty, or hold a null or non-finite component."""
    x = F.transform(embedding, lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(c * SCALE).cast("long"))
    return F.when((F.size(x) > 0) & ~F.coalesce(bad, F.lit(True)), whole)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as int64; shorter vectors are filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = column.flatten().to_numpy()
    return out


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    """One more component: what the squared norm lacks to ``top``."""
    return np.sqrt(np.maximum(top - (x.astype(np.float64) ** 2).sum(axis=1), 0.0))


def _distances(x: np.ndarray, lift: np.ndarray, pivots: np.ndarray, pivot_lift: np.ndarray) -> np.ndarray:
    a = np.concatenate([x.astype(np.float64), lift[:, None]], axis=1)
    b = np.concatenate([pivots.astype(np.float64), pivot_lift[:, None]], axis=1)
    squares = (a ** 2).sum(axis=1)[:, None] + (b ** 2).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(squares, 0.0))


def _keyed(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, top: float) -> Iterator[pa.RecordBatch]:
    lift = _lifted(pivots, top)
    for batch in batches:
        x = _matrix(batch.column("q"), pivots.shape[1])
        d = _distances(x, _lifted(x, top), pivots, lift)
        near = d.argmin(axis=1)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("q"), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near])], names=["vec_id", "q", "pivot", "distance"])


def _packed(batches: Iterator[pa.RecordBatch], width: int, size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of at most ``size`` rows of one pivot; rows come sorted by pivot and distance."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def out(table: pa.Table) -> pa.RecordBatch:
        d = table.column("distance").to_numpy()
        ids = table.column("vec_id").to_numpy().astype(np.int64)
        vectors = _matrix(table.column("q").combine_chunks(), width)
        return pa.RecordBatch.from_arrays(
            [pa.array([table.column("pivot")[0].as_py()], pa.int32()), pa.array([float(d.min())]), pa.array([float(d.max())]), pa.array([ids.tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary())],
            names=["pivot", "low", "high", "ids", "vectors"])

    for batch in batches:
        pivot = batch.column("pivot").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(pivot)) + 1).tolist(), len(pivot)]
        for a, b in zip(edges[:-1], edges[1:]):
            at = a
            while at < b:
                if held and (rows >= size or held[0].column("pivot")[0].as_py() != pivot[at]):
                    yield out(pa.Table.from_batches(held))
                    held, rows = [], 0
                step = min(b - at, size - rows)
                held.append(batch.slice(at, step))
                rows, at = rows + step, at + step
    if held:
        yield out(pa.Table.from_batches(held))


def inner(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by floating-point multiplication where no sum can pass 2**53, else by integers."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, queries.shape[1])
    if bound < 2 ** 53:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return queries @ rows.T


def _search(batches: Iterator[pa.RecordBatch], width: int, k: int, pivots: np.ndarray, top: float) -> Iterator[pa.RecordBatch]:
    """Running k best of each query block over its index blocks, which come in the order of their bounds."""
    lift = _lifted(pivots, top)
    now = None
    state: dict = {}

    def result() -> pa.RecordBatch:
        ids, scores = state["ids"], state["scores"]
        some = scores > NONE
        which = np.repeat(np.arange(len(ids)), some.sum(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(state["names"][which]), pa.array(ids[some]), pa.array(scores[some])], names=["query", "vec_id", "score"])

    for batch in batches:
        for i in range(batch.num_rows):
            name = (batch.column("part")[i].as_py(), batch.column("block")[i].as_py())
            if name != now:
                if state:
                    yield result()
                now = name
                q = np.frombuffer(batch.column("q_vectors")[i].as_buffer(), np.int64).reshape(-1, width)
                d = _distances(q, np.zeros(len(q)), pivots, lift)
                names = np.frombuffer(batch.column("q_ids")[i].as_buffer(), np.int64)
                norm = (q.astype(np.float64) ** 2).sum(axis=1)
                state = {"q": q, "d": d, "names": names, "norm": norm, "ids": np.full((len(q), k), np.iinfo(np.int64).max), "scores": np.full((len(q), k), NONE)}
            pivot, low, high = batch.column("pivot")[i].as_py(), batch.column("low")[i].as_py(), batch.column("high")[i].as_py()
            to = state["d"][:, pivot]
            least = np.maximum(np.maximum(to - high, low - to), 0.0)
            # |q - x|^2 = norm + top - 2 * score for lifted rows and queries with lift 0
            most = (state["norm"] + top - np.maximum(least * (1 - 1e-9) - 1e-6, 0) ** 2) / 2
            live = np.flatnonzero(most + 1e-6 * np.abs(most) + 1 >= state["scores"][:, -1].astype(np.float64))
            if not len(live):
                continue
            ids = np.frombuffer(batch.column("ids")[i].as_buffer(), np.int64)
            x = np.frombuffer(batch.column("vectors")[i].as_buffer(), np.int64).reshape(-1, width)
            for at in range(0, len(live), 256):
                pick = live[at:at + 256]
                scores = inner(state["q"][pick], x)
                if scores.shape[1] > k:
                    edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
                    edge = np.maximum(edge, state["scores"][pick, -1])
                    row, column = np.nonzero(scores >= edge[:, None])
                else:
                    row, column = np.nonzero(np.ones_like(scores, bool))
                all_row = np.concatenate([np.repeat(np.arange(len(pick)), k), row])
                all_score = np.concatenate([state["scores"][pick].ravel(), scores[row, column]])
                all_id = np.concatenate([state["ids"][pick].ravel(), ids[column]])
                order = np.lexsort((all_id, -all_score, all_row))
                begin = np.searchsorted(all_row[order], np.arange(len(pick)))
                chosen = order[(begin[:, None] + np.arange(k)[None, :]).ravel()]
                state["scores"][pick] = all_score[chosen].reshape(len(pick), k)
                state["ids"][pick] = all_id[chosen].reshape(len(pick), k)
    if state:
        yield result()


def top_k(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` highest inner products for each row whose id ``every`` divides.

    ``vectors`` has ``vec_id`` and ``embedding``. Vectors that are null, empty or hold a null or non-finite component take no
    part; null ids take no part; missing components of shorter vectors count as 0; ties go to the smaller id; rows that
    repeat an id are candidates each, and a query's own id is no candidate; an empty table gives no rows. Of equal vectors
    only the ``k + 1`` smallest ids can be among the best, so a vector that a third of all rows share is as cheap as any.
    """
    spark = vectors.sparkSession
    valid = cut(vectors.select("vec_id", quantised(F.col("embedding")).alias("q")).filter("q is not null and vec_id is not null"))
    facts = valid.select(
        F.count("*").alias("n"), F.max(F.size("q")).alias("width"),
        F.max(F.aggregate("q", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))).alias("top")).first()
    result = "query_id long, rank int, vec_id long, score long"
    if not facts["n"]:
        return spark.createDataFrame([], result)
    width, top = facts["width"], float(facts["top"])
    # k + 1 of equal vectors: one may be the query's own row
    same = Window.partitionBy("q").orderBy("vec_id")
    rows = cut(valid.withColumn("_nth", F.row_number().over(same)).filter(F.col("_nth") <= k + 1).select("vec_id", "q"))
    n_pivots = int(min(MOST_PIVOTS, max(1, np.sqrt(facts["n"] / BLOCK) * 4)))
    sample = rows.orderBy(F.xxhash64("q"), "vec_id").limit(n_pivots).collect()
    pivots = np.zeros((len(sample), width), np.int64)
    for i, r in enumerate(sample):
        pivots[i, :len(r["q"])] = r["q"]
    keyed = "vec_id long, q array<long>, pivot int, distance double"
    block = "pivot int, low double, high double, ids binary, vectors binary"
    place = partial(_keyed, pivots=pivots, top=top)
    index = cut(rows.mapInArrow(place, keyed).repartitionByRange("pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id")
                .mapInArrow(partial(_packed, width=width, size=BLOCK), block))
    # equal query vectors are asked once, under their smallest id
    asked = valid.filter(F.col("vec_id") % every == 0).groupBy("q").agg(F.min("vec_id").alias("vec_id")).select("vec_id", "q")
    queries = (
        asked.mapInArrow(place, keyed).repartitionByRange("pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id")
        .mapInArrow(partial(_packed, width=width, size=QUERY_BLOCK), block)
    )
    blocks = cut(queries.select(F.col("pivot").alias("q_pivot"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.xxhash64("ids").alias("block"), ((F.col("low") + F.col("high")) / 2).alias("reach")))
    # every block of queries goes over the index by pivots, nearest annuli first; an equi join on the pivot number
    gaps = _distances(pivots, _lifted(pivots, top), pivots, _lifted(pivots, top))
    rings = spark.createDataFrame([(i, j, float(gaps[i, j])) for i in range(len(pivots)) for j in range(len(pivots))], "q_pivot int, pivot int, gap double")
    parts = F.pmod(F.xxhash64("pivot", "low"), F.lit(PARTS)).alias("part")
    met = blocks.join(rings, "q_pivot").join(index, "pivot").select("block", parts, "q_ids", "q_vectors", "pivot", "low", "high", "ids", "vectors", F.abs(F.col("gap") - F.col("low")).alias("bound"))
    found = (
        met.repartition("block", "part").sortWithinPartitions("part", "block", "bound")
        .mapInArrow(partial(_search, width=width, k=k + 1, pivots=pivots, top=top), "query long, vec_id long, score long")
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    answers = cut(found.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k + 1).select("query", "vec_id", "score"))
    # hand the answers of a query vector to all ids that ask it, without their own rows
    askers = valid.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "q").distinct().join(asked.withColumnRenamed("vec_id", "query"), "q").select("query_id", "query")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = askers.join(answers, "query").filter("vec_id <> query_id").withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: Shares of the index that a block of queries searches side by side; each keeps its own k best until they are merged.
PARTS = 4
