"""Vector code compression: four codes a vector from codebooks that Lloyd's rounds fit over all rows, in exact integers.

The sub-vectors of each part are sorted along a Hilbert curve and packed into flat blocks with their least and greatest
components and their sums. In every round a block's box leaves a shortlist of entries that can be nearest to any of its
rows. A shortlist of one takes the block's sums as they are; else a small integer kernel compares the rows with the
shortlist only. The order of the rows changes the work, never the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import cut

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
BLOCK_ROWS = 256
#: Components that the curve follows (of the widest spread) and its bits in all.
CURVE_WIDTH = 16
CURVE_BITS = 60

RESULT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def quantised(embedding: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of all components; null for vectors that are null or hold a null or non-finite component."""
    x = F.transform(embedding, lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(x, lambda c: F.floor(c * scale).cast("long")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as int64; shorter vectors are filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = column.flatten().to_numpy()
    return out


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of ``cells`` (values below ``2**bits``) on the Hilbert curve through their cube."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):
        flip = (1 << level) - 1
        for i in range(len(x)):
            up = (x[i] >> level) & 1 == 1
            swap = np.where(up, 0, (x[0] ^ x[i]) & flip)
            x[0] = np.where(up, x[0] ^ flip, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    key = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | ((axis ^ turn) >> level) & 1
    return key


def _split(batches: Iterator[pa.RecordBatch], start: np.ndarray, kind: str) -> Iterator[pa.RecordBatch]:
    """One row per vector and part with its place on the curve. ``start`` (the first entries) sets the grid: cells divide
    two standard deviations on either side of the mean, what lies outside is in the outermost cell."""
    wide = start.shape[1] // PARTS
    middle, spread = start.mean(axis=0), np.maximum(start.std(axis=0), 0.5)
    for batch in batches:
        x = _matrix(batch.column("q"), start.shape[1])
        for part in range(PARTS):
            span = slice(part * wide, (part + 1) * wide)
            axes = np.sort(np.argsort(-spread[span], kind="stable")[:CURVE_WIDTH]) + part * wide
            bits = CURVE_BITS // max(1, len(axes))
            cells = np.clip((x[:, axes] - middle[axes]) / spread[axes] * 0.25 + 0.5, 0, 1 - 1e-9) * (1 << bits)
            flat = np.ascontiguousarray(x[:, span].astype(kind))
            size = flat.shape[1] * flat.itemsize
            offsets = np.arange(len(x) + 1, dtype=np.int32) * size
            data = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(x), part, np.int32)), pa.array(hilbert(cells.astype(np.int64), bits)), batch.column("row"), data], names=["part", "place", "row", "data"])


def _packed(batches: Iterator[pa.RecordBatch], kind: str, size: int) -> Iterator[pa.RecordBatch]:
    """Flat blocks of at most ``size`` rows of one part, in the order in which the rows come."""
    held: list[tuple[np.ndarray, bytes]] = []
    rows, of = 0, None

    def out() -> pa.RecordBatch:
        ids = np.concatenate([i for i, _ in held])
        x = np.frombuffer(b"".join(d for _, d in held), kind).reshape(len(ids), -1).astype(np.int64)
        values = [ids.tobytes(), x.astype(kind).tobytes(), x.min(axis=0).tobytes(), x.max(axis=0).tobytes(), x.sum(axis=0).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([of], pa.int32()), *[pa.array([v], pa.binary()) for v in values]], names=["part", "ids", "data", "low", "high", "sums"])

    for batch in batches:
        part, ids, data = batch.column("part").to_numpy(), batch.column("row").to_numpy(), batch.column("data")
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, b in zip(edges[:-1], edges[1:]):
            while a < b:
                if held and (rows >= size or of != int(part[a])):
                    yield out()
                    held, rows = [], 0
                step = min(b - a, size - rows)
                held.append((ids[a:a + step], b"".join(data[a:a + step].to_pylist())))
                of, rows, a = int(part[a]), rows + step, a + step
    if held:
        yield out()


def shortlist(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The entries, ascending, that can be nearest (ties included) to a point of the box.

    An entry goes if its least distance to the box is above the greatest distance of another one, or if it is farther than
    the entry nearest to the box's middle at every point: the difference of two squared distances is linear in the point.
    """
    near = np.maximum(np.maximum(low - book, book - high), 0)
    far = np.maximum(np.abs(book - low), np.abs(high - book))
    keep = np.flatnonzero((near * near).sum(axis=1) <= (far * far).sum(axis=1).min())
    if len(keep) == 1:
        return keep
    some = book[keep]
    middle = some[((2 * some - low - high) ** 2).sum(axis=1).argmin()]
    turn = some - middle
    least = ((some * some) - (middle * middle)).sum(axis=1) - 2 * np.maximum(low * turn, high * turn).sum(axis=1)
    return keep[least <= 0]


def nearest(x: np.ndarray, book: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (the first of equals) of each row, and the squared distance. ``exact``: no sum reaches 2**53, so that
    floating-point products are whole; else integers."""
    a, b = (x.astype(np.float64), book.astype(np.float64)) if exact else (x, book)
    d = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
    which = d.argmin(axis=1)
    return which, d[np.arange(len(x)), which].astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], books: np.ndarray, kind: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    wide = books.shape[2]
    for batch in batches:
        for part, ids, data, low, high, sums in zip(*(batch.column(c).to_pylist() for c in ("part", "ids", "data", "low", "high", "sums"))):
            low, high, sums = (np.frombuffer(v, np.int64) for v in (low, high, sums))
            rows = np.frombuffer(ids, np.int64)
            yield part, rows, np.frombuffer(data, kind).reshape(len(rows), wide), shortlist(low, high, books[part]), sums


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray, kind: str, exact: bool) -> Iterator[pa.RecordBatch]:
    """Per entry the sums of the parts assigned to it and, last, their number; one row per entry met in the task."""
    n, wide = books.shape[1:]
    total = np.zeros((PARTS, n, wide + 1), np.int64)
    for part, rows, data, some, sums in _blocks(batches, books, kind):
        if len(some) == 1:
            total[part, some[0], :-1] += sums
            total[part, some[0], -1] += len(rows)
            continue
        x = data.astype(np.int64)
        which, _ = nearest(x, books[part][some], exact)
        order = np.argsort(which, kind="stable")
        begin = np.flatnonzero(np.diff(which[order], prepend=-1))
        entries = some[which[order][begin]]
        total[part, entries, :-1] += np.add.reduceat(x[order], begin, axis=0)
        total[part, entries, -1] += np.diff(begin, append=len(order))
    part, entry = np.nonzero(total[:, :, -1])
    if len(part):
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "sums"])


def _codes(batches: Iterator[pa.RecordBatch], books: np.ndarray, kind: str, exact: bool) -> Iterator[pa.RecordBatch]:
    """Each row's part of the code, in its place, and its squared distance."""
    for part, rows, data, some, _ in _blocks(batches, books, kind):
        which, distance = nearest(data.astype(np.int64), books[part][some], exact)
        code = some[which].astype(np.int64) << 8 * (PARTS - 1 - part)
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(code), pa.array(distance)], names=["row", "code", "error"])


def _start(valid: DataFrame, width: int) -> np.ndarray:
    """The vectors of the ``ENTRIES`` smallest ids: the one thing that passes through the driver whole, bounded by that number."""
    rows = valid.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(ENTRIES).select("q").collect()
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r["q"])] = r["q"]
    return out


def compress(vectors: DataFrame) -> tuple[DataFrame, np.ndarray | None]:
    """``vec_id, label, code, error`` of every valid row, and the codebooks (part, entry, position; None without rows).

    ``vectors`` has ``vec_id, embedding, label``. Vectors that are null or hold a null or non-finite component are left out.
    Shorter vectors count as filled with zeros to the longest, and all to a multiple of the number of parts. The first
    entries are the vectors of the smallest ids (null ids last, equal ids by vector); with fewer rows there are fewer
    entries, and equal entries leave all to the first. Rows that repeat an id or a vector are rows each: equal vectors lie
    in many blocks, which then have a box without extent. Squared distances must stay below 2**63, else ValueError. An empty
    table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    named = vectors.select("vec_id", "label", quantised(F.col("embedding")).alias("q")).filter("q is not null")
    valid = cut(named.withColumn("row", F.monotonically_increasing_id()))
    facts = valid.agg(F.max(F.size("q")).alias("width"), F.max(F.array_max(F.transform("q", F.abs))).alias("most")).first()
    if facts["width"] is None:
        return spark.createDataFrame([], "vec_id long, label int, code string, error long"), None
    width = max(PARTS, -(-facts["width"] // PARTS) * PARTS)
    most = facts["most"] or 0
    bound = 4 * most * most * width
    if bound >= 2 ** 63:
        raise ValueError(f"components up to {most} over {width} places: squared distances pass 2**63")
    kind = "int16" if most < 2 ** 15 else "int32" if most < 2 ** 31 else "int64"
    exact = bound < 2 ** 53
    start = _start(valid, width)
    books = start.reshape(len(start), PARTS, width // PARTS).transpose(1, 0, 2).copy()
    placed = valid.select("row", "q").mapInArrow(partial(_split, start=start, kind=kind), "part int, place long, row long, data binary")
    flat = "part int, ids binary, data binary, low binary, high binary, sums binary"
    blocks = cut(
        placed.repartitionByRange("part", "place", "row").sortWithinPartitions("part", "place", "row").mapInArrow(partial(_packed, kind=kind, size=BLOCK_ROWS), flat))
    for _ in range(ROUNDS):
        sums = blocks.mapInArrow(partial(_sums, books=books, kind=kind, exact=exact), "part int, entry int, sums array<long>")
        total = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)
        # at most one number per component of an entry reaches the driver
        for part, entry, place, value in sums.select("part", "entry", F.posexplode("sums")).groupBy("part", "entry", "pos").agg(F.sum("col")).collect():
            total[part, entry, place] = value
        used = total[:, :, -1:] > 0
        books = np.where(used, total[:, :, :-1] // np.maximum(total[:, :, -1:], 1), books)
    codes = blocks.mapInArrow(partial(_codes, books=books, kind=kind, exact=exact), "row long, code long, error long")
    names = valid.select("row", "vec_id", "label", F.lit(0).cast("long").alias("code"), F.lit(0).cast("long").alias("error"))
    whole = codes.unionByName(names, allowMissingColumns=True).groupBy("row").agg(
        F.max("vec_id").alias("vec_id"), F.max("label").alias("label"), F.sum("code").alias("code"), F.sum("error").alias("error"))
    return whole.select("vec_id", "label", F.lpad(F.lower(F.hex("code")), 2 * PARTS, "0").alias("code"), "error"), books


def codebook_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_digest(vectors: DataFrame) -> DataFrame:
    """Codes and errors of every row with the error of its label and the digest of the codebooks; the columns of op12.

    Cases as in :func:`compress`; null labels are one label. A label of very many rows is summed in its tasks first.
    """
    coded, books = compress(vectors)
    if books is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    coded = cut(coded)
    labels = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(labels, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))
