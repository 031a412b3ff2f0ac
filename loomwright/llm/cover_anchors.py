"""Repeated passages by difference-cover anchors.

Anchors are hashes of ``span`` words taken only at the positions of a document that lie in a difference cover modulo
``period``. Two copies of a passage of ``span + period - 1`` words or more, wherever they stand, have an aligned anchor in
common: for any two positions some shift below ``period`` brings both into the cover. Only the neighbourhood of anchors
that occur twice is extended: its windows are hashed at every position (96 bits) and counted.

Within one task equal anchors are resolved on the spot and one of them is sent on as a witness, so a passage that a third of
all documents share costs one row per task, not one per document. Of whole texts that occur several times, one stands for all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import as_long, blocks, document_key, mix, prefix_hash, range_hash, word_hashes, word_spans

# Perfect difference sets (period, cover).
COVERS = ((31, (1, 5, 11, 24, 25, 27)), (21, (3, 6, 7, 12, 14)), (13, (0, 1, 3, 9)), (7, (1, 2, 4)), (3, (0, 1)), (1, (0,)))
#: An anchor has at least this share of the window's words.
LEAST_SHARE = 0.4
#: Hashes that a task holds before it resolves repeats among them.
HELD = 2_000_000


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """The sparsest cover whose anchors still have ``LEAST_SHARE`` of the window: ``(period, cover, span)``."""
    return next((p, c, window - p + 1) for p, c in COVERS if window - p + 1 >= max(1, LEAST_SHARE * window))


PLACES = "h1 long, key long, tail long, run int"


class _Held:
    """Hashes of a task with the keys of their documents and their word positions, kept until there are many."""

    def __init__(self, back: int) -> None:
        self.back = back  # a hash at position p says something about the windows that start from p - back to p
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.rows += len(columns[0])

    def flush(self) -> pa.RecordBatch:
        """Two kinds of rows. A witness for each value (``run`` 0): ``tail`` holds 32 more bits of the hash, the position and
        whether the task has met the value twice. Positions of such values need no more answer: they go out as runs of
        ``run`` window starts from the position in ``tail`` on, under a hash of their place."""
        h1, h2, key, at = (np.concatenate([p[i] for p in self.parts]) for i in range(4))
        self.parts, self.rows = [], 0
        order = np.lexsort((h2, h1))
        same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
        head, twin = np.ones(len(at), bool), np.zeros(len(at), bool)
        head[1:] = ~same
        twin[1:] |= same
        twin[:-1] |= same
        sent, known = np.zeros(len(at), bool), np.zeros(len(at), bool)
        sent[order], known[order] = head, twin
        tail = ((h2[sent] >> np.uint64(32)) << np.uint64(32)) | (at[sent].astype(np.uint64) << np.uint64(1)) | known[sent].astype(np.uint64)
        # runs: input rows are in document order
        key_k, at_k = key[known], at[known]
        begin = np.ones(len(at_k), bool)
        begin[1:] = (key_k[1:] != key_k[:-1]) | (at_k[1:] - self.back > at_k[:-1] + 1) | (at_k[1:] <= at_k[:-1])
        heads = np.flatnonzero(begin)
        lasts = np.append(heads[1:], len(at_k)) - 1
        from_at = np.maximum(at_k[heads] - self.back, 0)
        run = at_k[lasts] - from_at + 1
        run_tail = from_at.astype(np.uint64) << np.uint64(1)
        return pa.RecordBatch.from_arrays(
            [
                as_long(np.concatenate([h1[sent], mix(key_k[heads] ^ mix(run_tail))])), as_long(np.concatenate([key[sent], key_k[heads]])),
                as_long(np.concatenate([tail, run_tail])), pa.array(np.concatenate([np.zeros(int(sent.sum()), np.int64), run]).astype(np.int32)),
            ],
            names=["h1", "key", "tail", "run"],
        )


def _met_again(rows: DataFrame) -> DataFrame:
    """``(key, ranges)``: per document the (position, run) of hashes that occur twice; ``run`` is 0 for single positions."""
    value = Window.partitionBy("h1", F.shiftright("tail", 32))
    twice = rows.withColumn("_n", F.count("*").over(value)).filter("run > 0 or (_n > 1 and tail & 1 = 0)")
    at = F.shiftright(F.col("tail").bitwiseAND(F.lit(0xFFFFFFFF)), 1).cast("int").alias("at")
    return twice.groupBy("key").agg(F.collect_list(F.struct(at, "run")).alias("ranges"))


def _starts(ranges: pa.Array, i: int, back: int, n: int) -> np.ndarray:
    """Flags of the window starts among ``n`` that the ranges of row ``i`` name."""
    marks = np.zeros(n + 1, np.int32)
    if ranges[i].is_valid and n:
        of = ranges[i].values
        at, run = of.field(0).to_numpy().astype(np.int64), of.field(1).to_numpy().astype(np.int64)
        lo = np.where(run > 0, at, np.maximum(at - back, 0))
        hi = np.where(run > 0, at + run, at + 1)
        np.add.at(marks, np.minimum(lo, n), 1)
        np.add.at(marks, np.minimum(hi, n), -1)
    return np.cumsum(marks)[:n] > 0


def _anchors(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    period, cover, span = cover_for(window)
    in_cover = np.zeros(period, bool)
    in_cover[list(cover)] = True
    held = _Held(window - span)
    for batch in batches:
        for part, data, offs in blocks(batch, "text"):
            starts, ends, first = word_spans(data, offs)
            prefix = prefix_hash(word_hashes(data, starts, ends))
            n = np.diff(first)
            doc = np.repeat(np.arange(len(n)), n)
            local = np.arange(len(starts)) - first[:-1][doc]
            at = np.flatnonzero((n[doc] >= window) & in_cover[local % period] & (local + span <= n[doc]))
            if len(at):
                keys = part.column("key").to_numpy().view(np.uint64)[doc[at]]
                held.add(range_hash(prefix, at, at + span), np.zeros(len(at), np.uint64), keys, local[at])
            if held.rows >= HELD:
                yield held.flush()
    if held.rows:
        yield held.flush()


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    _, _, span = cover_for(window)
    held = _Held(0)
    for batch in batches:
        for part, data, offs in blocks(batch, "text"):
            starts, ends, first = word_spans(data, offs)
            sums = [prefix_hash(word_hashes(data, starts, ends, which)) for which in (0, 1)]
            keys = part.column("key").to_numpy().view(np.uint64)
            ranges = part.column("ranges")
            for i in range(part.num_rows):
                at = np.flatnonzero(_starts(ranges, i, window - span, max(0, int(first[i + 1] - first[i]) - window + 1)))
                begin = at + first[i]
                held.add(range_hash(sums[0], begin, begin + window), range_hash(sums[1], begin, begin + window), np.full(len(at), keys[i]), at)
            if held.rows >= HELD:
                yield held.flush()
    if held.rows:
        yield held.flush()


def _digest(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offs in blocks(batch, "text"):
            starts, ends, first = word_spans(data, offs)
            raw = data.tobytes()
            ranges, copied = part.column("ranges"), part.column("first").is_valid().to_pylist()
            removed, hashes = [], []
            for i in range(part.num_rows):
                a, n = int(first[i]), int(first[i + 1] - first[i])
                room = max(0, n - window + 1)
                begins = np.arange(room) if copied[i] else np.flatnonzero(_starts(ranges, i, 0, room))
                marks = np.zeros(n + 1, np.int32)
                marks[begins] += 1
                marks[begins + window] -= 1
                gone = np.cumsum(marks)[:n] > 0
                kept = np.flatnonzero(~gone) + a
                hashes.append(hashlib.sha256(b" ".join([raw[s:e] for s, e in zip(starts[kept].tolist(), ends[kept].tolist())])).hexdigest())
                removed.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(removed, pa.int64()), pa.array(hashes)],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )


def _copies(keyed: DataFrame) -> DataFrame:
    """``(key, first)`` of all documents whose whole text occurs several times; ``first`` marks one of each such group."""
    hashes = keyed.select("key", F.xxhash64("text").alias("t1"), F.hash("text").alias("t2"))
    groups = hashes.groupBy("t1", "t2").agg(F.min("key").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return hashes.join(groups, ["t1", "t2"]).select("key", (F.col("key") == F.col("least")).alias("first")).distinct()


def repeated_windows(docs: DataFrame, window: int = 35) -> DataFrame:
    """``docs`` (``doc_id, key, text``) with ``first`` and ``ranges``.

    ``first`` is not null where the whole text occurs several times: all its windows are repeated, and only one of the group
    (where it is true) takes part in the search. ``ranges`` has the word positions (with runs) at which a window starts that
    starts elsewhere too. Rows with the same key are separate documents with the same content.
    """
    marked = docs.join(_copies(docs), "key", "left").select("doc_id", "key", "text", "first")
    alone = marked.filter("first is null or first")
    near = _met_again(alone.mapInArrow(partial(_anchors, window=window), PLACES))
    regions = alone.join(near, "key").select("doc_id", "key", "text", "ranges")
    places = _met_again(regions.mapInArrow(partial(_windows, window=window), PLACES))
    return marked.join(places, "key", "left").select("doc_id", "key", "text", "first", "ranges")


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """Digest of ``documents`` after every word in a repeated window is gone: the columns of the op6 query.

    Windows are judged on the input; repeats inside one document count; rows with equal id and text are separate copies.
    Null and empty texts have no words and the digest of the empty text; null ids are kept; an empty table gives no rows;
    other columns are not read.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), document_key(docs).alias("key")).select("doc_id", "key", "text")
    found = repeated_windows(keyed, window)
    return found.mapInArrow(partial(_digest, window=window), "doc_id long, n_words long, n_removed long, kept_sha256 string")
