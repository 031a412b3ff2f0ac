"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as lower-cased words of letters and digits joined by single spaces. An item may differ from a passage of
a document by up to ``budget`` edits; cut into ``budget + 1`` pieces, at least one piece must occur unchanged. Pieces are
found exactly (a table of piece hashes, one pass per block of items), and every hit is verified with the bit-parallel edit
distance of Myers over the stretch of text where the item can lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import blocks, byte_prefix, range_hash

#: Edits allowed per character of an item.
RATE = 0.05
#: Items that one pass over the documents looks for: so many rows and bytes at most.
ITEMS_PER_PASS = 20_000
BYTES_PER_PASS = 16 << 20


def normalised(text: Column) -> Column:
    """Lower-cased runs of letters and digits, joined by one space; null gives the empty text."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+", " "))


def budget(length: int, rate: float = RATE) -> int:
    return int(length * rate)


def pieces(length: int, rate: float = RATE) -> list[tuple[int, int]]:
    """``budget + 1`` bounds of near-equal pieces of an item of ``length`` bytes."""
    n = budget(length, rate) + 1
    cuts = [length * i // n for i in range(n + 1)]
    return list(zip(cuts[:-1], cuts[1:]))


def best_match(pattern: bytes, text: bytes, most: int) -> tuple[int, int] | None:
    """``(distance, end)`` of the best occurrence of ``pattern`` in ``text`` with at most ``most`` edits, the first of the best.

    Myers' bit-parallel method: one word of as many bits as the pattern has bytes holds a whole column of differences.
    """
    m = len(pattern)
    where: dict[int, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = mask, 0, m
    best = None
    for j, c in enumerate(text):
        eq = where.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & mask
        mh = plus & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & mask  # row 0 stays 0: the occurrence may start anywhere
        mh = mh << 1 & mask
        plus = mh | ~(xv | ph) & mask
        minus = ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class PieceTable:
    """Hashes of the pieces of a block of items, by piece length."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float):
        self.items, self.rate = items, rate
        by_length: dict[int, list[tuple[int, int]]] = {}
        for number, (_, text) in enumerate(items):
            for a, b in pieces(len(text), rate):
                by_length.setdefault(b - a, []).append((number, a))
        whole = np.frombuffer(b"".join(text for _, text in items), np.uint8)
        base = np.concatenate([[0], np.cumsum([len(text) for _, text in items])]).astype(np.int64)
        prefix = byte_prefix(whole)
        self.tables = {}
        for length, places in by_length.items():
            number, at = np.array(places, np.int64).T
            begin = base[number] + at
            values = range_hash(prefix, begin, begin + length)
            order = np.argsort(values, kind="stable")
            self.tables[length] = (values[order], number[order], at[order])

    def hits(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """``(document, item number, place of the piece in the document, place in the item)``; pieces start at any byte."""
        prefix = byte_prefix(data)
        for length, (values, numbers, ats) in self.tables.items():
            begin = np.arange(max(0, len(data) - length + 1))
            got = range_hash(prefix, begin, begin + length)
            # a 16-bit filter first: most places fall out before the search
            filter_ = np.zeros(1 << 16, bool)
            filter_[(values & np.uint64(0xFFFF)).astype(np.int64)] = True
            maybe = np.flatnonzero(filter_[(got & np.uint64(0xFFFF)).astype(np.int64)])
            left = np.searchsorted(values, got[maybe], "left")
            right = np.searchsorted(values, got[maybe], "right")
            hit = np.flatnonzero(right > left)
            doc = np.searchsorted(offs, maybe[hit], "right") - 1
            inside = maybe[hit] + length <= offs[doc + 1]
            for d, p, a, b in zip(doc[inside].tolist(), maybe[hit][inside].tolist(), left[hit][inside].tolist(), right[hit][inside].tolist()):
                for k in range(a, b):
                    yield d, int(numbers[k]), p - int(offs[d]), int(ats[k])


def _best_of(table: PieceTable, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, int]]:
    """``(document, item id, distance, end)`` of the best verified match of every document and item with a piece in common."""
    raw = data.tobytes()
    spots: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for doc, number, place, at in table.hits(data, offs):
        m = len(table.items[number][1])
        k = budget(m, table.rate)
        spots.setdefault((doc, number), []).append((place - at - k, place - at + m + k))
    rows = []
    for (doc, number), windows in spots.items():
        text = raw[offs[doc]:offs[doc + 1]]
        item_id, pattern = table.items[number]
        most = budget(len(pattern), table.rate)
        best = None
        merged: list[list[int]] = []
        for a, b in sorted(windows):
            a, b = max(a, 0), min(b, len(text))
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for a, b in merged:
            if best and best[0] == 0:
                break
            exact = text.find(pattern, a, b)  # the common case
            found = (0, exact - a + len(pattern)) if exact >= 0 else best_match(pattern, text[a:b], most)
            if found and (best is None or found[0] < best[0]):
                best = (found[0], a + found[1])
        if best:
            rows.append((doc, item_id, *best))
    return rows


def _matches(batches: Iterator[pa.RecordBatch], table: PieceTable) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offs in blocks(batch, "text", 1 << 20):
            rows = _best_of(table, data, offs)
            docs = part.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([docs, *(pa.array([r[i] for r in rows], kind) for i, kind in ((1, pa.int64()), (2, pa.int32()), (3, pa.int64())))], names=["doc_id", "number", "distance", "end"])


def _free(batches: Iterator[pa.RecordBatch], table: PieceTable) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offs in blocks(batch, NORMAL, 1 << 20):
            keep = np.ones(part.num_rows, bool)
            keep[[r[0] for r in _best_of(table, data, offs)]] = False
            yield part.filter(pa.array(keep))


#: Column of the normalised text while items are looked for.
NORMAL = "_normalised"


def numbered_items(benchmark: DataFrame) -> DataFrame:
    """``number, words, item_id`` of every item with a letter or digit; items with the same words share a number."""
    words = normalised(F.col("text")).alias("words")
    return benchmark.select(F.coalesce("item_id", F.lit(-1)).cast("long").alias("item_id"), words).filter("words <> ''").withColumn("number", F.xxhash64("words"))


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """Blocks of distinct normalised items by number, bounded in rows and bytes; only one block is on the driver at a time."""
    items = numbered_items(benchmark).select("number", "words").distinct()
    block, size = [], 0
    for row in items.orderBy("number", "words").toLocalIterator():
        text = row["words"].encode()
        if block and (len(block) >= ITEMS_PER_PASS or size + len(text) > BYTES_PER_PASS):
            yield block
            block, size = [], 0
        block.append((row["number"], text))
        size += len(text)
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, every: bool = False) -> DataFrame:
    """``(doc_id, item_id, distance, end)``: every document that holds a passage within ``rate`` of an item, one row for each
    pair, with the least distance and the byte end of the first best passage in the normalised text.

    Null and empty texts match nothing, nor do items without words; rows with equal ids are separate documents; items with
    the same words are looked for once, and come back under their smallest id or, with ``every``, in a row each; null item ids
    come back as -1; an empty table on either side gives no rows.
    """
    texts = docs.select("doc_id", normalised(F.col("text")).alias("text"))
    out = None
    for block in item_blocks(benchmark):
        found = texts.mapInArrow(partial(_matches, table=PieceTable(block, rate)), "doc_id long, number long, distance int, end long")
        out = found if out is None else out.union(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, distance int, end long")
    ids = numbered_items(benchmark).select("number", "item_id").distinct()
    if not every:
        ids = ids.groupBy("number").agg(F.min("item_id").alias("item_id"))
    return out.join(ids, "number").select("doc_id", "item_id", "distance", "end")


def without_items(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """``docs`` without the documents that :func:`contaminated` names, in place and with all columns; nothing is shuffled."""
    columns = docs.columns
    plain = docs.withColumn(NORMAL, normalised(F.col("text")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    for block in item_blocks(benchmark):
        plain = plain.mapInArrow(partial(_free, table=PieceTable(block, rate)), kinds)
    return plain.select(*columns)
