"""Names in texts by their rarest grams.

A gram is up to eight bytes of UTF-8, read as one number. A name of at most eight bytes is its own gram; a longer one is
looked for at the gram of its that the texts hold least often. Bloom filters of the grams are tested while texts are read, so
only places that can match leave a task, and texts themselves are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.session import cut_lineage

c = F.col
GRAM = 8
#: Bytes on either side of a gram that travel with it; names that reach farther are checked against the whole text.
CONTEXT = 64
#: Bits of a filter per gram, and the most bits of a filter (16 MB, sent to every task). A fuller filter lets more through.
BITS_PER_GRAM = 16
MOST_BITS = 1 << 27
_RUN_BYTES = 1 << 20


def _runs(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Stretches of rows with about a megabyte of text: number of the first row, bytes, offsets. Nulls are empty."""
    values = batch.column(column).cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = values.buffers()
    offs = np.frombuffer(offsets, np.int64, len(values) + 1, values.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(values):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + _RUN_BYTES, "right")) - 1)
        yield at, raw[offs[at]:offs[to]], offs[at:to + 1] - offs[at]
        at = to


def _ahead(data: np.ndarray, kind: str) -> np.ndarray:
    """The bytes from every place on as one number of type ``kind``, with zeros behind the end."""
    padded = np.concatenate([data, np.zeros(GRAM, np.uint8)])
    return np.ndarray((len(data),), kind, padded, strides=(1,))


def _mask(size: int) -> np.uint64:
    return np.uint64((1 << 8 * size) - 1)


def _places(grams: np.ndarray, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each gram in a filter of ``2**bits`` bits; fewer bits are the leading ones of more."""
    x = (grams ^ np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x >> np.uint64(64 - bits), (x * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - bits)


class Filter:
    """A Bloom filter of grams with two bits a gram, behind a table of their first two bytes (a bit per gram size).

    ``long`` says whether a name is longer than its gram.
    """

    def __init__(self, words: np.ndarray, bits: int, starts: np.ndarray, long: bool):
        self.words, self.bits, self.starts, self.long = words, bits, starts, long
        self.sizes = [size for size in range(1, GRAM + 1) if (starts >> (size - 1) & 1).any()]

    def _set(self, place: np.ndarray) -> np.ndarray:
        return (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)

    def hits(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per size the row, place and gram of everything in the filter that lies inside one row."""
        begins = self.starts[_ahead(data, "<u2")]
        at = np.flatnonzero(begins)
        begins, words = begins[at], _ahead(data, "<u8")[at]
        for size in self.sizes:
            some = np.flatnonzero(begins >> (size - 1) & 1)
            grams = words[some] & _mask(size)
            first, second = _places(grams, size, self.bits)
            passed = np.flatnonzero(self._set(first) & self._set(second))
            place, grams = at[some[passed]], grams[passed]
            row = np.searchsorted(offs, place, "right") - 1
            inside = place + size <= offs[row + 1]
            yield size, row[inside], place[inside], grams[inside]


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a filter is made of: words of the largest filter (kind 0), first bytes (1), whether a name is long (2)."""
    most = int(np.log2(MOST_BITS))
    for batch in batches:
        size = batch.column("size").to_numpy()
        grams = batch.column("gram").to_numpy().view(np.uint64)
        places = np.concatenate([p for s in np.unique(size) for p in _places(grams[size == s], int(s), most)])
        kinds, words, bits = [np.zeros(len(places), np.int32)], [(places >> np.uint64(6)).astype(np.int64)], [np.uint64(1) << (places & np.uint64(63))]
        kinds.append(np.ones(len(size), np.int32))
        words.append((grams & np.uint64(0xFFFF)).astype(np.int64))
        bits.append(np.uint64(1) << (size - 1).astype(np.uint64))
        kinds.append(np.array([2], np.int32))
        words.append(np.zeros(1, np.int64))
        bits.append(np.array([batch.column("long").to_numpy(zero_copy_only=False).any()], np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kinds)), pa.array(np.concatenate(words)), pa.array(np.concatenate(bits).view(np.int64))], names=["kind", "word", "bits"])


def bloom(grams: DataFrame) -> Filter | None:
    """The filter of ``grams(name, size, gram)``, null without grams. Its words are formed in Spark; at most ``MOST_BITS``
    bits reach the driver, where a filter of few grams is folded to ``BITS_PER_GRAM`` bits each."""
    named = grams.select("size", "gram", (F.octet_length("name") > GRAM).alias("long"))
    marks = named.mapInArrow(_marks, "kind int, word long, bits long").groupBy("kind", "word").agg(F.bit_or("bits").alias("bits")).toArrow()
    kind, word, bits = (marks.column(n).to_numpy() for n in ("kind", "word", "bits"))
    if not len(kind):
        return None
    word0, bits0 = word[kind == 0], bits[kind == 0].view(np.uint64)
    n = int(np.bitwise_count(bits0).sum()) // 2 + 1
    size = int(np.clip(np.ceil(np.log2(n * BITS_PER_GRAM)), 12, np.log2(MOST_BITS)))
    out = np.zeros(1 << (size - 6), np.uint64)
    for i in range(0, len(word0), 1 << 16):
        row, bit = np.nonzero(bits0[i:i + (1 << 16), None] >> np.arange(64, dtype=np.uint64)[None, :] & np.uint64(1))
        place = (word0[i:i + (1 << 16)][row] * 64 + bit) >> (int(np.log2(MOST_BITS)) - size)
        np.bitwise_or.at(out, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
    return Filter(out, size, _starts(word[kind == 1], bits[kind == 1]), bool(bits[kind == 2].any()))


def _starts(prefix: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per two bytes the sizes of the grams that begin with them; a gram of one byte begins with any second byte."""
    out = np.zeros(1 << 16, np.uint8)
    out[prefix] = sizes
    single = np.flatnonzero(out[:256] & 1)
    out[single] &= 0xFE
    for byte in single:
        out[byte::256] |= 1
    return out


def _name_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per distinct gram of a name: all of eight bytes, or the name itself if it is shorter."""
    for batch in batches:
        for first, data, offs in _runs(batch, "name"):
            lengths = np.diff(offs)
            parts = []
            for size in range(1, GRAM + 1):
                rows = np.flatnonzero(lengths == size if size < GRAM else lengths >= size)
                if not len(rows):
                    continue
                grams = _ahead(data, "<u8") & _mask(size)
                count = lengths[rows] - size + 1
                row = np.repeat(rows, count)
                offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                parts.append((row, np.full(len(row), size), offset, grams[offs[row] + offset]))
            if parts:
                row, size, offset, gram = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("name").take(pa.array(first + row)), pa.array(size.astype(np.int32)), pa.array(offset.astype(np.int32)), pa.array(gram.view(np.int64))],
                    names=["name", "size", "offset", "gram"])


def _counted(batches: Iterator[pa.RecordBatch], known: Filter) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, data, offs in _runs(batch, "text"):
            for size, _, _, grams in known.hits(data, offs):
                gram, n = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), size, np.int32)), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], names=["size", "gram", "n"])


def _found(batches: Iterator[pa.RecordBatch], wanted: Filter) -> Iterator[pa.RecordBatch]:
    """``id, size, gram, at, context`` of the places that the filter lets through; equal rows of a text once.

    Grams of eight bytes come with their context and the place of the gram in it, shorter ones stand for whole names.
    """
    for batch in batches:
        for first, data, offs in _runs(batch, "text"):
            raw = data.tobytes() if wanted.long else b""
            for size, row, at, grams in wanted.hits(data, offs):
                context = None
                if size == GRAM and wanted.long:
                    begin, end = np.maximum(offs[row], at - CONTEXT), np.minimum(offs[row + 1], at + size + CONTEXT)
                    kept = {(r, p - b, g, raw[b:e]) for r, p, g, b, e in zip(row.tolist(), at.tolist(), grams.tolist(), begin.tolist(), end.tolist())}
                    row, place, grams, context = (np.array(x) if i < 2 else list(x) for i, x in enumerate(zip(*kept))) if kept else (row, at, grams, None)
                    grams = np.array(grams, np.uint64)
                else:
                    order = np.lexsort((grams, row))
                    row, grams = row[order], grams[order]
                    new = np.ones(len(row), bool)
                    new[1:] = (np.diff(row) != 0) | (grams[1:] != grams[:-1])
                    row, grams = row[new], grams[new]
                    place = np.zeros(len(row), np.int64)
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(pa.array(first + row)), pa.array(np.full(len(row), size, np.int32)), pa.array(grams.view(np.int64)), pa.array(place.astype(np.int32)),
                         pa.array(context if context is not None else [None] * len(row), pa.binary())], names=["id", "size", "gram", "at", "context"])


def occurrences(texts: DataFrame, names: DataFrame, id_col: str, text_col: str, name_col: str = "name") -> DataFrame:
    """(id, name) for every name that occurs anywhere in a text; a pair may come more than once.

    The grams of all names are counted over the texts first. A name with a gram that no text holds is given up; any other one
    is looked for at its gram with the fewest places (then the one that fewest names share). Null and empty texts and names
    give nothing. ``names`` may be any number; the filters stop at ``MOST_BITS``.
    """
    named = names.select(c(name_col).alias("name")).filter(F.length("name") > 0).distinct()
    grams = cut_lineage(named.mapInArrow(_name_grams, "name string, size int, offset int, gram long"))
    id_type = dict(texts.dtypes)[id_col]
    nothing = texts.sparkSession.createDataFrame([], f"`{id_col}` {id_type}, `{name_col}` string")
    known = bloom(grams)
    if known is None:
        return nothing
    own = texts.select(c(id_col).alias("id"), c(text_col).alias("text"))
    counts = own.select("text").mapInArrow(partial(_counted, known=known), "size int, gram long, n long").groupBy("size", "gram").agg(F.sum("n").alias("n"))
    shared = grams.groupBy("size", "gram").agg(F.count("*").alias("names")).join(counts, ["size", "gram"], "left")
    rated = grams.join(shared, ["size", "gram"])
    best = rated.groupBy("name").agg(F.min_by(F.struct("size", "gram", "offset", "n"), F.struct(F.coalesce("n", F.lit(0)), "names", "offset")).alias("x"))
    chosen = cut_lineage(best.select("name", "x.*").filter("n is not null").drop("n"))
    wanted = bloom(chosen)
    if wanted is None:
        return nothing
    hits = own.mapInArrow(partial(_found, wanted=wanted), f"id {id_type}, size int, gram long, at int, context binary")
    met = hits.join(chosen, ["size", "gram"])
    if not wanted.long:
        return met.select(c("id").alias(id_col), c("name").alias(name_col))
    long = F.octet_length("name") > GRAM
    rest = F.octet_length("name") - c("offset") - GRAM
    near = (c("offset") <= CONTEXT) & (rest <= CONTEXT)
    begin = c("at") - c("offset")
    same = (begin >= 0) & (F.substr("context", begin + 1, F.octet_length("name")) == F.encode("name", "UTF-8"))
    sure = met.filter(~long | (near & same)).select("id", "name")
    wide = met.filter(long & ~near).select("id", "name").distinct()
    checked = own.join(wide, "id").filter(F.contains("text", "name")).select("id", "name")
    return sure.union(checked).select(c("id").alias(id_col), c("name").alias(name_col))
