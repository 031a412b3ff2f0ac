"""Fill-in-middle by secondary sort: documents leave as pieces keyed by document and place in the output.

The exchange by document and the sort by place (``repartitionAndSortWithinPartitions`` in its DataFrame form) bring the
pieces in output order, and a task feeds them one by one into a digest. A reader that knows only the output and its form
names each run of bytes by its place in the text; a second sort inside the same partitions restores the order. No task ever
puts a document together, and texts cross the network once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import blocks

#: Bytes of a piece; pieces hold whole units, so one longer unit is a longer piece.
PIECE_BYTES = 1 << 16
SEED = 1
PLAIN_FROM = 90
SPM_BELOW = 20
# The marks, and the order in which each form writes its sections.
MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
ORDER = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
SECTIONS = ("prefix", "middle", "suffix")

FACTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long"
PIECES = f"row long, at int, data binary, {FACTS}"
RESTORED = f"row long, section int, at int, data binary, output_sha256 string, {FACTS}"
RESULT = f"{FACTS}, output_sha256 string, restored_sha256 string"


def unit_starts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the units (runs of A-Z and a-z, else single code points), and of the code points."""
    folded = data | 32
    letter = (folded >= 97) & (folded <= 122) & (data < 128)
    behind = np.zeros(len(data) + 1, bool)
    behind[1:] = np.append(letter[1:] & letter[:-1], False) if len(data) else False
    behind[offs] = False
    point = (data & 0xC0) != 0x80
    return np.flatnonzero(point & ~behind[:-1]), np.flatnonzero(point)


def choice(doc_id: int | None, n: int, marked: bool) -> tuple[str, int, int]:
    """Form of a document of ``n`` units, and the units after which its prefix and its middle end."""
    digest = hashlib.sha256(f"{SEED}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not n or marked or h3 % 100 >= PLAIN_FROM:
        return "plain", first, second
    return ("spm" if h4 % 100 < SPM_BELOW else "psm"), first, second


def _chunks(starts: np.ndarray, begin: int, end: int, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole units of about ``limit`` bytes; ``starts`` are the document's units."""
    while begin < end:
        k = int(np.searchsorted(starts, begin + limit))
        to = min(end, int(starts[k])) if k < len(starts) else end
        yield begin, to
        begin = to


def _pieces(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("row", pa.int64()), ("at", pa.int32()), ("data", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())])
    for batch in batches:
        for rows, data, offs in blocks(batch, "text"):
            units, points = unit_starts(data, offs)
            edges, raw, out = np.searchsorted(units, offs), data.tobytes(), []
            for i, (row, doc_id) in enumerate(zip(rows.column("row").to_pylist(), rows.column("doc_id").to_pylist())):
                a, z = int(offs[i]), int(offs[i + 1])
                own = units[edges[i]:edges[i + 1]]
                n = len(own)
                marked = any(raw.find(m, a, z) >= 0 for m in MARKS.values())
                form, first, second = choice(doc_id, n, marked)
                p, m = (int(own[k]) if k < n else z for k in (first, second))
                if form == "plain":
                    facts, parts = (doc_id, n, form, None, None), [(b"", a, z)]
                else:
                    counts = np.diff(np.searchsorted(points, (a, p, m))).tolist()
                    facts = (doc_id, n, form, *counts)
                    ends = {"prefix": (a, p), "middle": (p, m), "suffix": (m, z)}
                    parts = [(MARKS[s], *ends[s]) for s in ORDER[form]]
                at = 0
                for mark, begin, end in parts:
                    for x, y in _chunks(own, begin, end, limit) if begin < end else ((begin, begin),):
                        out.append((row, at, (mark if x == begin else b"") + raw[x:y], *(facts if not at else (None,) * 5)))
                        at += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)


class Reader:
    """Takes an output in pieces and gives back ``(section, bytes)``; it knows the form and nothing else of the document."""

    def __init__(self, form: str):
        self.left = [(SECTIONS.index(s), MARKS[s]) for s in ORDER.get(form, ())]
        self.section, self.held = 0, b""

    def feed(self, data: bytes, last: bool = False) -> Iterator[tuple[int, bytes]]:
        data = self.held + data
        while self.left and (found := data.find(self.left[0][1])) >= 0:
            if found:
                yield self.section, data[:found]
            self.section, mark = self.left.pop(0)
            data = data[found + len(mark):]
        keep = 2 if self.left and not last else 0  # a mark may go on in the next piece
        self.held = data[len(data) - keep:] if keep else b""
        data = data[:len(data) - keep] if keep else data
        if data:
            yield self.section, data


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in output order become runs of bytes named by section, and one row with the digest of the whole output."""
    schema = pa.schema([("row", pa.int64()), ("section", pa.int32()), ("at", pa.int32()), ("data", pa.binary()), ("output_sha256", pa.string()), ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())])
    nothing = (None,) * 5
    now, at, facts, digest, reader = None, 0, nothing, None, None

    def close() -> Iterator[tuple]:
        nonlocal at
        for section, run in reader.feed(b"", last=True):
            yield now, section, at, run, None, *nothing
            at += 1
        yield now, len(SECTIONS), 0, b"", digest.hexdigest(), *facts

    def table(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        out = []
        for row, data, *fields in zip(*(batch.column(c).to_pylist() for c in ("row", "data", "doc_id", "n", "form", "prefix_chars", "middle_chars"))):
            if row != now:
                if now is not None:
                    out += close()
                now, at, facts, digest, reader = row, 0, tuple(fields), hashlib.sha256(), Reader(fields[2])
            digest.update(data)
            for section, run in reader.feed(data):
                out.append((now, section, at, run, None, *nothing))
                at += 1
        if out:
            yield table(out)
    if now is not None:
        yield table(list(close()))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of bytes in text order go into a digest; the row that closes a document carries the rest."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())])
    digest = hashlib.sha256()
    for batch in batches:
        out = []
        for section, data, sha, *facts in zip(*(batch.column(c).to_pylist() for c in ("section", "data", "output_sha256", "doc_id", "n", "form", "prefix_chars", "middle_chars"))):
            digest.update(data)
            if section == len(SECTIONS):
                out.append((*facts, sha, digest.hexdigest()))
                digest = hashlib.sha256()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)


def output_pieces(docs: DataFrame) -> DataFrame:
    """The transformed documents as pieces: ``row, at, data`` by document and place, with the document's facts in its first.

    ``docs`` has ``doc_id`` and ``text``. ``row`` numbers the rows of the plan, so repeated ids, equal rows and null ids are
    documents of their own (a null id is drawn for as ``1:null``); ``docs`` must give the same rows in the same order when a
    task is run again, as files do. Null text is the empty text, which is one empty piece; an empty table gives no rows;
    other columns are not read. A very long text is many pieces; all go to one task, which holds one at a time.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_pieces, limit=PIECE_BYTES), PIECES).repartition("row").sortWithinPartitions("row", "at")


def outputs(docs: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``: every transformed text as one value, put together by Spark."""
    facts = [F.first(c, ignorenulls=True).alias(c) for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars")]
    joined = F.decode(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", F.hex("data").alias("data")))), lambda x: x["data"]), "")), "UTF-8")
    return output_pieces(docs).groupBy("row").agg(*facts, joined.alias("output")).drop("row")


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """Facts of every document with the digests of its output and of the text restored from it; the columns of op13.

    ``n`` counts units. Cases as in :func:`output_pieces`.
    """
    restored = output_pieces(docs).mapInArrow(_restored, RESTORED).sortWithinPartitions("row", "section", "at")
    return restored.mapInArrow(_digests, RESULT)
