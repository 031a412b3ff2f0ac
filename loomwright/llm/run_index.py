"""Repeated byte strings by a run-length Burrows-Wheeler index.

A ``window``-byte string that starts in a document with a smaller id is removed. Strings are brought together by their
minimizer, the 16-byte part with the smallest hash: consecutive windows with the same minimizer occurrence form one
segment, and equal strings fall into segments with equal minimizers.

Texts are dealt out by hash into packs of about ``PACK_BYTES``. A pack sends its minimizers to buckets as packed arrays
(minimizer, hash of the whole segment, document), and each bucket answers with one byte per segment: gone (an older document
has the same segment), kept (nothing else has the minimizer), or open (the minimizer stands in different segments). Only
open segments travel as bytes, one for each different content and document.

Per bucket, what repeats of the open segments is indexed: suffixes sorted by their first ``window`` bytes (ties by the
smallest document id), their Burrows-Wheeler transform run-compressed, and the document ids sampled where a run or a group
of equal ``window``-byte prefixes begins. All strings are then streamed backwards through the index at once, one byte a
step; a step keeps the interval of suffixes that share the last ``window`` bytes (matching statistics, capped at
``window``). The sample at the head of that interval is the smallest document with the string.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import byte_prefix, document_key, mix, range_hash, text_buffers

GRAM = 16
#: Bytes of text in a pack of documents, and of strings in one index.
PACK_BYTES = 1 << 20
INDEX_BYTES = 4 << 20
#: Buckets of minimizers: at least so many, and more (with packs larger in proportion) when each would get more bytes of text.
BUCKETS = 512
BUCKET_TEXT = 96 << 20

_ORDER_BITS = np.uint64(0xFFFFFFFF00000000)
_PLACE_BITS = np.uint64(0xFFFFFFFF)


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of the 16 bytes from each place on."""
    n = len(data) - GRAM + 1
    eight = np.ndarray((n + 8,), "<u8", np.ascontiguousarray(data), strides=(1,))
    value = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
    value ^= value >> np.uint64(31)
    value += eight[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
    value ^= value >> np.uint64(32)
    value *= np.uint64(0xD6E8FEB86659FD93)
    value ^= value >> np.uint64(29)
    return value


def _minimizers(data: np.ndarray, offs: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    width = window - GRAM + 1
    n = len(data) - window + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    grams = _grams(data)
    # smallest of each run of ``width`` grams, the leftmost of equals: half a hash and the place in one number
    least = (grams & _ORDER_BITS) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:n], least[width - span:width - span + n])
    inside = np.arange(window, n + window) <= np.repeat(offs[1:], np.diff(offs))[:n]
    other = np.ones(n + 1, bool)
    other[1:-1] = (least[1:] != least[:-1]) | ~(inside[1:] & inside[:-1])
    start, end = np.flatnonzero(inside & other[:-1]), np.flatnonzero(inside & other[1:]) + window
    return np.searchsorted(offs, start, "right") - 1, start, end, mix(grams[(least[start] & _PLACE_BITS).astype(np.int64)]), range_hash(byte_prefix(data), start, end)


def minimizers(data: np.ndarray, offs: np.ndarray, window: int, limit: int = 1 << 17) -> tuple[np.ndarray, ...]:
    """Segments of all texts: ``(document, start, end, minimizer, hash of the segment)``.

    Windows from ``start`` to ``end - window`` share a minimizer. Texts go through in runs of about ``limit`` bytes.
    """
    parts, at = [], 0
    while at < len(offs) - 1 or not parts:
        to = min(len(offs) - 1, max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1))
        doc, start, end, h, content = _minimizers(data[offs[at]:offs[to]], offs[at:to + 1] - offs[at], window)
        parts.append((doc + at, start + offs[at], end + offs[at], h, content))
        at = to
    return tuple(np.concatenate(x) for x in zip(*parts))


class RunIndex:
    """Run-length Burrows-Wheeler index of many short strings, in the order of their first ``window`` bytes."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, docs: np.ndarray, window: int):
        """``data`` holds the strings one after the other (``offs``), ``docs`` the smallest document of each."""
        self.window = window
        lengths = np.diff(offs)
        n_strings = len(lengths)
        # codes 1..256 for bytes, 0 for the end of a string; texts with their ends
        text = np.zeros(len(data) + n_strings, np.int16)
        place = np.arange(len(data)) + np.repeat(np.arange(n_strings), lengths)
        text[place] = data.astype(np.int16) + 1
        self.begin = offs[:-1] + np.arange(n_strings)
        self.end = offs[1:] + np.arange(n_strings)  # where the end marks stand
        owner = np.repeat(np.arange(n_strings), lengths + 1)
        rank = self._sorted_ranks(text, window)
        order = np.lexsort((docs[owner], rank))
        ranks, at = rank[order], order
        starts_string = np.zeros(len(text), bool)
        starts_string[self.begin] = True
        previous = np.where(starts_string[at], 0, text[at - 1])
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=257))])
        # runs of the transform, by byte: where each begins, and how many of its byte stand before it
        change = np.concatenate([[True], previous[1:] != previous[:-1]])
        self.run_at = np.flatnonzero(change)
        self.run_byte = previous[self.run_at]
        run_length = np.diff(np.append(self.run_at, len(previous)))
        by = np.lexsort((self.run_at, self.run_byte))
        self.by_byte = np.searchsorted(self.run_byte[by], np.arange(258))
        self.heads, lengths_by = self.run_at[by], run_length[by]
        before = np.concatenate([[0], np.cumsum(lengths_by)])
        self.run_length = lengths_by
        self.before = before[:-1] - before[self.by_byte[self.run_byte[by]]]
        # samples: groups of equal prefixes and the smallest document of each
        head = np.concatenate([[True], ranks[1:] != ranks[:-1]])
        self.group_at = np.flatnonzero(head)
        self.sample = docs[owner[at[self.group_at]]]
        self.size = len(text)

    @staticmethod
    def _sorted_ranks(text: np.ndarray, window: int) -> np.ndarray:
        """Rank of each place by the ``window`` bytes from it on (an end mark closes a string and equals all others).

        Ranks of 6, 12, 24, ... bytes by doubling; a stretch that starts behind an end mark does not count.
        """
        n = len(text)
        marks = np.flatnonzero(text == 0)
        to_end = marks[np.searchsorted(marks, np.arange(n))] - np.arange(n) + 1  # bytes up to and with the end mark
        # the first six at once: nine bits each, nothing behind the end mark
        span = min(6, window)
        padded = np.concatenate([text, np.zeros(span, text.dtype)]).astype(np.int64)
        key = np.zeros(n, np.int64)
        for i in range(span):
            key = key * 512 + np.where(i < to_end, padded[i:i + n] + 1, 0)
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        while span < window:
            step = min(span, window - span)
            following = np.zeros(n, np.int64)
            ok = np.flatnonzero(to_end > step)
            following[ok] = rank[ok + step] + 1
            # the next stretch may overlap this one; equal first stretches make that harmless
            key = rank * (int(following.max()) + 1) + following
            order = np.argsort(key, kind="stable")
            new = np.zeros(n, np.int64)
            new[1:] = np.cumsum(key[order][1:] != key[order][:-1])
            rank = np.empty(n, np.int64)
            rank[order] = new
            span += step
        return rank

    def ranks(self, byte: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each byte stands in the transform before each row."""
        lo, hi = self.by_byte[byte], self.by_byte[byte + 1]
        # last run of the byte that begins before the row: search (byte, row) in the runs by byte
        key = byte.astype(np.int64) * (self.size + 1) + row
        run = np.searchsorted(self._keys(), key, "left") - 1
        none = run < lo
        run = np.where(none, 0, run)
        inside = np.minimum(row - self.heads[run], self.run_length[run])
        return np.where(none | (lo == hi), 0, self.before[run] + inside)

    def _keys(self) -> np.ndarray:
        keys = self.__dict__.get("keys")
        if keys is None:
            by = np.repeat(np.arange(257), np.diff(self.by_byte))
            keys = self.keys = by.astype(np.int64) * (self.size + 1) + self.heads
        return keys

    def widen(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The group of equal ``window``-byte prefixes around a row: its number, first row and end."""
        group = np.searchsorted(self.group_at, row, "right") - 1
        stop = np.append(self.group_at, self.size)[group + 1]
        return group, self.group_at[group], stop

    def stream(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """For every byte of the strings, the smallest document with the ``window`` bytes from it on.

        Meaningful where at least ``window`` bytes are left. The strings must be in the index, so no step comes out empty.
        """
        lengths = np.diff(offs)
        out = np.full(len(data), np.iinfo(np.int64).max)
        order = np.argsort(-lengths, kind="stable")
        n_marks = self.counts[1]
        lo, hi = np.zeros(len(lengths), np.int64), np.full(len(lengths), n_marks, np.int64)
        longest = int(lengths.max()) if len(lengths) else 0
        alive = np.searchsorted(-lengths[order], -np.arange(1, longest + 1), "right")
        for step in range(1, longest + 1):
            some = order[:alive[step - 1]]
            place = offs[some + 1] - step
            byte = data[place].astype(np.int64) + 1
            a = self.counts[byte] + self.ranks(byte, lo[some])
            b = self.counts[byte] + self.ranks(byte, hi[some])
            group, start, stop = self.widen(a)
            # with an end mark inside, all of a group is wanted only if the whole stretch is equal, which its rank says
            lo[some], hi[some] = np.where(step >= self.window, start, a), np.where(step >= self.window, stop, np.maximum(b, a + 1))
            out[place] = self.sample[group]
        return out


class _Pack:
    """The texts of a pack in a defined order, and their segments by bucket."""

    def __init__(self, texts: pa.Table, window: int, buckets: int):
        self.texts = texts.sort_by([("doc_id", "ascending"), ("key", "ascending")])
        self.data, self.offs = text_buffers(self.texts.column("text"))
        self.docs = self.texts.column("doc_id").to_numpy()
        self.doc, self.start, self.end, h, self.content = minimizers(self.data, self.offs, window)
        self.h = (h & _PLACE_BITS).astype(np.uint32)
        bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
        self.order = np.argsort(bucket, kind="stable")
        self.bucket = bucket[self.order]

    def packed(self, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segments in the order of their buckets, the buckets, and where each begins."""
        order, bucket = (self.order, self.bucket) if keep is None else (self.order[keep], self.bucket[keep])
        heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])[:len(bucket)])
        return order, bucket[heads], np.append(heads, len(order))


def _binary(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Rows of packed values: row ``i`` holds the bytes of ``values[edges[i]:edges[i + 1]]``."""
    values = np.ascontiguousarray(values)
    size = values.itemsize * int(np.prod(values.shape[1:]))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer((edges * size).astype(np.int64)), pa.py_buffer(values)]).cast(pa.binary())


def _unpacked(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of packed rows, and where each row begins."""
    data, offs = text_buffers(column)
    return np.frombuffer(data.tobytes(), kind), offs // np.dtype(kind).itemsize


def _anchors(texts: pa.Table, window: int, buckets: int) -> pa.Table:
    """The segments of a pack, one row a bucket. Document ids go as differences in two columns, the upper one mostly zeros."""
    pack = _Pack(texts, window, buckets)
    order, names, edges = pack.packed()
    docs = pack.docs[pack.doc[order]].astype(np.int64).view(np.uint64)
    step = docs.copy()
    step[1:] -= docs[:-1]
    step[edges[:-1]] = docs[edges[:-1]]
    return pa.table({
        "bucket": pa.array(names, pa.int32()), "pack": pa.array(np.full(len(names), texts.column("pack")[0].as_py()), pa.int64()),
        "h": _binary(pack.h[order], edges), "content": _binary(pack.content[order], edges),
        "upper": _binary(step >> np.uint64(16), edges), "lower": _binary((step & np.uint64(0xFFFF)).astype(np.uint16), edges)})


def _answers(rows: pa.Table) -> pa.Table:
    """One byte per segment of a bucket: 0 kept, 1 gone, 2 open."""
    h, edges = _unpacked(rows.column("h"), np.uint32)
    content, _ = _unpacked(rows.column("content"), np.uint64)
    step = (_unpacked(rows.column("upper"), np.uint64)[0] << np.uint64(16)) | _unpacked(rows.column("lower"), np.uint16)[0]
    total = np.cumsum(step, dtype=np.uint64)
    head = edges[:-1]
    docs = (total - np.repeat(total[head] - step[head], np.diff(edges))).view(np.int64)
    order = np.lexsort((docs, content, h))
    hs, cs, ds = h[order], content[order], docs[order]
    new_h = np.concatenate([[True], hs[1:] != hs[:-1]])
    new_c = new_h | np.concatenate([[True], cs[1:] != cs[:-1]])
    heads, group = np.flatnonzero(new_h), np.cumsum(new_h) - 1
    least = ds[np.flatnonzero(new_c)][np.cumsum(new_c) - 1]
    varied = (np.add.reduceat(new_c.astype(np.int64), heads) > 1) & (np.minimum.reduceat(ds, heads) < np.maximum.reduceat(ds, heads))
    answer = np.empty(len(h), np.uint8)
    answer[order] = np.where(ds > least, 1, np.where(varied[group], 2, 0))
    none = pa.nulls(rows.num_rows, pa.int32())
    return pa.table({"pack": rows.column("pack"), "bucket": rows.column("bucket"), "answer": _binary(answer, edges), "number": none, "start": none, "run": none})


def _answered(pack: _Pack, answers: pa.Table) -> np.ndarray:
    """The answers to the segments of a pack, in the order of their buckets."""
    return _unpacked(answers.sort_by("bucket").column("answer"), np.uint8)[0]


def _gathered(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of all stretches one after the other."""
    before = np.cumsum(length) - length
    return data[np.repeat(start - before, length) + np.arange(int(length.sum()))]


def _open(texts: pa.Table, answers: pa.Table, window: int, buckets: int) -> pa.Table:
    """The open segments of a pack, one row a bucket; ``at`` holds text number, start, document id and length of each."""
    none = pa.table({x: pa.array([], t) for x, t in (("bucket", pa.int32()), ("pack", pa.int64()), ("h", pa.binary()), ("at", pa.binary()), ("segments", pa.binary()))})
    if not texts.num_rows or not answers.num_rows:
        return none
    pack = _Pack(texts, window, buckets)
    order, names, edges = pack.packed(_answered(pack, answers) == 2)
    if not len(order):
        return none
    doc, start, length = pack.doc[order], pack.start[order], pack.end[order] - pack.start[order]
    at = np.stack([doc, start - pack.offs[doc], pack.docs[doc], length], axis=1).astype(np.int64)
    return pa.table({
        "bucket": pa.array(names, pa.int32()), "pack": pa.array(np.full(len(names), texts.column("pack")[0].as_py()), pa.int64()),
        "h": _binary(pack.h[order], edges), "at": _binary(at, edges),
        "segments": _binary(_gathered(pack.data, start, length), np.concatenate([[0], np.cumsum(length)])[edges])})


def _flag_runs(flags: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of set flags; a run ends before a place in ``breaks``."""
    new = np.zeros(len(flags) + 1, bool)
    new[breaks] = True
    first = flags & (new[:-1] | ~np.concatenate([[False], flags[:-1]]))
    last = flags & (new[1:] | ~np.concatenate([flags[1:], [False]]))
    return np.flatnonzero(first), np.flatnonzero(last)


def _indexed(rows: pa.Table, window: int) -> pa.Table:
    """Windows of open segments that an older document holds, as runs of window starts ``(pack, number, start, run)``.

    Windows whose hash occurs once cannot match and stay out of the index. Segments with equal minimizers share an index.
    """
    h, edges = _unpacked(rows.column("h"), np.uint32)
    at = _unpacked(rows.column("at"), np.int64)[0].reshape(-1, 4)
    data, _ = text_buffers(rows.column("segments"))
    packs = np.repeat(rows.column("pack").to_numpy(), np.diff(edges))
    begins = np.cumsum(at[:, 3]) - at[:, 3]
    flags = np.zeros(len(data), bool)
    starts = np.flatnonzero(np.arange(len(data)) + window <= np.repeat(begins + at[:, 3], at[:, 3]))
    hashes = range_hash(byte_prefix(data), starts, starts + window)
    by = np.argsort(hashes, kind="stable")
    twin = hashes[by][1:] == hashes[by][:-1]
    flags[starts[by[1:][twin]]] = flags[starts[by[:-1][twin]]] = True
    first, last = _flag_runs(flags, begins)
    owner = np.searchsorted(begins, first, "right") - 1
    length = last - first + window
    order = np.argsort(h[owner], kind="stable")
    first, owner, length = first[order], owner[order], length[order]
    found = []
    total = np.cumsum(length)
    edge = np.flatnonzero(np.concatenate([[True], h[owner][1:] != h[owner][:-1]])[:len(owner)])
    a = 0
    while a < len(owner):
        # whole minimizers up to the size of an index, one at least
        fit = int(np.searchsorted(total, total[a] - length[a] + INDEX_BYTES, "right"))
        cuts = edge[(edge > a) & (edge <= fit)]
        after = edge[edge > a]
        b = len(owner) if fit >= len(owner) else int(cuts[-1]) if len(cuts) else int(after[0]) if len(after) else len(owner)
        strings, lengths, of = _gathered(data, first[a:b], length[a:b]), length[a:b], owner[a:b]
        offs = np.concatenate([[0], np.cumsum(lengths)])
        docs = at[of, 2]
        least = RunIndex(strings, offs, docs, window).stream(strings, offs)
        string = np.repeat(np.arange(b - a), lengths)
        place = np.arange(len(strings))
        gone = (place + window <= offs[1:][string]) & (least < docs[string])
        lo, hi = _flag_runs(gone, offs[:-1])
        which = string[lo]
        start = first[a:b][which] + lo - offs[:-1][which] - begins[of[which]] + at[of[which], 1]
        found.append((packs[of[which]], at[of[which], 0], start, hi - lo + 1))
        a = b
    pack, number, start, run = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 4
    return pa.table({
        "pack": pa.array(pack, pa.int64()), "bucket": pa.nulls(len(pack), pa.int32()), "answer": pa.nulls(len(pack), pa.binary()),
        "number": pa.array(number.astype(np.int32)), "start": pa.array(start.astype(np.int32)), "run": pa.array(run.astype(np.int32))})


def _digest(texts: pa.Table, marks: pa.Table, window: int, buckets: int) -> pa.Table:
    answers, runs = marks.filter(pc.is_valid(marks.column("bucket"))), marks.filter(pc.is_null(marks.column("bucket")))
    pack = _Pack(texts, window, buckets)
    size = len(pack.data) + 1
    change = np.zeros(size, np.int64)
    gone = pack.order[_answered(pack, answers) == 1] if answers.num_rows else np.zeros(0, np.int64)
    begin = pack.offs[runs.column("number").to_numpy()] + runs.column("start").to_numpy()
    for start, end in ((pack.start[gone], pack.end[gone]), (begin, begin + runs.column("run").to_numpy() - 1 + window)):
        change += np.bincount(start.astype(np.int64), minlength=size) - np.bincount(end.astype(np.int64), minlength=size)
    flags = np.cumsum(change)[:-1] > 0
    removed = np.concatenate([[0], np.cumsum(flags)])
    first, _ = _flag_runs(flags, pack.offs[:-1])
    spans = np.diff(np.searchsorted(first, pack.offs))
    kept = pack.data[~flags].tobytes()
    to = pack.offs - removed[pack.offs]
    return pa.table({
        "doc_id": pack.texts.column("out_id"), "n_bytes": pa.array(np.diff(pack.offs)), "n_removed": pa.array(np.diff(removed[pack.offs])),
        "n_spans": pa.array(spans), "kept_sha256": [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(to[:-1].tolist(), to[1:].tolist())]})


def remove_older(docs: DataFrame, window: int = 50) -> DataFrame:
    """Digest of ``documents`` without the bytes of strings that start in a document with a smaller id: the op7 columns.

    Texts are UTF-8 bytes, null is empty; matches stay inside one document; strings are judged on the input. A null id is
    smaller than any other. Rows with the same id are not older than one another; an empty table gives no rows; other
    columns are not read.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(BUCKETS, -(-size // BUCKET_TEXT))
    packs = max(1, size // (PACK_BYTES * buckets // BUCKETS))
    key = document_key(docs)
    texts = docs.select(
        F.pmod(F.xxhash64(key), F.lit(packs)).alias("pack"), key.alias("key"), F.col("doc_id").alias("out_id"),
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    by_pack = texts.groupBy("pack")
    marks = "pack long, bucket int, answer binary, number int, start int, run int"
    anchors = by_pack.applyInArrow(lambda rows: _anchors(rows, window, buckets), "bucket int, pack long, h binary, content binary, upper binary, lower binary")
    answers = anchors.groupBy("bucket").applyInArrow(_answers, marks)
    segments = by_pack.cogroup(answers.groupBy("pack")).applyInArrow(lambda rows, found: _open(rows, found, window, buckets), "bucket int, pack long, h binary, at binary, segments binary")
    older = segments.groupBy("bucket").applyInArrow(lambda rows: _indexed(rows, window), marks)
    return by_pack.cogroup(answers.unionByName(older).groupBy("pack")).applyInArrow(
        lambda rows, found: _digest(rows, found, window, buckets), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
