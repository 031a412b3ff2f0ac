"""Near-duplicate documents by MinHash bands and odd sketches.

A document's set is its distinct word shingles. MinHash samples are banded for candidates and folded into a parity bitmap
(odd sketch); the population count of the XOR of two bitmaps estimates their similarity precisely when it is high. Pairs that
pass meet a second, wider sketch of the (thinned) set itself before any full set is read. Inside
a bucket only spanning forests of likely links leave the task (best estimates first; one, then eight, ...), and links are
confirmed on the full sets. Rounds go on until no likely pair of one bucket lies in two components untested; a group of
near copies that hang together sends links in proportion to its members, not to their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import blocks, cut, document_key, lower_ascii, mix, prefix_hash, range_hash, word_hashes, word_spans

BANDS = 24
ROWS = 4
SAMPLES = 192
BITS = 512
FINE = 1024
FINE_BITS = 2048
#: Estimates this far under the threshold (four standard deviations of SAMPLES samples) are still confirmed exactly.
SLACK = 0.115
#: Members of a bucket that one task compares; larger buckets are cut into pairs of blocks.
BLOCK = 4096
MAX_ROUNDS = 30
#: Each round sends this many times the forests of the round before, so few rounds are needed where many likely pairs fail.
GROWTH = 8

_RNG = np.random.default_rng(9)
_A = _RNG.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_ORDER = mix(np.arange(SAMPLES, dtype=np.uint64) + np.uint64(77))


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each document's shingles of ``n`` lower-cased words (all words, if fewer)."""
    data = lower_ascii(data)
    starts, ends, first = word_spans(data, offs)
    prefix = prefix_hash(word_hashes(data, starts, ends))
    all_at = np.arange(max(0, len(starts) - n + 1))
    every = range_hash(prefix, all_at, all_at + n)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= n:
            out.append(np.unique(every[a:b - n + 1]))
        elif b > a:
            out.append(range_hash(prefix, np.array([a]), np.array([b])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """SAMPLES minima of a non-empty set, 32 bits each."""
    lowest = np.full(SAMPLES, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 1024):
        part = shingles[at:at + 1024]
        np.minimum(lowest, (_A[:, None] * part[None, :] + _B[:, None]).min(axis=1), out=lowest)
    return lowest


def odd_sketch(minima: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples, as BITS / 8 bytes."""
    bits = np.bincount((mix(minima ^ _ORDER) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(bits.astype(np.uint8))


def estimate(ones: np.ndarray) -> np.ndarray:
    """Similarity from the population count of the XOR of two sketches."""
    inside = np.maximum(1 - 2 * ones / BITS, 1e-9)
    return 1 + BITS / (4 * SAMPLES) * np.log(inside)


def fine_sketch(shingles: np.ndarray) -> bytes:
    """Parity bitmaps of the set itself, thinned by powers of two to FINE members at most, at that power and the next.

    Sets of high similarity differ in size by little, so two of them have a power in common. Layout: the power, then per
    power the number of members left (32 bits each), then the two bitmaps.
    """
    power = max(0, int(np.ceil(np.log2(max(len(shingles), 1) / FINE))))
    spread = mix(shingles ^ np.uint64(0x5DEECE66D))
    counts, maps = [], []
    for p in (power, power + 1):
        left = spread[(spread & np.uint64((1 << p) - 1)) == 0]
        bits = np.bincount((mix(left) % np.uint64(FINE_BITS)).astype(np.int64), minlength=FINE_BITS) & 1
        counts.append(len(left)), maps.append(np.packbits(bits.astype(np.uint8)).tobytes())
    return np.array([power, *counts, 0], np.uint32).tobytes() + b"".join(maps)


def possible(words: np.ndarray, left: np.ndarray, right: np.ndarray, share: float) -> np.ndarray:
    """Whether pairs of fine sketches (rows of 64-bit words) can reach the similarity ``share``, give or take five standard
    deviations of the parity counts and of the thinning."""
    heads = words[:, :2].copy().view(np.uint32).astype(np.int64)
    width = FINE_BITS // 64
    power = np.maximum(heads[left, 0], heads[right, 0])
    ok = np.abs(heads[left, 0] - heads[right, 0]) <= 1
    l_second, r_second = power - heads[left, 0], power - heads[right, 0]
    out = np.zeros(len(left), bool)
    at = np.flatnonzero(ok)
    for a in range(0, len(at), 1 << 15):
        i = at[a:a + (1 << 15)]
        column = np.arange(width)[None, :]
        x = words[left[i, None], 2 + l_second[i, None] * width + column]
        y = words[right[i, None], 2 + r_second[i, None] * width + column]
        ones = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        size = heads[left[i], 1 + l_second[i]] + heads[right[i], 1 + r_second[i]]
        apart = size * (1 - share) / (1 + share)  # members in one set only, at the threshold
        thin = np.where(power[i] > 0, np.sqrt(np.maximum(size, 1)), 0.0)
        limit = apart + 5 * thin * (1 - share)
        decay = np.exp(-2 * limit / FINE_BITS)
        noise = np.sqrt(np.maximum(FINE_BITS / 4 * (1 - decay ** 2) - limit * decay ** 2, 0))
        # equal parities hide members but never invent them: the count cannot pass the true difference
        out[i] = ones <= np.minimum(limit + 1e-9, FINE_BITS / 2 * (1 - decay) + 5 * noise + 1)
    return out


def _signatures(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offs in blocks(batch, "text"):
            sizes, sets, bands, sketches = [], [], [], []
            for shingles in shingle_sets(data, offs, n):
                sizes.append(len(shingles))
                if not len(shingles):
                    sets.append(None), bands.append(None), sketches.append(None)
                    continue
                minima = min_hashes(shingles)
                spread = mix(shingles)
                sets.append(shingles.sum(dtype=np.uint64).tobytes() + spread.sum(dtype=np.uint64).tobytes() + len(shingles).to_bytes(4, "little"))
                rows = minima[:BANDS * ROWS].reshape(BANDS, ROWS)
                keys = np.arange(BANDS, dtype=np.uint64)
                for r in range(ROWS):
                    keys = mix(keys * np.uint64(31) + rows[:, r])
                bands.append(keys.view(np.int64))
                sketches.append(odd_sketch(minima).tobytes() + fine_sketch(shingles))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("key"), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                names=["doc_id", "key", "n_shingles", "set_key", "bands", "sketch"],
            )


def _forests(pairs: list[list], label: np.ndarray, count: int) -> list[list]:
    """The pairs in ``count`` edge-disjoint spanning forests over the labels, best score first (ties to the earlier pair)."""
    left, right, score = (np.array(x) for x in pairs)
    rest = np.lexsort((right, left, -score)).tolist()
    roots_a, roots_b = label[left].tolist(), label[right].tolist()
    kept: list[int] = []
    for _ in range(count):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        taken, over = [], []
        for i in rest:
            a, b = root(roots_a[i]), root(roots_b[i])
            if a != b:
                parent[max(a, b)] = min(a, b)
                taken.append(i)
            else:
                over.append(i)
        kept += taken
        rest = over
        if not rest or not taken:
            break
    return [[column[i] for i in kept] for column in pairs]


def _likely_pairs(words: np.ndarray, label: np.ndarray, starts: np.ndarray, sizes: np.ndarray, share: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of one group with different labels and a high estimate, found in vectors over many groups at a time."""
    for k in np.unique(sizes[(sizes > 1) & (sizes <= 64)]).tolist():
        of_size = starts[sizes == k]
        i, j = np.triu_indices(k, 1)
        step = max(1, (1 << 18) // len(i))
        for at in range(0, len(of_size), step):
            left = (of_size[at:at + step, None] + i[None, :]).ravel()
            right = (of_size[at:at + step, None] + j[None, :]).ravel()
            yield _keep(words, label, left, right, share)
    for start, size in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist()):
        for x in range(start, start + size - 1):
            right = np.arange(x + 1, start + size)
            yield _keep(words, label, np.full(len(right), x), right, share)


def _keep(words: np.ndarray, label: np.ndarray, left: np.ndarray, right: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    differ = label[left] != label[right]
    left, right = left[differ], right[differ]
    coarse = BITS // 64
    near = estimate(np.bitwise_count(words[left, :coarse] ^ words[right, :coarse]).sum(axis=1, dtype=np.int64))
    high = near >= share - SLACK
    left, right, near = left[high], right[high], near[high]
    likely = possible(words[:, coarse:], left, right, share)
    return left[likely], right[likely], near[likely]


def _bucket_links(batches: Iterator[pa.RecordBatch], share: float, forests: int) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the likely, untested links between components in each bucket (or pair of its blocks).

    Rows come sorted by bucket; a bucket that goes on in the next batch is carried over, and holds 2 * BLOCK rows at most.
    """
    carried: pa.Table | None = None

    def links(table: pa.Table) -> pa.RecordBatch:
        get = lambda name: table.column(name).combine_chunks().to_numpy(zero_copy_only=False)
        rep, label = get("rep"), get("component")
        change = np.zeros(len(rep), bool)
        for name in ("band", "lo", "hi"):
            values = get(name)
            change[1:] |= values[1:] != values[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change)])
        sizes = np.diff(np.concatenate([starts, [len(rep)]]))
        words = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(rep), -1)
        failed = table.column("failed").to_pylist()
        group = np.repeat(np.arange(len(starts)), sizes)
        found: dict[int, list[list]] = {}
        for left, right, score in _likely_pairs(words, label, starts, sizes, share):
            for x, y, s in zip(left.tolist(), right.tolist(), score.tolist()):
                if not (failed[x] and rep[y] in failed[x]):
                    mine = found.setdefault(int(group[x]), [[], [], []])
                    mine[0].append(x), mine[1].append(y), mine[2].append(s)
                    if len(mine[0]) > 2 * forests * 2 * BLOCK + 100_000:  # the forests of what was seen stand for it
                        found[int(group[x])] = _forests(mine, label, forests)
        out: list[tuple[int, int]] = []
        for g, mine in found.items():
            if len(mine[0]) > forests * (sizes[g] - 1) or forests == 1 and len(mine[0]) > 1:
                mine = _forests(mine, label, forests)
            out += zip(rep[mine[0]].tolist(), rep[mine[1]].tolist())
        lows, highs = [min(p) for p in out], [max(p) for p in out]
        return pa.RecordBatch.from_arrays([pa.array(lows, pa.int64()), pa.array(highs, pa.int64())], names=["a", "b"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if carried is None else pa.concat_tables([carried, table])
        keys = np.stack([table.column(x).combine_chunks().to_numpy(zero_copy_only=False) for x in ("band", "lo", "hi")])
        last = int(np.argmax((keys == keys[:, -1:]).all(axis=0))) if table.num_rows else 0
        if last:
            yield links(table.slice(0, last))
        carried = table.slice(last)
    if carried is not None and carried.num_rows:
        yield links(carried)


def _confirm(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sides = []
            for name in ("text_a", "text_b"):
                sides.append([s for _, data, offs in blocks(part, name) for s in shingle_sets(data, offs, n)])
            linked = []
            for x, y in zip(*sides):
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(linked)], names=["a", "b", "linked"])


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(rep, component)``: the smallest rep reachable over ``edges(a, b)``. ``nodes`` has ``rep``.

    Each round every root hooks onto the smallest root next to it and paths are halved by joining the labels with
    themselves, so long chains take a logarithmic number of rounds. Rows per round: one per node that has an edge.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "rep"))
    while True:
        l, r = label.alias("l"), label.alias("r")
        seen = both.join(r.select(F.col("rep").alias("b"), F.col("component").alias("other")), "b").groupBy("a").agg(F.min("other").alias("near"))
        lower = l.join(seen.withColumnRenamed("a", "rep"), "rep").select("rep", "component", F.least("component", "near").alias("low"))
        # the old root learns the smallest label seen by any of its members
        hooks = lower.groupBy(F.col("component").alias("root")).agg(F.min("low").alias("root_low"))
        hooked = lower.join(hooks, F.col("component") == F.col("root")).select("rep", "component", F.least("low", "root_low").alias("new"))
        jump = hooks.select(F.col("root").alias("new"), F.col("root_low").alias("jumped"))
        following = cut(hooked.join(jump, "new", "left").select("rep", "component", F.least("new", F.coalesce("jumped", "new")).alias("new")))
        changed = following.filter("new <> component").limit(1).count()
        label = following.select("rep", F.col("new").alias("component"))
        if not changed:
            return nodes.select("rep").join(label, "rep", "left").select("rep", F.coalesce("component", "rep").alias("component"))


def near_duplicates(docs: DataFrame, n: int = 4, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, key, n_shingles, component_id, kept``.

    Rows with the same id and text share a ``key``. Documents whose intersection is at least ``percent`` per cent of the
    union are linked; ``component_id`` is the smallest linked id. Null or wordless texts have no shingle and are alone.
    Equal sets are one class from the start (their smallest id stands for them). A null id counts as the smallest long
    when ids are compared, and comes back as null ``component_id``. An empty table gives no rows.

    Misses: a pair at the threshold is in no common band with probability (1 - 0.8 ** ROWS) ** BANDS = 4e-6 and has
    too low an estimate with about 3e-5.
    """
    keyed = docs.select("doc_id", document_key(docs).alias("key"), "text").withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    schema = "doc_id long, key long, n_shingles long, set_key binary, bands array<long>, sketch binary"
    signed = cut(keyed.mapInArrow(partial(_signatures, n=n), schema))
    classes = cut(
        signed.filter("set_key is not null").groupBy("set_key")
        .agg(F.min(F.struct("doc_id", "key", "bands", "sketch")).alias("first"))
        .select("set_key", F.col("first.doc_id").alias("rep"), F.col("first.key").alias("key"), "first.bands", "first.sketch")
    )
    # two classes of one id (repeated ids) share rep; they are one node, linked by having the same smallest id
    banded = classes.select("rep", F.explode("bands").alias("band"))
    counted = banded.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    shared = cut(banded.join(counted, "band"))
    nodes = cut(classes.join(shared.select("rep").distinct(), "rep", "left_semi").select("rep", "key", "sketch"))
    # the list of nodes grows with the corpus: meet the texts in a shuffle at every size
    texts = keyed.select(F.col("doc_id").alias("rep"), "key", "text").join(nodes.select("rep", "key").hint("merge"), ["rep", "key"], "left_semi")
    texts = cut(texts.groupBy("rep", "key").agg(F.first("text").alias("text")))
    dealt = shared.withColumn("nb", F.ceil(F.col("size") / BLOCK)).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("nb")))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    grouped = paired.select("rep", "band", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi")).join(nodes.select("rep", "sketch"), "rep")
    label = nodes.select("rep").distinct().withColumn("component", F.col("rep"))
    links, failed = None, None
    for turn in range(MAX_ROUNDS):
        if links is None:
            members = grouped.withColumns({"component": F.col("rep"), "failed": F.lit(None).cast("array<long>")})
        else:
            members = grouped.join(label, "rep").join(failed, "rep", "left")
        bucket = Window.partitionBy("band", "lo", "hi")
        mixed = members.withColumns({"_low": F.min("component").over(bucket), "_high": F.max("component").over(bucket)}).filter("_low <> _high")
        picked = mixed.select("band", "lo", "hi", "rep", "component", "sketch", "failed").mapInArrow(
            partial(_bucket_links, share=percent / 100, forests=GROWTH ** turn), "a long, b long")
        pairs = cut(picked.distinct())
        if pairs.limit(1).count() == 0:
            break
        a, b = (texts.select(F.col("rep").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
        checked = cut(pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(
            partial(_confirm, n=n, percent=percent), "a long, b long, linked boolean"))
        links = checked if links is None else links.union(checked)
        label = components(nodes.select("rep").distinct(), links.filter("linked"))
        apart = links.filter("not linked")
        failed = apart.select("a", "b").union(apart.select("b", "a")).groupBy(F.col("a").alias("rep")).agg(F.collect_set("b").alias("failed"))
    else:
        raise RuntimeError("near-duplicate rounds did not settle")
    named = classes.select("set_key", "rep").join(label, "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "key", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.coalesce("component", "doc_id")
    missing = F.lit(-(1 << 63))
    return out.select(
        F.nullif("doc_id", missing).alias("doc_id"), "key", "n_shingles", F.nullif(component, missing).alias("component_id"),
        (F.col("doc_id") == component).alias("kept"),
    )
