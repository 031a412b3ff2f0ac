"""Toxicity by a factorization machine over hashed terms.

The score of a text is the logistic of ``w0 + sum(w_i) + sum over pairs of <v_i, v_j>`` over its distinct hashed terms that
the model holds. Pairs count only for terms seen together, so an insult beside a group's name can weigh more than the two
alone. The machine is fitted on at most ``FIT_ROWS`` labelled rows (a documented bound): document frequencies by label,
counted in Spark, choose the terms, and the rows reach the driver as short lists of term numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import blocks, mix, word_hashes

BUCKETS = 1 << 20
#: Terms in the model: those whose frequencies differ most between the labels (chi-square).
TERMS = 4096
LEAST_CHI = 12.0
FACTORS = 8
#: Labelled rows that the machine is fitted on: the first by a hash of the id. Their ids are broadcast (16 bytes each).
FIT_ROWS = 40_000
EPOCHS = 10
#: Updates made at least, by more epochs over few rows.
LEAST_STEPS = 3000
BATCH = 256
RATE = 0.05
DECAY = 1e-4
SEED = 2
THRESHOLD = 0.3


def terms_of(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct hashed terms of each text: lower-cased runs of letters (all bytes over 0x7F count as letters)."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    breaks = np.zeros(len(low) + 1, bool)
    breaks[offs] = True
    starts = np.flatnonzero(letter & (breaks[:-1] | ~np.concatenate([[False], letter[:-1]]))) if len(low) else np.zeros(0, np.int64)
    ends = np.flatnonzero(letter & (breaks[1:] | ~np.concatenate([letter[1:], [False]]))) + 1 if len(low) else np.zeros(0, np.int64)
    codes = (word_hashes(low, starts, ends) % np.uint64(BUCKETS)).astype(np.int32)
    first = np.searchsorted(starts, offs)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    pairs = np.unique(doc.astype(np.int64) * BUCKETS + codes)
    cuts = np.searchsorted(pairs, np.arange(len(offs)) * BUCKETS)
    return [pairs[a:b] % BUCKETS for a, b in zip(cuts[:-1], cuts[1:])]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per term and label among the rows of a task, and the number of documents under term -1."""
    counts = np.zeros((2, BUCKETS), np.int64)
    docs = np.zeros(2, np.int64)
    for batch in batches:
        for part, data, offs in blocks(batch, "text"):
            for label, terms in zip(part.column("label").to_pylist(), terms_of(data, offs)):
                counts[label, terms] += 1
                docs[label] += 1
    used = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(used, -1)), pa.array(np.append(counts[0, used], docs[0])), pa.array(np.append(counts[1, used], docs[1]))], names=["term", "clean", "toxic"])


def _numbered(batches: Iterator[pa.RecordBatch], chosen: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offs in blocks(batch, "text"):
            rows = []
            for terms in terms_of(data, offs):
                at = np.searchsorted(chosen, terms)
                rows.append(at[(at < len(chosen)) & (chosen[np.minimum(at, len(chosen) - 1)] == terms)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(rows, pa.list_(pa.int32()))], names=["label", "terms"])


class Machine:
    """Weights over term numbers. Plain data, small enough for every task (TERMS * (FACTORS + 1) numbers)."""

    def __init__(self, chosen: np.ndarray, bias: float = 0.0):
        self.chosen = chosen
        self.bias = bias
        self.linear = np.zeros(len(chosen))
        self.factors = np.random.default_rng(SEED).normal(0, 0.01, (len(chosen), FACTORS))

    def margin(self, flat: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margins of many rows given as one run of term numbers, and each row's sum of factors."""
        n = len(cuts) - 1
        row = np.repeat(np.arange(n), np.diff(cuts))
        total = self.bias + np.bincount(row, self.linear[flat], minlength=n)
        v = self.factors[flat]
        sums = np.stack([np.bincount(row, v[:, f], minlength=n) for f in range(FACTORS)], axis=1) if n else np.zeros((0, FACTORS))
        squares = np.bincount(row, (v ** 2).sum(axis=1), minlength=n)
        return total + 0.5 * ((sums ** 2).sum(axis=1) - squares), sums

    def fit(self, rows: list[np.ndarray], labels: np.ndarray) -> None:
        """Adagrad on the logistic loss."""
        rng = np.random.default_rng(SEED)
        speed_w, speed_v, speed_b = np.full(len(self.chosen), 1e-8), np.full(self.factors.shape, 1e-8), 1e-8
        steps = max(1, -(-len(rows) // BATCH))
        for _ in range(max(EPOCHS, -(-LEAST_STEPS // steps))):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                pick = order[at:at + BATCH]
                flat = np.concatenate([rows[i] for i in pick]) if len(pick) else np.zeros(0, np.int32)
                cuts = np.concatenate([[0], np.cumsum([len(rows[i]) for i in pick])])
                margin, sums = self.margin(flat, cuts)
                slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[pick]) / len(pick)
                row = np.repeat(np.arange(len(pick)), np.diff(cuts))
                used, where = np.unique(flat, return_inverse=True)
                grad_w = np.bincount(where, slope[row], minlength=len(used)) + DECAY * self.linear[used]
                each = slope[row, None] * (sums[row] - self.factors[flat])
                grad_v = np.stack([np.bincount(where, each[:, f], minlength=len(used)) for f in range(FACTORS)], axis=1) + DECAY * self.factors[used]
                speed_w[used] += grad_w ** 2
                speed_v[used] += grad_v ** 2
                speed_b += slope.sum() ** 2
                self.linear[used] -= RATE * grad_w / np.sqrt(speed_w[used])
                self.factors[used] -= RATE * 0.2 * grad_v / np.sqrt(speed_v[used])
                self.bias -= RATE * slope.sum() / np.sqrt(speed_b)

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        rows = []
        for terms in texts:
            at = np.searchsorted(self.chosen, terms)
            rows.append(at[(at < len(self.chosen)) & (self.chosen[np.minimum(at, len(self.chosen) - 1)] == terms)] if len(self.chosen) else at[:0])
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        margin, _ = self.margin(flat.astype(np.int64), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def train(labelled: DataFrame) -> Machine:
    """Fit on ``labelled`` (``doc_id, text, label`` with label 0 or 1); no rows, or one label only, give a constant score."""
    counts = labelled.select("text", "label").mapInArrow(_frequencies, "term long, clean long, toxic long")
    table = counts.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    size = table.filter("term = -1").first()
    clean, toxic = (float(size["clean"]), float(size["toxic"])) if size else (0.0, 0.0)
    if not clean or not toxic:
        return Machine(np.zeros(0, np.int64), bias=30.0 if toxic else -30.0)
    a, b = F.col("toxic") + 0.0, F.col("clean") + 0.0
    n, df = clean + toxic, F.col("toxic") + F.col("clean")
    chi = F.lit(n) * (a * (F.lit(clean) - b) - b * (F.lit(toxic) - a)) ** 2 / (F.lit(clean * toxic) * df * (F.lit(n) - df))
    best = table.filter("term >= 0").withColumn("chi", F.when(df < n, chi)).filter(F.col("chi") >= LEAST_CHI).orderBy(F.desc("chi"), "term").limit(TERMS)
    chosen = np.array(sorted(r["term"] for r in best.select("term").collect()), np.int64)
    machine = Machine(chosen, bias=float(np.log(toxic / clean)))
    if not len(chosen):
        return machine
    rows = labelled.select("text", "label").mapInArrow(partial(_numbered, chosen=chosen), "label int, terms array<int>").collect()
    machine.fit([np.array(r["terms"], np.int64) for r in rows], np.array([r["label"] for r in rows], np.float64))
    return machine


def _scores(batches: Iterator[pa.RecordBatch], machine: Machine) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offs in blocks(batch, "text"):
            kept = [part.column(i) for i in range(part.num_columns)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(machine.score(terms_of(data, offs)))], names=[*part.schema.names, "score"])


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``docs`` with ``score`` from 0 to 1 (a column of that name is replaced). Null and empty texts have no terms and get
    the score of the bias; repeated rows get equal scores; all columns are kept."""
    plain = docs.drop("score")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(partial(_scores, machine=machine), f"{kinds}, score double")


def training_rows(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2) -> DataFrame:
    """At most FIT_ROWS labelled ids outside the held-out part, with their texts. Several labels of one id count as toxic if
    any is; null labels are none. Texts stay where they are read; only the bounded list of ids travels."""
    of = labels.filter("toxic in (0, 1)").filter(~in_part("doc_id", modulus, held_out)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    chosen = of.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def in_part(name: str, modulus: int, remainder: int):
    """Whether crc32 of the id as text has the remainder; null ids are in no part."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of the op2 query: every document with its score, learned from the rows outside the held-out quarter."""
    machine = train(training_rows(docs, labels))
    scored = score(docs.select("doc_id", "text", in_part("doc_id", 4, 2).alias("held_out")), machine)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
