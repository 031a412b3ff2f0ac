"""Pieces shared by the corpus operators: words and hashes over Arrow buffers, and written cuts of the lineage.

Words are maximal runs of bytes other than space and 0x09-0x0D. Hash values are 64 bits wide; where two values must not
be mixed up, operators use a second, independent one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.session import _ensure_checkpoint_dir, configure

WORD = "[^\\x20\\x09-\\x0D]+"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = [np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) for seed in (11, 12)]
_POWERS: dict[str, np.ndarray] = {}


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back; any executor may be lost."""
    spark = configure(df.sparkSession)
    _ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def word_count(text: Column) -> Column:
    """Number of words; null counts as the empty text."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of the hash base, or of its inverse, modulo 2**64."""
    name = "inverse" if inverse else "base"
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        factors = np.full(max(n, 1 << 16), _INVERSE if inverse else _BASE, np.uint64)
        factors[0] = 1
        have = _POWERS[name] = np.cumprod(factors, dtype=np.uint64)
    return have[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums; :func:`range_hash` reads the hash of any range from them."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the values in ``[start, end)``; equal contents have equal hashes wherever they stand."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix), inverse=True)[starts])


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the offsets of the texts. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def blocks(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of whole rows with about ``limit`` bytes of text (one row may be longer), with their bytes and offsets."""
    data, offs = text_buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at), data[offs[at]:offs[to]], offs[at:to + 1] - offs[at]
        at = to


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and ``first``: document ``i`` has the words ``first[i]`` to ``first[i + 1]``."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    breaks = np.zeros(len(data) + 1, bool)
    breaks[offs] = True
    starts = np.flatnonzero(inside & (breaks[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (breaks[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    return starts, ends, np.searchsorted(starts, offs)


def byte_prefix(data: np.ndarray, which: int = 0) -> np.ndarray:
    return prefix_hash(_BYTE_VALUES[which][data])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return range_hash(byte_prefix(data, which), starts, ends)


def as_long(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def document_key(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Column:
    """One key for all rows with the same id and text. Null ids and repeated ids have defined keys as well."""
    return F.xxhash64(F.col(doc_id), F.coalesce(F.col(text), F.lit("")))
