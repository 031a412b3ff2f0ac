"""Chunking: one text row becomes many chunk rows. All strategies are narrow; none of them shuffles."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright import vocab as V
from loomwright.functions import text as T

CHUNK_SCHEMA = "chunk_index int, chunk string"
#: Bytes of text that a Python worker cuts at a time.
BLOCK = 1 << 20


def paragraphs(text: Column, separator: str | None = None) -> Column:
    """Blocks between blank lines (or another separator pattern), trimmed, empties dropped."""
    separator = separator or f"\\n{T.WS}*\\n+"
    return F.filter(F.transform(F.split(T.strip(text), separator), T.strip), lambda x: x != "")


def fixed_windows(text: Column, size: int = 1000, overlap: int = 100) -> Column:
    """Windows of ``size`` characters, each starting ``size - overlap`` after the one before."""
    step = size - max(0, min(overlap, size - 1))
    body = T.strip(text)
    last = F.when(F.length(body) <= size, F.lit(0)).otherwise(F.ceil((F.length(body) - size) / step)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(body, i * step + 1, F.lit(size)))
    return F.when(F.length(body) == 0, F.array().cast("array<string>")).otherwise(windows)


def _greedy(lengths: list[int], fits: Callable[[int, int], bool], overlap: int = 0) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) packed left to right; the next range starts ``overlap`` items back but always moves on."""
    i, n = 0, len(lengths)
    while i < n:
        total, j = lengths[i], i + 1
        while j < n and fits(total, lengths[j]):
            total += lengths[j]
            j += 1
        yield i, j
        i = max(i + 1, j - overlap)


_SENTENCE = re.compile(r"[^。！？.?!\n]*[。！？.?!\n]+|[^。！？.?!\n]+\Z")
_SPACE = re.compile("[" + re.escape(V.WHITESPACE) + "]+")


def sentence_blocks(text: str, size: int = 1000, overlap: int = 1) -> list[str]:
    """Blocks of whole sentences with their end marks, up to ``size`` characters, ``overlap`` sentences shared."""
    body = text.strip()
    pieces = [s for s in _SENTENCE.findall(body) if s.strip()]
    packed = _greedy([len(s) for s in pieces], lambda total, nxt: total + nxt <= size, overlap)
    blocks = ["".join(pieces[i:j]).strip() for i, j in packed]
    return [b for b in blocks if b]


def word_blocks(text: str, size: int = 1000) -> list[str]:
    """Words packed while their lengths plus one space each stay within ``size``."""
    words = [w for w in _SPACE.split(text) if w]
    packed = _greedy([len(w) + 1 for w in words], lambda total, nxt: total + nxt <= size)
    return [" ".join(words[i:j]) for i, j in packed]


def extraction_paragraphs(text: str, size: int = 1000) -> list[str]:
    """Sentences packed while the summed lengths stay below ``size``, each paragraph closed by a full stop."""
    parts = [s.strip() for s in re.split(r"[。！？.?!\n]+", text) if s.strip()]
    packed = _greedy([len(s) for s in parts], lambda total, nxt: total + nxt < size)
    return ["。".join(parts[i:j]) + "。" for i, j in packed]


def _explode_array(df: DataFrame, chunks: Column, text_col: str) -> DataFrame:
    keep = [c for c in df.columns if c != text_col]
    return df.select(*keep, F.posexplode(chunks).alias("chunk_index", "chunk"))


def _blocks(texts: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of rows that start in one block of ``size`` bytes of text each."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("int64")
    block = (np.cumsum(lengths) - lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)] if len(block) else [0]
    return zip(cuts, cuts[1:])


def _explode_python(df: DataFrame, split: Callable[[str], list[str]], text_col: str) -> DataFrame:
    fields = [f for f in df.schema.fields if f.name != text_col]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [CHUNK_SCHEMA])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            kept = batch.select([i for i in range(batch.num_columns) if i != at])
            for i, j in _blocks(batch.column(at)):  # a worker holds the chunks of one block, however many rows a batch has
                chunks = [split(t) if t is not None else [] for t in batch.column(at).slice(i, j - i).to_pylist()]
                rows = kept.slice(i, j - i).take(pa.array(np.repeat(np.arange(j - i), [len(x) for x in chunks])))
                index = pa.array([k for x in chunks for k in range(len(x))], pa.int32())
                flat = pa.array([y for x in chunks for y in x], pa.string())
                yield pa.RecordBatch.from_arrays([*rows.columns, index, flat], names=[*rows.schema.names, "chunk_index", "chunk"])

    return df.mapInArrow(run, schema)


def chunk(df: DataFrame, strategy: str = "fixed", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``df`` without ``text_col`` plus ``chunk_index`` and ``chunk``; strategies are named below.

    ``paragraph`` (separator), ``fixed`` (size, overlap), ``smart`` (size, overlap in sentences), ``words``
    (size), ``extraction`` (size).
    """
    text = F.col(text_col)
    if strategy == "paragraph":
        return _explode_array(df, paragraphs(text, **options), text_col)
    if strategy == "fixed":
        return _explode_array(df, fixed_windows(text, **options), text_col)
    split = {"smart": sentence_blocks, "words": word_blocks, "extraction": extraction_paragraphs}[strategy]
    return _explode_python(df, lambda t: split(t, **options), text_col)


def with_chunk_rows(chunks: DataFrame, doc_col: str, separator: str = ":") -> DataFrame:
    """Trim the chunks, drop blank ones (the index keeps its gaps) and add ``chunk_id``."""
    return (
        chunks.withColumn("chunk", T.strip(F.col("chunk")))
        .filter(F.col("chunk") != "")
        .withColumn("chunk_id", F.concat_ws(separator, F.col(doc_col).cast("string"), F.col("chunk_index")))
    )


def register_chunk_function(spark: SparkSession, name: str = "chunk_text") -> None:
    """Table function for SQL: ``SELECT d.id, c.* FROM docs d, LATERAL chunk_text(d.text, 'smart', 1000) c``.

    It covers the sequential strategies ``smart``, ``words`` and ``extraction``; the other two are plain expressions.
    """
    splitters = {"smart": sentence_blocks, "words": word_blocks, "extraction": extraction_paragraphs}

    class ChunkText:
        def eval(self, text: str, strategy: str, size: int):
            yield from enumerate(splitters[strategy](text or "", size))

    spark.udtf.register(name, F.udtf(ChunkText, returnType=CHUNK_SCHEMA))


def paragraph_list(text: str, separator: str = "") -> list[str]:
    """``paragraphs`` for one text."""
    blank = "[" + re.escape(V.WHITESPACE) + "]"
    pieces = re.split(separator or f"\\n{blank}*\\n+", text.strip(V.WHITESPACE))
    return [p for p in (x.strip(V.WHITESPACE) for x in pieces) if p]


def window_list(text: str, size: int = 1000, overlap: int = 100) -> list[str]:
    """``fixed_windows`` for one text."""
    body, step = text.strip(V.WHITESPACE), size - max(0, min(overlap, size - 1))
    last = -(-max(0, len(body) - size) // step)
    return [body[i * step:i * step + size] for i in range(last + 1)] if body else []


STRATEGIES = {
    "paragraph": lambda text, size, overlap, separator: paragraph_list(text, separator),
    "fixed": lambda text, size, overlap, separator: window_list(text, size, overlap),
    "smart": lambda text, size, overlap, separator: sentence_blocks(text, size, overlap),
    "words": lambda text, size, overlap, separator: word_blocks(text, size),
    "extraction": lambda text, size, overlap, separator: extraction_paragraphs(text, size),
}


def register_chunk_table(spark: SparkSession, name: str = "chunk_table") -> None:
    """Table function for whole tables: ``SELECT * FROM chunk_table(TABLE(docs), 'text', 'smart', 1000, 1, '')``.

    All five strategies. The result has the columns of the table but the text, then ``chunk_index`` and ``chunk``; its
    schema is worked out from the table when the query is planned. An unknown strategy or text column fails there.
    """
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType
    from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

    class ChunkTable:
        @staticmethod
        def analyze(table: AnalyzeArgument, text: AnalyzeArgument, strategy: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument, separator: AnalyzeArgument) -> AnalyzeResult:
            fields = list(table.dataType.fields)
            if strategy.value not in STRATEGIES:
                raise ValueError(f"no strategy {strategy.value}; there are {', '.join(STRATEGIES)}")
            if text.value not in [f.name for f in fields]:
                raise ValueError(f"the table has no column {text.value}")
            kept = [f for f in fields if f.name != text.value]
            return AnalyzeResult(StructType([*kept, StructField("chunk_index", IntegerType()), StructField("chunk", StringType())]))

        def eval(self, row, text, strategy, size, overlap, separator):
            rest = tuple(v for k, v in row.asDict().items() if k != text)
            for index, chunk in enumerate(STRATEGIES[strategy](row[text] or "", size, overlap, separator)):
                yield (*rest, index, chunk)

    spark.udtf.register(name, F.udtf(ChunkTable))
