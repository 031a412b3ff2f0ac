"""From documents to a graph: clean, segment, extract with an injected model, parse, validate, merge."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright import schemas
from loomwright.functions import text as T
from loomwright.operators import assembly as A
from loomwright.operators import chunking as C
from loomwright.session import cut_lineage
from loomwright.sources import corpus as CO

c = F.col


def _unfence(text: str) -> str:
    """Content of the first code fence; without a closing fence all that follows it."""
    for mark in ("```json", "```"):
        if mark in text:
            return text.split(mark, 1)[1].split("```", 1)[0].strip()
    return text


def _load(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def repair_json(output: str) -> tuple[object, str]:
    """Parsed model output and its status: ok, repaired or empty.

    Outside strings brackets are counted; a line feed ends an unfinished string. A balanced object is tried first,
    then the text with its open list and object brackets closed, then with objects closed only.
    """
    text = _unfence((output or "").strip())
    whole = _load(text)
    if whole is not None:
        return whole, "ok"
    start = text.find("{")
    if start < 0:
        return {}, "empty"
    depth = lists = 0
    quote, at = "", start
    while at < len(text):
        found = re.compile(r"\\.|[\n" + quote + "]" if quote else r"[{}\[\]\"']", re.DOTALL).search(text, at)
        if found is None:
            break
        mark, at = found.group(), found.end()
        if quote:
            quote = quote if mark.startswith("\\") else ""
        elif mark in "\"'":
            quote = mark
        else:
            depth += {"{": 1, "}": -1}.get(mark, 0)
            lists = max(0, lists + {"[": 1, "]": -1}.get(mark, 0))
            if mark == "}" and depth == 0 and (part := _load(text[start:at])) is not None:
                return part, "repaired"
    for closing in (quote + "]" * lists + "}" * depth, quote + "}" * depth):
        if (part := _load(text[start:] + closing)) is not None:
            return part, "repaired"
    return {}, "empty"


def parse_outputs(outputs: DataFrame) -> DataFrame:
    """``(unit_id, output)`` to ``(unit_id, entities, relations, status)``; anything unusable gives empty lists."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parsed = [repair_json(t if isinstance(t, str) else "") for t in batch["output"]]
            lists = [{k: [x for x in p.get(k) or [] if isinstance(x, dict)] if isinstance(p.get(k), list) else [] for k in ("entities", "relations")}
                     if isinstance(p, dict) else {"entities": [], "relations": []} for p, _ in parsed]
            yield pd.DataFrame({
                "unit_id": batch["unit_id"].to_numpy(), "json": [json.dumps(x, ensure_ascii=False) for x in lists], "status": [s for _, s in parsed]})

    plain = outputs.select(c("unit_id").cast("string").alias("unit_id"), "output").mapInPandas(run, "unit_id string, json string, status string")
    return plain.select("unit_id", F.from_json("json", schemas.MODEL_OUTPUT).alias("m"), "status").select("unit_id", "m.entities", "m.relations", "status")


def extract(paragraphs: DataFrame, extractor: Callable[[list[str]], list[str]]) -> DataFrame:
    """Raw model outputs ``(unit_id, output)`` for paragraph rows ``(unit_id, chunk)``; the extractor sees lists."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"unit_id": batch["unit_id"].to_numpy(), "output": extractor(batch["chunk"].tolist())})

    return paragraphs.select("unit_id", "chunk").mapInPandas(run, "unit_id string, output string")


def dictionary_extractor(terms: dict[str, str], predicate: str = "HAS_SYMPTOM") -> Callable[[list[str]], list[str]]:
    """A stand-in for a model: the terms found, and a relation between each found term and the next."""
    def run(texts: list[str]) -> list[str]:
        outputs = []
        for text in texts:
            found = [t for t in terms if t in text]
            outputs.append(json.dumps({
                "entities": [{"name": t, "type": terms[t], "description": ""} for t in found],
                "relations": [{"subject": a, "predicate": predicate, "object": b} for a, b in zip(found, found[1:])],
            }, ensure_ascii=False))
        return outputs

    return run


def _rows(parsed: DataFrame, field: str) -> DataFrame:
    return parsed.select("unit_id", F.posexplode(field).alias("pos", "_x")).select("unit_id", c("pos").cast("bigint").alias("pos"), "_x.*")


class GraphBuild:
    """One lineage from documents ``(doc_id, text)`` to validated entities and relations.

    A unit is a paragraph, named ``doc_id:index`` with the index padded so that text order is document order.
    """

    def __init__(self, documents: DataFrame, extractor: Callable[[list[str]], list[str]], size: int = 1000):
        cleaned = documents.select(c("doc_id").cast("string").alias("doc_id"), T.graph_clean(c("text")).alias("text"))
        # cleaned and counted in one pass, for both the sentences and the paragraphs
        counted = cut_lineage(cleaned.withColumn("n", F.size(T.sentences(c("text")))))
        self.sentences = counted.select("doc_id", "n")
        rows = C.chunk(counted.drop("n"), "extraction", size=size)
        unit = F.concat_ws(":", "doc_id", F.lpad(c("chunk_index").cast("string"), 8, "0"))
        self.paragraphs = rows.withColumn("unit_id", unit)
        # model outputs are the dear part of the lineage: written once, whatever is asked of the build later
        self.parsed = cut_lineage(parse_outputs(extract(self.paragraphs, extractor)))
        self.classified, self.entities, self.relation_classes, self.relations = A.validate(
            _rows(self.parsed, "entities"), _rows(self.parsed, "relations"), written=True)

    @staticmethod
    def _with_doc(rows: DataFrame) -> DataFrame:
        return rows.withColumn("doc_id", F.substring_index("unit_id", ":", 1))

    def document_entities(self) -> DataFrame:
        """Entities distinct by (name, type) within a document."""
        rows = self._with_doc(self.entities)
        return rows.groupBy("doc_id", "name", "type").agg(F.min(F.struct("unit_id", "pos", "description")).alias("_f")).select(
            "doc_id", "name", "type", "_f.unit_id", "_f.pos", "_f.description")

    def document_relations(self) -> DataFrame:
        return self._with_doc(self.relations).select("doc_id", "subject", "predicate", "object").distinct()

    def counts(self) -> DataFrame:
        one = F.lit(1).alias("n")
        return A.build_counts(
            "doc_id", sentences=self.sentences.filter("n > 0"), paragraphs=self._with_doc(self.parsed).select("doc_id", one),
            entities=self.document_entities().select("doc_id", one), relations=self.document_relations().select("doc_id", one))

    def stats(self) -> DataFrame:
        return A.validation_stats(self.classified, self.relation_classes, self.relations)


def prepare_corpus(lines: DataFrame, size: int = 1000) -> DataFrame:
    """Shard lines to word chunks: merge, quarantine, clean, chunk, as one lineage with no text format between stages.

    ``lines(pos, value)``; the result has ``path, chunk_index, chunk, chunk_id``. Whole texts pass between the stages, so
    every line of a document survives. Row counts per stage come from ``stage_counts``.
    """
    merged = CO.merge_shards(CO.parse_shards(lines))
    usable, _ = CO.quarantine(merged)
    cleaned = usable.select("path", T.clean_lines(c("text")).alias("text"))
    chunks = C.chunk(cleaned, "words", size=size)
    return chunks.withColumn("chunk_id", F.concat_ws("_chunk_", "path", c("chunk_index")))


def stage_counts(lines: DataFrame, size: int = 1000) -> DataFrame:
    """Rows after each stage, in one row."""
    shards = CO.parse_shards(lines)
    merged = CO.merge_shards(shards)
    totals = merged.agg(F.count("*").alias("extracted"), F.count_if(CO.is_usable()).alias("cleaned"))
    return totals.withColumn("dropped", shards.agg(F.count_if(~c("ok"))).scalar()).withColumn("chunks", prepare_corpus(lines, size).agg(F.count("*")).scalar())
