"""Corpus sources: text and binary files, pages, shards, tagged triples and import documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright import schemas
from loomwright.functions import text as T

c = F.col


def source_type(path: Column) -> Column:
    ending = F.lower(F.regexp_extract(path, "(\\.[^./\\\\]+)$", 1))
    return F.when(ending == ".pdf", "pdf").when(ending == ".json", "json").otherwise("txt")


def json_body(raw: Column) -> Column:
    """First non-empty of text, content and body, else the document itself; null when the JSON is not valid."""
    value = F.try_parse_json(raw)
    fields = [F.nullif(F.get_json_object(raw, f"$.{n}"), F.lit("")) for n in ("text", "content", "body")]
    single = F.try_variant_get(value, "$", "string")
    is_object = T.strip(raw).startswith("{")
    is_text = T.strip(raw).startswith('"')
    body = F.when(is_object, F.coalesce(*fields, F.to_json(value))).when(is_text, single).otherwise(F.to_json(value))
    return F.when(value.isNotNull(), body)


def document_text(path: Column, raw: Column) -> Column:
    """Usable text of a file: trimmed and cleaned; a PDF must come with extracted text that is not an error."""
    body = T.strip(F.coalesce(raw, F.lit("")))
    kind = source_type(path)
    parsed = json_body(raw)
    return (
        F.when((kind == "pdf") & body.startswith("ERROR:"), "")
        .when((kind == "json") & parsed.isNull(), body).when(kind == "json", T.clean_lines(T.strip(parsed))).otherwise(T.clean_lines(body))
    )


def ingest_documents(files: DataFrame) -> DataFrame:
    """``(path, value)`` rows to ``(path, source_type, text)``."""
    return files.select("path", source_type(c("path")).alias("source_type"), document_text(c("path"), c("value")).alias("text"))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file below ``path``, ingested."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return ingest_documents(files.select(F.input_file_name().alias("path"), "value"))


def assemble_pages(pages: DataFrame, min_chars: int = 50) -> DataFrame:
    """Pages ``(path, page_no, text, ocr_text)`` of a file joined by blank lines.

    A page below ``min_chars`` takes its recognised text when there is one. The pages of one file make one value, so
    they come together by definition; nothing beyond one file does.
    """
    raw = T.strip(F.coalesce("text", F.lit("")))
    recognised = F.nullif(T.strip(c("ocr_text")), F.lit(""))
    chosen = F.when(F.length(raw) < min_chars, F.coalesce(recognised, raw)).otherwise(raw)
    parts = pages.groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("page_no", chosen.alias("t")))).alias("_p"), F.count_if(F.length(raw) < min_chars).alias("sparse_pages"))
    return parts.select("path", T.strip(F.array_join(F.transform("_p", lambda x: x["t"]), "\n\n")).alias("text"), "sparse_pages")


def read_binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``(path, content)`` of the files below ``path``; Spark does not list files of zero bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "content")


def extract_binary(files: DataFrame, extractor: Callable[[str, bytes], str]) -> DataFrame:
    """``(path, text, error)`` per file; a failing or empty extraction becomes an ``ERROR:`` text.

    Rows with a blank path or one starting with # are skipped.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    texts.append(extractor(path, content) or "ERROR: 提取的文本为空")
                except Exception as error:  # any failure of the injected extractor is data
                    texts.append(f"ERROR: Line processing failed: {error}")
            yield pd.DataFrame({"path": batch["path"].to_numpy(), "text": texts, "error": [t.startswith("ERROR:") for t in texts]})

    path = T.strip(c("path"))
    usable = files.withColumn("path", path).filter((c("path") != "") & ~c("path").startswith("#"))
    return usable.select("path", "content").mapInPandas(run, "path string, text string, error boolean")


def parse_shards(lines: DataFrame) -> DataFrame:
    """``value`` lines ``path TAB text``; ``ok`` is false for lines without a tab."""
    value = T.strip(c("value"))
    split = F.split(value, "\t", 2)
    return lines.filter(value != "").select(
        *[n for n in lines.columns if n != "value"], T.strip(split[0]).alias("path"), F.get(split, F.lit(1)).alias("text"), (F.size(split) == 2).alias("ok"))


def merge_shards(shards: DataFrame, order: str = "pos") -> DataFrame:
    """Texts of one path joined by blank lines in order; error texts stay and are counted."""
    rows = shards.filter("ok")
    grouped = rows.groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct(order, "text"))).alias("_p"), F.count_if(c("text").startswith("ERROR:")).alias("errors"))
    return grouped.select("path", F.array_join(F.transform("_p", lambda x: x["text"]), "\n\n").alias("text"), "errors")


def dropped_lines(shards: DataFrame) -> DataFrame:
    return shards.agg(F.count_if(~c("ok")).alias("dropped"))


def file_ids(rows: DataFrame) -> DataFrame:
    """Add ``file_id`` from paths ``.../uploads/{file_id}/name``; other rows are left out."""
    last = F.element_at(F.split("path", "uploads/"), -1)
    found = F.substring_index(last, "/", 1)
    return rows.filter(c("path").contains("uploads/")).withColumn("file_id", found).filter("file_id <> ''")


def is_usable() -> Column:
    text = F.coalesce("text", F.lit(""))
    return (T.strip(text) != "") & ~T.strip(text).startswith("ERROR:")


def quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable rows, and the blank or failed ones."""
    return rows.filter(is_usable()), rows.filter(~is_usable())


def triples_from_lines(lines: DataFrame) -> DataFrame:
    """CSV lines ``header,relation,tail``; shorter ones are dropped, fields trimmed."""
    parsed = F.from_csv(c("value"), F.lit(schemas.TRIPLES))
    rows = lines.select(*[n for n in lines.columns if n != "value"], parsed.alias("_t"))
    names = ["header", "relation", "tail"]
    kept = [n for n in lines.columns if n != "value"]
    return rows.filter("_t.tail is not null").select(*kept, *[T.strip(c(f"_t.{n}")).alias(n) for n in names])


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, schema=schemas.TRIPLES, mode="PERMISSIVE").filter("tail is not null")
    return rows.select(*[T.strip(c(n)).alias(n) for n in ("header", "relation", "tail")])


def _label(raw: Column, default: str) -> Column:
    return F.when(raw.rlike("^[A-Za-z0-9_]+$"), raw).otherwise(default)


def import_entities(documents: DataFrame) -> DataFrame:
    """Node rows of import documents ``{entities, relationships}`` in column ``value``."""
    rows = documents.select(F.explode(F.from_json("value", schemas.IMPORT_DOCUMENT)["entities"]).alias("e"))
    return rows.select(_label(c("e.type"), "Entity").alias("label"), c("e.name").alias("name"), c("e.properties").alias("properties"))


def import_relationships(documents: DataFrame) -> DataFrame:
    rows = documents.select(F.explode(F.from_json("value", schemas.IMPORT_DOCUMENT)["relationships"]).alias("r"))
    return rows.select(
        c("r.source").alias("subject"), _label(c("r.type"), "RELATED_TO").alias("predicate"), c("r.target").alias("object"), c("r.properties").alias("properties"))


DISEASES = "diseases array<struct<name:string,category:string,description:string,common_symptoms:array<string>,department:string>>"
DRUGS = "drugs array<struct<name:string,type:string,usage:string,dosage:string,treats:array<string>>>"


def read_disease_template(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=DISEASES, multiLine=True).select(F.inline("diseases"))


def read_medicine_template(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=DRUGS, multiLine=True).select(F.inline("drugs"))


def read_symptom_template(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="id string, name string, severity string, description string")


def read_relation_template(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "relation").schema("source string, target string, type string").load(path)
