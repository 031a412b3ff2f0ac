"""Matching names against texts, keyword counts, and merging parses of a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators.grams import occurrences


def top_keywords(df: DataFrame, id_col: str, text_col: str, k: int = 10) -> DataFrame:
    """The ``k`` most frequent 2-4 character runs per text; ties by first appearance."""
    words = df.select(id_col, F.posexplode(T.cjk_runs(F.col(text_col))).alias("pos", "word"))
    counted = words.groupBy(id_col, "word").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    order = Window.partitionBy(id_col).orderBy(F.desc("n"), "first_pos")
    ranked = counted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return ranked.select(id_col, "word", "n", "place")


def contains_join(texts: DataFrame, names: DataFrame, id_col: str, text_col: str, name_col: str = "name") -> DataFrame:
    """(id, columns of ``names``) for every name occurring anywhere in a text; one row per id and row of ``names``."""
    return occurrences(texts, names, id_col, text_col, name_col).distinct().join(names, name_col)


def longest_match(texts: DataFrame, names: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per text and type the longest name it contains; ties by name. ``names`` has (type, name)."""
    hits = occurrences(texts, names, id_col, text_col).join(names.select("type", "name"), "name")
    best = F.min_by("name", F.struct(-F.length("name"), F.col("name"))).alias("name")
    return hits.groupBy(id_col, "type").agg(best)


def match_with_synonyms(texts: DataFrame, names: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Names found in a text; texts without any are matched by the synonyms, flagged ``by_synonym``."""
    direct = contains_join(texts, names.select("name").distinct(), id_col, text_col).select(id_col, "name").distinct()
    rest = texts.join(direct.select(id_col).distinct(), id_col, "left_anti")
    other = contains_join(rest, names.select("name", "synonym"), id_col, text_col, "synonym").select(id_col, "name").distinct()
    return direct.withColumn("by_synonym", F.lit(False)).unionByName(other.withColumn("by_synonym", F.lit(True)))


def merge_parses(model: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """Field by field the model parse when it is not empty, else the rule parse; keywords distinct in order."""
    m, r = model.alias("m"), rules.alias("r")
    joined = m.join(r, [F.col(f"m.{k}") == F.col(f"r.{k}") for k in keys], "full")

    def pick(name: str, empty: Column) -> Column:
        return F.when(F.coalesce(empty, F.lit(True)), F.col(f"r.{name}")).otherwise(F.col(f"m.{name}"))

    n_entities = F.coalesce(F.size("m.entities"), F.lit(0))
    return joined.select(
        *[F.coalesce(f"m.{k}", f"r.{k}").alias(k) for k in keys],
        pick("entities", F.size("m.entities") <= 0).alias("entities"),
        F.coalesce(pick("intent", F.col("m.intent") == ""), F.lit("other")).alias("intent"),
        F.array_distinct(pick("keywords", F.size("m.keywords") <= 0)).alias("keywords"),
        T.parse_confidence(n_entities, F.col("m.intent")).alias("confidence"),
    )
